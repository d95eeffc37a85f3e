"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that never stand next to each other inside any token of the
vocabulary can't be merged by any rule, so a cut between them is certain.  A piece
of text is cut at all such places, its fragments are encoded independently, and
their ids are concatenated.  Fragments and space-free chunks recur, so both are
kept in bounded per-worker dictionaries.

The vocabulary file is that of the `tokenizers` library (BPE with an end-of-word
suffix over byte-level characters); its path is a parameter.  The merge loop is our
own; of the library only the file's normaliser and pre-tokeniser are used, and those
only for texts with characters outside the common Latin range.

Defined results: a null or empty text has no ids and decodes to ''.  Added tokens
of the file (such as <|endoftext|>) are recognised in raw text, as the library does.
Repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

#: Bytes of each of the three dictionaries of one worker (fragments, pieces, chunks), which is emptied beyond that; the longest key that they keep.
CACHE_BYTES = (48 << 20, 48 << 20, 128 << 20)
CACHE_KEY = 48
#: About what an entry takes besides its key and its value.
_ENTRY_BYTES = 220
#: Fragments of more characters are merged by a heap.
HEAP_FROM = 40

_NEVER = 1 << 60

#: Characters whose case folding, normal form and class are the same in every Unicode version in use.
_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-¬®-³µ-ÿ]")
#: For lower-case text of those characters: contractions, letters, single numerals, runs of the rest.
_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)


@functools.cache
def _byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 is itself, the others follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """A dictionary that computes what it lacks and starts anew when full; long keys aren't kept."""

    def __init__(self, compute, most: int, size=len):
        super().__init__()
        self.compute, self.most, self.size, self.held = compute, most, size, 0

    def __missing__(self, key):
        value = self.compute(key)
        if (n := self.size(key)) <= CACHE_KEY:
            self.held += n + 8 * len(value) + _ENTRY_BYTES
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for name, i in [*self.vocab.items(), *self.added.items()]:
            self.names[i] = name
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._table = dict(enumerate(_byte_characters()))
        #: The pairs of byte characters that stand side by side inside some token.
        self.joined: set[str] = set()
        for name in self.vocab:
            body = name[: -len(self.suffix)] if self.suffix and name.endswith(self.suffix) and len(name) > len(self.suffix) else name
            self.joined.update(map("".join, zip(body, body[1:], strict=False)))
        self._fragment = _Memo(self._merge, CACHE_BYTES[0], lambda key: len(key[0]))
        self._piece = _Memo(lambda piece: self.encode_piece(piece.encode().decode("latin-1").translate(self._table)), CACHE_BYTES[1])
        self._chunk = _Memo(self._encode_chunk, CACHE_BYTES[2])

    def cuts(self, piece: str) -> list[str]:
        """piece, cut wherever no token has the two neighbours side by side."""
        places = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.joined]
        return [piece[i:j] for i, j in zip([0, *places], [*places, len(piece)], strict=True)]

    def _merge(self, key: tuple[str, bool]) -> list[int]:
        """Ids of a fragment; the flag says that the word ends with it."""
        fragment, last = key
        parts = list(fragment)
        if last:
            parts[-1] += self.suffix
        if len(parts) > HEAP_FROM:
            return self._merge_by_heap(parts)
        rank = self.rank.get
        ranks = [rank(pair, _NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NEVER)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_by_heap(self, parts: list[str]) -> list[int]:
        """As _merge does it, in n log n: a heap of (rank, place) over a linked list; entries whose pair has changed are passed over."""
        rank = self.rank.get
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or rank((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank((parts[k], parts[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return [self.vocab[p] for p in parts if p in self.vocab]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-tokenised piece, given in byte characters."""
        *inner, final = self.cuts(piece)
        ids: list[int] = []
        for fragment in inner:
            ids += self._fragment[fragment, False]
        ids += self._fragment[final, True]
        return ids

    def _encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in _PIECES.findall(chunk):
            ids += self._piece[piece]
        return array.array("I", ids).tobytes()

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode_plain(self, text: str) -> bytes:
        if _UNCOMMON.search(text) is None:
            return b"".join(map(self._chunk.__getitem__, text.lower().split()))
        ids: list[int] = []
        for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text)):
            ids += self.encode_piece(piece)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if self._added is None or "<" not in text or not self._added.search(text):
            return np.frombuffer(self._encode_plain(text), "<u4")
        out = []
        for i, part in enumerate(self._added.split(text)):
            if i % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out.append(self._encode_plain(part))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Token names joined by spaces: the file names no decoder, and then the library does this."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@functools.lru_cache(4)
def encoder(path: str) -> ForcedBoundaryBPE:
    """The worker's encoder for a vocabulary file."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encodes and decodes every row's text: key, n_tokens, ids_sha256, decoded_sha256 (, ids, decoded).

    A map without a shuffle; one row's text and ids are the most that a task holds beyond its batch.
    """
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            counts, left, right, ids_out, text_out = [], [], [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                decoded = bpe.decode(ids)
                counts.append(len(ids))
                left.append(hashlib.sha256(ids.tobytes()).hexdigest())
                right.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    ids_out.append(ids.astype(np.int32))
                if keep_text:
                    text_out.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            if keep_text:
                columns.append(pa.array(text_out, pa.string()))
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(tidy(run), schema)
