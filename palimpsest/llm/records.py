"""Token-id output as length-delimited binary records with a separate offset index.

A data file is a run of records

    length   unsigned 64-bit, bytes of the payload
    check    unsigned 32-bit, masked CRC-32 of the length's 8 bytes
    payload  doc_id (signed 64-bit, its minimum for null), id width in bytes (unsigned 8-bit), ids
    check    unsigned 32-bit, masked CRC-32 of the payload

all little-endian.  Beside each data file stands an index of (doc_id, offset, n_tokens)
rows of signed 64-bit integers, by which records can be read in any order.  Files are
written in the order of the key: file i holds no key above those of file i + 1.

Every task writes under a name of its own attempt and then renames, so a retried or
duplicated task leaves the same files.  Nothing but one manifest row a file returns.

Defined results: a null or empty text is one record that holds the end id only; equal
keys stay together, ordered by text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, shared_dir, tidy, written

#: Fixed values of the file format.
_MASK_DELTA = 0xA282EAD8
_NULL_KEY = -(1 << 63)
_HEAD = struct.Struct("<QI")
_CHECK = struct.Struct("<I")
_KEY = struct.Struct("<qB")
#: Bytes of chunks and ids that one worker keeps; with more it keeps those of its last texts only.
CACHE_BYTES = 40 << 20
#: Bytes of text that are encoded at once, and chunks that go to the library in one string.
TEXT_BYTES = 8 << 20
JOINED = 1000

#: Texts that take the short way have single blanks between words and common Latin characters only.
_UNCOMMON = "[^\n\x20-\x7e¡-¬®-ÿ]|[ \n][ \n]|\\A[ \n]|[ \n]\\z"


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that checksums of data that hold checksums stay good."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


class ChunkEncoder:
    """The tokenizers library behind a dictionary of blank-led chunks.

    The byte-level pre-tokeniser always cuts before a single blank or line end between visible characters, so such chunks are
    encoded independently of each other.  Texts are dictionary-encoded by chunks; only chunks that are not known yet go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        names = {i: name for name, i in self.library.get_vocab().items()}
        #: Whether a token begins with a blank or a line end, in the file's byte characters.
        self.leads = np.array([names.get(i, "")[:1] in ("Ġ", "Ċ") for i in range(max(names) + 1)])
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.packed = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and the ids: \r marks a text's first chunk, a blank is left out before others but \n."""
        ids = [np.zeros(0, self.kind)] * len(chunks)
        first = [i for i, c in enumerate(chunks) if c[0] == "\r"]
        for i, e in zip(first, self.library.encode_batch_fast([chunks[i][1:] for i in first], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, self.kind)
        rest = [i for i, c in enumerate(chunks) if c[0] != "\r"]
        for at in range(0, len(rest), 20 * JOINED):
            parts = [rest[j : j + JOINED] for j in range(at, min(at + 20 * JOINED, len(rest)), JOINED)]
            texts = ["".join([c if c[0] == "\n" else " " + c for c in map(chunks.__getitem__, part)]) for part in parts]
            for part, e in zip(parts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                own = np.array(e.ids, self.kind)
                cut = np.flatnonzero(self.leads[own])
                if len(cut) != len(part):
                    raise ValueError("the vocabulary joins chunks")
                for i, b, j in zip(part, cut.tolist(), [*cut[1:].tolist(), len(own)], strict=True):
                    ids[i] = own[b:j]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate([np.zeros(0, self.kind), *ids])

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """The ids of each text as bytes of self.kind."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _UNCOMMON)
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = odd.to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy()
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd & (size > 0)).tolist():
            out[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind).tobytes()
        plain = np.flatnonzero(~odd & (size > 0))
        if not len(plain):
            return out
        # a blank before each chunk but a text's first; \r, which such texts lack, marks the latter
        marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\r", pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), "")))
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(place.is_null())
        counts, ids = self._encode(fresh.to_pylist())
        at = place.fill_null(0).to_numpy().astype(np.int64)
        at[place.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        self.packed = np.concatenate([self.packed, ids])
        index = at[coded.indices.to_numpy()]
        each = np.diff(self.begin)[index]
        ends = np.cumsum(each)
        # the place of each id: its chunk's begin, and one more for each id of the chunk before it
        flat = self.packed[np.repeat(self.begin[index] - (ends - each), each) + np.arange(ends[-1])]
        text_end = ends[np.cumsum(split.value_lengths().to_numpy()) - 1].tolist()
        for i, b, e in zip(plain.tolist(), [0, *text_end[:-1]], text_end, strict=True):
            out[i] = flat[b:e].tobytes()
        if self.known.nbytes + self.begin.nbytes + self.packed.nbytes > CACHE_BYTES:
            each, begin = np.diff(self.begin)[at], self.begin[at]
            ends = np.cumsum(each)
            packed = self.packed[np.repeat(begin - (ends - each), each) + np.arange(ends[-1])]
            self._forget()
            if coded.dictionary.nbytes + packed.nbytes < CACHE_BYTES // 2:
                self.known, self.begin, self.packed = coded.dictionary, np.concatenate([[0], ends]), packed
        return out


@functools.lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    return ChunkEncoder(path)


def frame(key: int | None, ids: bytes, width: int) -> bytes:
    """One record."""
    payload = _KEY.pack(_NULL_KEY if key is None else key, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + _CHECK.pack(masked_crc(length)) + payload + _CHECK.pack(masked_crc(payload))


def read_frame(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record's key and ids, or None at the end; raises ValueError on damage."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("cut short in a record's head")
    length, check = _HEAD.unpack(head)
    if masked_crc(head[:8]) != check:
        raise ValueError("a record's length doesn't match its checksum")
    payload, tail = stream.read(length), stream.read(_CHECK.size)
    if len(payload) < length or len(tail) < _CHECK.size or _CHECK.unpack(tail)[0] != masked_crc(payload):
        raise ValueError("a record's payload doesn't match its checksum")
    key, width = _KEY.unpack_from(payload)
    return (None if key == _NULL_KEY else key), np.frombuffer(payload, f"<u{width}", offset=_KEY.size)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of batches, joined up to TEXT_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= TEXT_BYTES:
            yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


def write_records(docs: DataFrame, path: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes texts, appends end_id to each, and writes files in ascending order of the key.

    Returns the manifest (file_no, folder, name, n_docs, n_tokens), itself written.  One range
    shuffle of the texts; tasks stream batch by batch into their file.
    """
    folder = folder or shared_dir(docs.sparkSession)
    parts = buckets(docs, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId()
        bpe = encoder(path)
        end = np.array([end_id], bpe.kind).tobytes()
        width = bpe.kind.itemsize
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = f"tokens-{number:06d}"
        own = f"{root}/.{name}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        offset = total = 0
        index: list[np.ndarray] = []
        with files.open_output_stream(f"{own}.bin") as out:
            for keys, texts in gathered(batches):
                rows = []
                for k, ids in zip(keys.to_pylist(), bpe.encode_all(texts), strict=True):
                    record = frame(k, ids + end, width)
                    count = (len(ids) + width) // width
                    rows.append((_NULL_KEY if k is None else k, offset, count))
                    offset += len(record)
                    total += count
                    out.write(record)
                index.append(np.array(rows, "<i8").reshape(-1, 3))
        n_docs = sum(map(len, index))
        if not n_docs:
            files.delete_file(f"{own}.bin")
            return
        with files.open_output_stream(f"{own}.idx") as out:
            for rows in index:
                out.write(rows.tobytes())
        for suffix in ("idx", "bin"):
            files.move(f"{own}.{suffix}", f"{root}/{name}.{suffix}")
        yield pa.RecordBatch.from_pydict({"file_no": [number], "folder": [folder], "name": [name], "n_docs": [n_docs], "n_tokens": [total]})

    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    return written(ordered.mapInArrow(tidy(run), "file_no long, folder string, name string, n_docs long, n_tokens long"))


def read_records(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every record, read from the files of a manifest.

    start counts the ids of all records before it, over all files.  The sum over files before
    one works on a row a file.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, root = _filesystem(row["folder"])
                with store.open_input_stream(f"{root}/{row['name']}.idx") as stream:
                    index = np.frombuffer(stream.read(), "<i8").reshape(-1, 3)
                at, done, out = row["base"], 0, []
                with store.open_input_stream(f"{root}/{row['name']}.bin", buffer_size=1 << 20) as stream:
                    while (record := read_frame(stream)) is not None:
                        k, ids = record
                        if index[done, 2] != len(ids) or index[done, 0] != (_NULL_KEY if k is None else k):
                            raise ValueError(f"{row['name']}: index and data differ at record {done}")
                        out.append((k, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        done += 1
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                if done != len(index):
                    raise ValueError(f"{row['name']}: {done} records, but {len(index)} in the index")
                if out:
                    yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "n_tokens", "ids_crc32"])

    return files.select("folder", "name", "base").repartition(parts).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def read_at(folder: str, name: str, row: int) -> tuple[int | None, np.ndarray]:
    """One record, found by its row in the index: the way of shuffled reads."""
    store, root = _filesystem(folder)
    with store.open_input_file(f"{root}/{name}.idx") as stream:
        stream.seek(24 * row)
        _, offset, _ = struct.unpack("<qqq", stream.read(24))
    with store.open_input_file(f"{root}/{name}.bin") as stream:
        stream.seek(offset)
        return read_frame(stream)
