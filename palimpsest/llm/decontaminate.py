"""Benchmark decontamination by greedy string tiling.

Seeds are the rolling (Karp-Rabin) hashes of every LEAST words of every benchmark item.  A bitmap of fixed size over all of them passes by nearly all places of
the texts; those that it lets through meet the seeds in an equi-join.  For each pair of a text and an item the longest run of equal words that both sides still
have unmarked is marked, again and again, until none of LEAST words is left; tiles never overlap, and their order doesn't matter, so that
reordered passages are found as well.  The share of an item's words under tiles is its coverage; COVERAGE or more is contamination.

Neither texts nor items come to the driver: it gets the bitmap, of 2^FILTER_BITS bits, and the length of the longest item.  Seeds of a common phrase
are hot keys of a plain equi-join, which Spark splits.

Defined results: items of fewer than LEAST words are their own single seed, of their own length; null or empty items and texts match nothing;
equal items count as one, the smallest item_id; rows that share a key and a text are reported once, rows that share a key alone each; a row without
key is reported with a null key; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy, written
from .words import mix, shingles, slices, text_buffers, word_table

LEAST = 5
COVERAGE = 0.6
FILTER_BITS = 26
#: Bytes of the bitmap in one row.
CHUNK = 1 << 16


def tiles(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal equal runs (length, place in x, place in y): the longest first, never overlapping."""
    heap = [(-n, i, j) for n, i, j in runs if n >= least]
    heapq.heapify(heap)
    marked_x: set[int] = set()
    marked_y: set[int] = set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [p for p in range(n) if i + p not in marked_x and j + p not in marked_y]
        if len(free) == n:
            out.append((n, i, j))
            marked_x.update(range(i, i + n))
            marked_y.update(range(j, j + n))
            continue
        # what is left of the run, in pieces
        begin = None
        for p in [*free, None]:
            if begin is None:
                begin = last = p
            elif p is not None and p == last + 1:
                last = p
            else:
                if last - begin + 1 >= least:
                    heapq.heappush(heap, (begin - last - 1, i + begin, j + begin))
                begin = last = p
    return out


def equal_runs(i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal runs (length, place in x, place in y) of equal words, of the places i and j at which seeds of `size` words agree."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    start = np.flatnonzero(new)
    return list(zip((np.diff(np.append(start, len(i))) + size - 1).tolist(), i[start].tolist(), j[start].tolist(), strict=True))


def tiled(i: np.ndarray, j: np.ndarray, size: int, n_words: int) -> tuple[float, list[tuple[int, int, int]]]:
    """Coverage of an item of n_words words, and the tiles."""
    able = np.zeros(n_words + 1, np.int64)
    np.add.at(able, np.unique(j), 1)
    np.add.at(able, np.unique(j) + size, -1)
    if (np.cumsum(able) > 0).sum() < COVERAGE * n_words:  # all agreeing places together don't cover enough
        return 0.0, []
    found = tiles(equal_runs(i, j, size), size)
    return sum(n for n, _, _ in found) / n_words, found


def _bits(seeds: np.ndarray, size) -> np.ndarray:
    """The place of seeds of so many words in the bitmap."""
    with np.errstate(over="ignore"):
        return (mix(seeds + np.asarray(size, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n_words, item, size, seeds) of (item, text) rows; the seeds are packed, in order."""
    for batch in (part for batch in batches for part in slices(batch, 1)):
        hashed, _, _, per_text = word_table(*text_buffers(batch.column(1)))
        rows = []
        for item, b, e in zip(batch.column(0).to_pylist(), per_text[:-1], per_text[1:], strict=True):
            if e > b:
                size = int(min(LEAST, e - b))
                own = hashed[b:e]
                seeds = shingles(own, np.array([0, e - b]), size)[0]
                digest = mix(own + np.arange(e - b, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                rows.append((int(mix(np.array([digest.sum(dtype=np.uint64)]))[0].view(np.int64)), int(e - b), item, size, seeds.tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "n_words", "item", "size", "seeds"])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, size, item, n_words, j) of item rows."""
    for batch in batches:
        for n_words, item, size, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            seeds = np.frombuffer(blob, np.int64)
            n = len(seeds)
            yield pa.RecordBatch.from_arrays([pa.array(seeds), *[pa.array(np.full(n, x, k)) for x, k in ((size, np.int32), (item, np.int64), (n_words, np.int64))], pa.array(np.arange(n, dtype=np.int32))], names=["seed", "size", "item", "n_words", "j"])


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, bits) of the seeds of a task, without empty chunks."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_bits(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())] = True
    packed = np.packbits(bits)
    rows = [(i, part.tobytes()) for i, part in enumerate(packed.reshape(-1, CHUNK)) if part.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of the bitmaps of a partition, by chunk."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(blob, np.uint8)
            held[chunk] = held[chunk] | part if chunk in held else part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])


def places(bitmap: np.ndarray, sizes: list[int], longest: int):
    """An Arrow function: (key, tag, seed, size, i) of the places of (key, tag, text) rows at which the bitmap lets a seed through.

    Of a stretch of one repeated seed, as of a word repeated without end, the first and the last `longest` places are enough for every tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 2)):
            hashed, _, _, per_text = word_table(*text_buffers(batch.column(2)))
            counts = np.diff(per_text)
            for size in sizes:
                grams, begin = shingles(hashed, per_text, size)
                bit = _bits(grams, size)
                at = np.flatnonzero((bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
                own = np.searchsorted(begin, at, side="right") - 1
                keep = counts[own] >= size
                at, own = at[keep], own[keep]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (grams[at[1:]] != grams[at[:-1]]) | (own[1:] != own[:-1])
                start = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                rank = np.arange(len(at)) - start[group] if len(at) else at
                left = np.diff(np.append(start, len(at)))[group] - rank if len(at) else at
                keep = (rank < longest) | (left <= longest)
                at, own = at[keep], own[keep]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(grams[at].view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array((at - begin[own]).astype(np.int32))],
                        names=["key", "tag", "seed", "size", "i"],
                    )

    return tidy(run)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, item_id, coverage, n_tiles, begin, end) of (key, item, n_words, size, hits) rows whose coverage is enough."""
    for batch in batches:
        rows = []
        hits = batch.column(4)
        ends = np.concatenate([[0], np.cumsum(hits.value_lengths().to_numpy())])
        i, j = (c.to_numpy() for c in hits.flatten().flatten())
        for r, (item, n_words, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
            coverage, t = tiled(i[ends[r] : ends[r + 1]], j[ends[r] : ends[r + 1]], size, n_words)
            if coverage >= COVERAGE:
                rows.append((r, item, coverage, len(t), min(p for _, p, _ in t), max(p + n for n, p, _ in t)))
        if rows:
            picked, *rest = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked)), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names=["key", "item_id", "coverage", "n_tiles", "begin", "end"])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, coverage, n_tiles, begin, end): pairs of a document and an item that it holds; begin and end bound the tiles in the document, in words."""
    settle(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    items = items.mapInArrow(_items, "digest long, n_words long, item long, size int, seeds binary")
    items = items.groupBy("digest", "n_words").agg(F.min(F.struct("item", "size", "seeds")).alias("x")).select("n_words", "x.*")
    seeds = written(items.mapInArrow(_seeds, "seed long, size int, item long, n_words long, j int"))
    shape = seeds.groupBy("size").agg(F.max("n_words").alias("longest")).collect()
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in seeds.select("seed", "size").mapInArrow(_bitmap, "chunk int, bits binary").repartition("chunk").mapInArrow(_either, "chunk int, bits binary").collect():
        packed[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], np.uint8)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tag"), F.col(text).alias("text")).filter("text is not null")
    passed = rows.mapInArrow(places(packed, sorted(r["size"] for r in shape), max((r["longest"] for r in shape), default=0)), f"key {kind}, tag long, seed long, size int, i int")
    hits = passed.join(seeds, ["seed", "size"]).groupBy("key", "tag", "item", "n_words", "size").agg(F.collect_set(F.struct("i", "j")).alias("hits"))
    found = hits.select("key", "item", "n_words", "size", "hits").mapInArrow(_found, f"key {kind}, item_id long, coverage double, n_tiles int, begin int, end int")
    return found.withColumnRenamed("key", key)
