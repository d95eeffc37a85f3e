"""Walks of graphs that fall into parts: each part in one task, on bitmaps of its own commits.

Edges are (part, oid, parent) rows; no edge leaves its part, and no oid is in two; oids are longs.  Edges and what is asked meet in one shuffle by part.  A task takes whole
parts, some at a time, and gives each commit the bitmap of what it reaches, parents before children, in about n^2 / 8 bytes for a part of n commits.  All answers are read off these
bitmaps, so that no round is written or shuffled.  The (part) rows of `large`, of more than MOST commits, go the way of `graph`, round by round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Commits of a part that a task may take whole.
MOST = 16384
#: Rows that a task holds before it walks them, and bytes of the bitmaps of those walked at once.
HELD = 500_000
BITMAPS = 64 << 20


def _gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, … for size[0] places, then those of the next."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def bitmaps(own: np.ndarray, words: int, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """What each node reaches: own holds its bit inside its part, child and parent the nodes of each edge."""
    n = len(own)
    bits = np.zeros((n, words), np.uint64)
    bits[np.arange(n), own >> 6] = np.uint64(1) << (own & 63).astype(np.uint64)
    up, down = np.argsort(parent, kind="stable"), np.argsort(child, kind="stable")
    children, parents = child[up], parent[down]
    n_children, n_parents = np.bincount(parent, minlength=n), np.bincount(child, minlength=n)
    first_child, first_parent = np.cumsum(n_children) - n_children, np.cumsum(n_parents) - n_parents

    def take(nodes: np.ndarray) -> np.ndarray:
        size = n_parents[nodes]
        above = bits[parents[_gathered(first_parent[nodes], size)]]
        return bits[nodes] | np.bitwise_or.reduceat(above, np.cumsum(size) - size, axis=0)

    left = n_parents.copy()
    ready = np.flatnonzero(left == 0)
    while len(ready):
        met, times = np.unique(children[_gathered(first_child[ready], n_children[ready])], return_counts=True)
        left[met] -= times
        ready = met[left[met] == 0]
        if len(ready):
            bits[ready] = take(ready)
    # cycles, and what is above them
    rest = np.flatnonzero(left > 0)
    while len(rest):
        now = take(rest)
        if (now == bits[rest]).all():
            break
        bits[rest] = now
    return bits


def _set_bits(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bit) of the set bits, some rows at a time."""
    step = max(1, (BITMAPS // 64) // (64 * rows.shape[1]))
    for begin in range(0, len(rows), step):
        part = np.ascontiguousarray(rows[begin : begin + step])
        row, bit = np.nonzero(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little"))
        yield row + begin, bit


def _has(rows: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (rows[np.arange(len(bit)), bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Walked:
    """Parts with their bitmaps: ids and bits of the nodes, the own bit and the first node of the part of each."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, own: np.ndarray, first: np.ndarray):
        self.ids, self.bits, self.own, self.first = ids, bits, own, first

    def reach(self, x, y):
        for row, bit in _set_bits(self.bits[x]):
            yield self.ids[x][row], self.ids[self.first[x][row] + bit]

    def reached(self, x, y):
        first = self.first[x]
        order = np.argsort(first, kind="stable")
        begin = np.flatnonzero(np.diff(first[order], prepend=-1))
        if len(begin):
            for row, bit in _set_bits(np.bitwise_or.reduceat(self.bits[x[order]], begin, axis=0)):
                yield (self.ids[first[order][begin][row] + bit],)

    def sets(self, x, y):
        for row, bit in _set_bits(self.bits[x] | self.bits[y]):
            yield self.ids[x][row], self.ids[y][row], self.ids[self.first[x][row] + bit], _has(self.bits[x[row]], bit), _has(self.bits[y[row]], bit)

    def weights(self, x, y):
        range_ = self.bits[y] & ~self.bits[x]
        total = np.bitwise_count(range_).sum(1, dtype=np.int64)
        for row, bit in _set_bits(range_):
            at = self.first[x][row] + bit
            weight = np.zeros(len(at), np.int64)
            for word in range(self.bits.shape[1]):
                weight += np.bitwise_count(self.bits[at, word] & ~self.bits[x[row], word])
            yield self.ids[x][row], self.ids[y][row], self.ids[at], weight, total[row]

    def between(self, x, y):
        for row, bit in _set_bits(self.bits[y]):
            at, end = self.first[x][row] + bit, x[row]
            keep = (at != end) & _has(self.bits[at], self.own[end])
            yield self.ids[end][keep], self.ids[y[row]][keep], self.ids[at][keep]

    def best(self, x, y):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)]
        x, y = x[new], y[new]
        if len(x):
            begin = np.flatnonzero(np.diff(x, prepend=-1))
            below = self.bits[y]
            below[np.arange(len(y)), self.own[y] >> 6] &= ~(np.uint64(1) << (self.own[y] & 63).astype(np.uint64))
            covered = np.repeat(np.bitwise_or.reduceat(below, begin, axis=0), np.diff(np.append(begin, len(x))), axis=0)
            keep = ~_has(covered, self.own[y])
            yield self.ids[x][keep], self.ids[y][keep]

    def counted(self, x, y):
        order = np.argsort(y, kind="stable")
        begin = np.flatnonzero(np.diff(y[order], prepend=-1))
        if len(begin):
            yield self.ids[y[order][begin]], np.bitwise_count(np.bitwise_or.reduceat(self.bits[x[order]], begin, axis=0)).sum(1, dtype=np.int64)


_OUT = {
    "reach": "tip long, oid long",
    "reached": "oid long",
    "sets": "a long, b long, oid long, in_a boolean, in_b boolean",
    "weights": "a long, b long, oid long, weight long, total long",
    "between": "a long, b long, oid long",
    "best": "tip long, oid long",
    "counted": "name long, n long",
}


def _walk(what: str, part: np.ndarray, asks: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """What is asked of whole parts: rows (part, asks, x, y), edges where they don't ask."""
    node_part = np.concatenate([part, part])
    ids, at, node = np.unique(np.concatenate([x, y]), return_index=True, return_inverse=True)
    order = np.argsort(node_part[at], kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, parts = ids[order], node_part[at][order]
    x, y = place[node[: len(x)]], place[node[len(x) :]]
    begin = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    size = np.diff(np.append(begin, len(ids)))
    own_part = np.repeat(np.arange(len(begin)), size)
    words = 1 << np.ceil(np.log2(-(-size // 64))).astype(np.int64)
    # parts with bitmaps of one width, so many that theirs fit
    by_words = np.argsort(words, kind="stable")
    cost = np.cumsum((size * words * 8)[by_words]) // BITMAPS
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(cost) != 0) | (np.diff(words[by_words]) != 0)]))
    chunk = np.empty(len(begin), np.int64)
    chunk[by_words] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(begin))))
    row_chunk = chunk[own_part[x]]
    row_order = np.argsort(row_chunk, kind="stable")
    rows_end = np.searchsorted(row_chunk[row_order], np.arange(len(cut) + 1))
    for i in range(len(cut)):
        taken = np.sort(by_words[cut[i] : cut[i + 1] if i + 1 < len(cut) else len(begin)])
        nodes = _gathered(begin[taken], size[taken])
        first = np.repeat(np.cumsum(size[taken]) - size[taken], size[taken])
        own = np.arange(len(nodes)) - first
        rows = row_order[rows_end[i] : rows_end[i + 1]]
        u, v = np.searchsorted(nodes, x[rows]), np.searchsorted(nodes, y[rows])
        ask = asks[rows]
        bits = bitmaps(own, int(words[taken[0]]), u[~ask], v[~ask])
        yield from getattr(Walked(ids[nodes], bits, own, first), what)(u[ask], v[ask])


def _local(edges: DataFrame, asked: DataFrame, what: str) -> DataFrame:
    names = [c.split()[0] for c in _OUT[what].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for columns in _walk(what, *rows):
                for begin in range(0, len(columns[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[begin : begin + (1 << 16)]) for c in columns], names=names)

        held, count = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            count += batch.num_rows
            if count > HELD:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                # the last part may go on
                end = int(np.searchsorted(rows[0], rows[0][-1]))
                if end:
                    yield from told([c[:end] for c in rows])
                held = [[c[end:] for c in rows]]
                count = len(held[0][0])
        if count:
            yield from told([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = edges.select("part", F.lit(False).alias("asks"), F.col("oid").alias("x"), F.col("parent").alias("y"))
    rows = rows.union(asked.select("part", F.lit(True).alias("asks"), "x", "y")).filter("x is not null and y is not null")
    # by a value that no join before deals by: such a shuffle would be taken for this one, and adaptive execution may undo it where the join becomes a broadcast
    return rows.repartition(F.hash("part")).sortWithinPartitions("part").mapInArrow(run, _OUT[what])


def _answered(edges: DataFrame, asked: DataFrame, large: DataFrame, what: str, otherwise: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What is asked by (part, x, y) rows; `otherwise` answers for the (part, oid, parent) and (part, x, y) rows of large parts."""
    if large.isEmpty():
        return _local(edges, asked, what)
    small = _local(*(rows.join(large, "part", "left_anti") for rows in (edges, asked)), what)
    return small.union(otherwise(*(rows.join(large, "part", "left_semi") for rows in (edges, asked))).select(small.columns))


def reach_of(tips: DataFrame, edges: DataFrame, large: DataFrame) -> DataFrame:
    """(tip, oid): what each (part, tip) reaches, itself included; as graph.reach_of."""
    asked = tips.select("part", F.col("tip").alias("x"), F.col("tip").alias("y")).distinct()
    return _answered(edges, asked, large, "reach", lambda e, t: graph.reach_of(t.select(F.col("x").alias("tip")), e))


def reached(tips: DataFrame, edges: DataFrame, large: DataFrame) -> DataFrame:
    """(oid): what any (part, oid) of tips reaches, themselves included; as graph.reached."""
    asked = tips.select("part", F.col("oid").alias("x"), F.col("oid").alias("y"))
    return _answered(edges, asked, large, "reached", lambda e, t: graph.reached(t.select(F.col("x").alias("oid")), e))


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.select("part", F.col("a").alias("x"), F.col("b").alias("y")).distinct()


def _reach_of_sides(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.reach_of(pairs.select(F.col("x").alias("tip")).union(pairs.select("y")), edges)


def pair_sets(pairs: DataFrame, edges: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b, oid, in_a, in_b) of every commit that either of a (part, a, b) pair reaches; as graph.pair_sets."""
    return _answered(edges, _sides(pairs), large, "sets", lambda e, p: graph.pair_sets(p.select(F.col("x").alias("a"), F.col("y").alias("b")), _reach_of_sides(p, e)))


def bisect_weights(pairs: DataFrame, edges: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b, oid, weight, total) for each commit of a..b of (part, a, b) pairs; as graph.bisect_weights."""

    def otherwise(e: DataFrame, p: DataFrame) -> DataFrame:
        return graph.bisect_weights(graph.pair_sets(p.select(F.col("x").alias("a"), F.col("y").alias("b")), _reach_of_sides(p, e)), e)

    return _answered(edges, _sides(pairs), large, "weights", otherwise)


def ancestry_path(pairs: DataFrame, edges: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b, oid): commits of a..b on a path between the two of (part, a, b) pairs; as graph.ancestry_path."""

    def otherwise(e: DataFrame, p: DataFrame) -> DataFrame:
        return graph.ancestry_path(p.select(F.col("x").alias("a"), F.col("y").alias("b")), graph.reach_of(p.select(F.col("y").alias("tip")), e), e)

    return _answered(edges, _sides(pairs), large, "between", otherwise)


def best_of(held: DataFrame, edges: DataFrame, large: DataFrame) -> DataFrame:
    """(tip, oid): of the (part, tip, oid) rows of each tip those that no other one of it reaches."""
    asked = held.select("part", F.col("tip").alias("x"), F.col("oid").alias("y"))
    return _answered(edges, asked, large, "best", lambda e, h: graph.uncovered(h.select(F.col("x").alias("tip"), F.col("y").alias("oid")), e))


def counted(tips: DataFrame, edges: DataFrame, large: DataFrame) -> DataFrame:
    """(name, n): how many commits the (part, tip, name) tips of each name reach together, by the union of their bitmaps; a name is an oid of the part."""
    asked = tips.select("part", F.col("tip").alias("x"), F.col("name").alias("y"))

    def otherwise(e: DataFrame, t: DataFrame) -> DataFrame:
        reach = graph.reach_of(t.select(F.col("x").alias("tip")), e).withColumnRenamed("tip", "x")
        return t.join(reach, "x").select(F.col("y").alias("name"), "oid").distinct().groupBy("name").agg(F.count("*").alias("n"))

    return _answered(edges, asked, large, "counted", otherwise)
