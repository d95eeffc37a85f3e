"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Texts become sets of k-word shingles; two sets link when their Jaccard similarity is num / den or more.  Equal sets are
one node from the start.  Then

* light sets (of at most x shingles) enumerate their subsets of the sizes that a link needs: two sets of sizes a <= b
  link if and only if they share o(a, b) = ceil(num (a + b) / (num + den)) shingles, so those with a common subset of that
  size are linked, without any further check;
* heavy sets scan inverted lists: each set is put in the lists of the shingles of its prefix (rarest first; two linked sets share one),
  and what meets in a list is checked on whole sets, unless counts of their shingles by class already rule a link out.

The boundary x is chosen by cost, from the histogram of set sizes.  The order of shingles comes from a count sketch of fixed size: any
order gives right results, and this one keeps common passages out of prefixes.

Lists of up to PAIRS sets emit their pairs; longer ones are cut into blocks of BLOCK sets, whose block pairs are each searched in a task for
a spanning forest of their links, so that no group of near copies is expanded into all its pairs.  Sets whose class counts rule out every
partner of a block pair leave it.

What may link is itself a graph, and its components, mostly small, are disjoint: the text of each set goes once to the task of its component, which
finds a spanning forest of all links there.  Only components beyond GROUP_WORK or GROUP_SIZE are checked by pairs and block pairs.  There the lists of the first EARLY
places of prefixes go first.  Of the others only pairs of sets that are not connected by then are compared, and only lists in which such sets meet:
pairs inside a component can't change it.  A bitmap of fixed size keeps texts that no link needs out of the shuffles.

Defined results: a text of fewer than k words, but one, has its whole sequence as its one shingle; without words or text (null) it is empty and
linked with nothing; equal texts share a component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, release, settle, tidy, written
from .components import components
from .words import mix, shingles, slices, text_buffers, word_table

SKETCH = 1 << 22
#: Bits of a shingle's hash that don't choose its cell.
_CELL = np.uint64(64 - 22)
CHUNK = 1 << 16
PAIRS = 24
BLOCK = 512
#: Places of a prefix that are looked at before the others: what they connect isn't compared again.
EARLY = 3
#: Sets that a task remembers to pass over their copies, and entries that it holds before it deals them out.
SEEN = 100_000
HELD = 200_000
#: Bounds of a group that one task searches for links: sets x shingles, and shingles.
GROUP_WORK = 500_000_000
GROUP_SIZE = 2_000_000
#: Bits of the map of documents whose texts are asked for, and of one part of it.
MARKS = 1 << 26
MARKS_PART = 1 << 16
#: Classes that a set's shingles are counted in, to pass over pairs that differ in too many.
_CLASSES = np.uint64(256)
#: The largest size that the boundary may take, and relative costs of its choice.
LARGEST_LIGHT = 40
COST_CHECK = 40.0
COST_SHARE = 0.05
_ENTRY = np.dtype([("key", "<u8"), ("sid", "<i8"), ("n", "<i4"), ("place", "<i4")])
_LIGHT_SMALL, _LIGHT_LARGE = -1, -2


class Threshold:
    """Integer arithmetic of a Jaccard threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, s: int) -> range:
        return range(-(-self.num * s // self.den), self.den * s // self.num + 1)

    def prefix(self, s: int) -> int:
        return s - -(-self.num * s // self.den) + 1

    def subsets(self, s: int, x: int) -> list[tuple[int, int, int]]:
        """(a, b, subset size) of each pair of light sizes that a set of size s may be part of, but for equal sets."""
        out = []
        for p in self.partners(s):
            a, b = min(s, p), max(s, p)
            if b <= x and a > 0 and (o := self.overlap(a, b)) <= a and not (a == b == o):
                out.append((a, b, o))
        return out


@functools.lru_cache(None)
def _missing(s: int, m: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(s), m)), np.int64).reshape(-1, m)


def sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    data, offsets = text_buffers(column)
    hashed, _, _, per_text = word_table(data, offsets)
    values, begin = shingles(hashed, per_text, k)
    out = []
    for i in range(len(begin) - 1):
        own = np.sort(values[begin[i] : begin[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out


def set_id(own: np.ndarray) -> int:
    """One signed 64-bit id of a set."""
    with np.errstate(over="ignore"):
        x = mix(own).sum(dtype=np.uint64) + np.uint64(len(own)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def _profile(k: int):
    """Rows of (doc, n, sid), then the task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), set()
        names = ["doc", "n", "sid", "classes", "chunk", "counts"]
        for batch in (part for batch in batches for part in slices(batch, 1)):
            sizes, sids, classes, fresh = [], [], [], []
            for own in sets_of(batch.column(1), k):
                sid = set_id(own)
                sizes.append(len(own))
                sids.append(sid)
                classes.append(np.bincount((own % _CLASSES).astype(np.int64), minlength=int(_CLASSES)).astype(np.uint8).tobytes())
                if sid not in seen and len(own):
                    if len(seen) < SEEN:
                        seen.add(sid)
                    fresh.append((own >> _CELL).astype(np.int64))
            if fresh:
                cells, times = np.unique(np.concatenate(fresh), return_counts=True)
                sketch[cells] += times.astype(np.uint32)
            n = len(sids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(classes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if sketch.any():
            parts = range(SKETCH // CHUNK)
            blobs = [np.minimum(sketch[i * CHUNK : (i + 1) * CHUNK], 255).astype(np.uint8).tobytes() for i in parts]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(blob.as_buffer(), np.uint8).astype(np.int64)
            sums[chunk] = np.minimum(sums[chunk] + part, 0xFFFFFFFF) if chunk in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<u4").tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def levels(sketch: np.ndarray) -> np.ndarray:
    """Commonness of each cell: 0 within the noise of the sketch, then one for each doubling above it."""
    mean = sketch.mean()
    spread = math.sqrt(mean) + 1
    out = np.zeros(len(sketch), np.uint8)
    for at in range(0, len(sketch), CHUNK):
        over = np.maximum((sketch[at : at + CHUNK] - mean) / spread, 1e-9)
        out[at : at + CHUNK] = np.where(over > 3, 1 + np.log2(over), 0)
    return out


def boundary(histogram: dict[int, int], t: Threshold) -> int:
    """The light-heavy boundary of least cost: postings of subsets below it, of prefixes and their checks above it."""

    def heavy(s: int) -> float:
        return t.prefix(s) * (1 + COST_SHARE * COST_CHECK)

    def light(s: int) -> float:
        return sum(math.comb(s, s - o) for _, _, o in t.subsets(s, LARGEST_LIGHT))

    costs = {x: sum(n * (light(s) if s <= x else heavy(s)) for s, n in histogram.items()) for x in range(LARGEST_LIGHT + 1)}
    return min(costs, key=lambda x: (costs[x], x))


def _postings(k: int, t: Threshold, x: int, level: np.ndarray, n_buckets: int):
    """Entries of subset keys and of prefixes, packed by bucket."""
    least_heavy = t.partners(x + 1).start

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate(held)
        bucket = (entries["key"] % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cut[1:], len(bucket))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array([entries[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for batch in batches:
            for own in (own for part in slices(batch, 0) for own in sets_of(part.column(0), k)):
                s = len(own)
                if not s:
                    continue
                sid = set_id(own)
                if sid in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(sid)
                if s <= x:
                    mixed = mix(own)
                    with np.errstate(over="ignore"):
                        total = mixed.sum(dtype=np.uint64)
                        for a, b, o in t.subsets(s, x):
                            m = s - o
                            sums = total - mixed[_missing(s, m)].sum(1, dtype=np.uint64) if m else np.array([total])
                            entry = np.zeros(len(sums), _ENTRY)
                            entry["key"] = mix(sums + np.uint64((a << 40) + (b << 8) + 1) * np.uint64(0xD6E8FEB86659FD93))
                            entry["sid"], entry["n"], entry["place"] = sid, s, _LIGHT_SMALL if s == a else _LIGHT_LARGE
                            held.append(entry)
                            count += len(entry)
                if s >= least_heavy:
                    common = level[(own >> _CELL).astype(np.int64)].astype(np.uint64)
                    prefix = t.prefix(s)
                    ranked = np.sort((common << np.uint64(58)) | (mix(own) >> np.uint64(6)))[:prefix]
                    entry = np.zeros(len(ranked), _ENTRY)
                    entry["key"], entry["sid"], entry["n"], entry["place"] = mix(ranked), sid, s, np.arange(len(ranked))
                    held.append(entry)
                    count += len(entry)
            if count > HELD:
                yield from flush(held)
                held, count = [], 0
        if held:
            yield from flush(held)

    return run


def _meet(t: Threshold, x: int):
    """From the entries of a bucket: links of light sets (kind 0), pairs to check (1, or 3 if late), members of long lists (2, or 4 if late)."""

    def run(table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(b.as_buffer(), _ENTRY) for b in table.column("entries").combine_chunks()])
        e = e[np.lexsort((e["sid"], e["n"], e["place"] < 0, e["key"]))]
        keep = np.ones(len(e), bool)
        keep[1:] = (e["key"][1:] != e["key"][:-1]) | (e["sid"][1:] != e["sid"][:-1]) | (e["place"][1:] != e["place"][:-1])
        e = e[keep]
        new = np.concatenate([[True], e["key"][1:] != e["key"][:-1]]) if len(e) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(e)))
        group = np.cumsum(new) - 1
        size = length[group] if len(e) else length
        first = begin[group] if len(e) else begin
        light = e["place"] < 0
        # a common subset with a smaller set is a link
        star = light & (size > 1) & (np.arange(len(e)) != first) & (e["place"][first] == _LIGHT_SMALL)
        kinds, a, b = [np.zeros(star.sum(), np.int32)], [e["sid"][first][star]], [e["sid"][star]]
        short = ~light & (size > 1) & (size <= PAIRS)
        at = np.flatnonzero(short)
        for d in range(1, PAIRS):
            at = at[at + d < len(e)]
            at = at[group[at + d] == group[at]]
            if not len(at):
                break
            i, j = e[at], e[at + d]
            n_i, n_j = i["n"].astype(np.int64), j["n"].astype(np.int64)
            need = t.overlap(n_i, n_j)
            # at the first shingle that two prefixes share, nothing before it can add to their overlap
            most = 1 + np.minimum(n_i - 1 - i["place"], n_j - 1 - j["place"])
            ok = (need <= n_i) & (most >= need) & (n_j > x)
            kinds.append(np.where(np.maximum(i["place"], j["place"])[ok] < EARLY, 1, 3).astype(np.int32))
            a.append(np.minimum(i["sid"], j["sid"])[ok])
            b.append(np.maximum(i["sid"], j["sid"])[ok])
        kind, a, b = np.concatenate(kinds), np.concatenate(a), np.concatenate(b)
        if len(a):
            _, once = np.unique(np.stack([kind, a, b], 1), axis=0, return_index=True)
            kind, a, b = kind[once], a[once], b[once]
        out = [(kind, a, b, np.full(len(a), -1), np.full(len(a), -1))]
        # a long list: each member stands in the block pairs of its block
        for g in np.flatnonzero((length > PAIRS)):
            own = e[begin[g] : begin[g] + length[g]]
            if own["place"][0] < 0:
                continue
            n = -(-len(own) // BLOCK)
            block = np.arange(len(own)) * n // len(own)
            for p in range(n):
                for q in range(p, n):
                    # sizes ascend: blocks too far apart hold no link
                    if t.num * int(own["n"][block == q][0]) > t.den * int(own["n"][block == p][-1]):
                        continue
                    m = own[(block == p) | (block == q)]
                    # a pair is searched at the first shingle that both prefixes share: what stands too late for the smallest partner goes
                    sizes = m["n"].astype(np.int64)
                    least = np.maximum(int(sizes[0]), -(-t.num * sizes // t.den))
                    m = m[m["place"] <= sizes - t.overlap(sizes, least)]
                    if len(m) < 2:
                        continue
                    out.append((np.where(m["place"] < EARLY, 2, 4).astype(np.int32), m["key"].view(np.int64), m["sid"], np.full(len(m), p), np.full(len(m), q)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(columns[0].astype(np.int32)), *[pa.array(c.astype(np.int64)) for c in columns[1:]]], names=["kind", "a", "b", "p", "q"])

    return run


def _plausible(t: Threshold):
    """Pairs (a, b, na, nb, ca, cb, early) whose class counts allow a link.

    Sets that share o of their shingles differ in na + nb - 2 o, and no less than their class counts do; counts are kept modulo 256, whose cyclic
    distance is no more than the real one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(na), -1) for i in (4, 5))
            keep = pa.array(_apart(left, right) <= na + nb - 2 * t.overlap(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1, 6)], names=["a", "b", "early"])

    return run


def _fetch(k: int):
    """(sid, elements) of texts whose set has the id that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat a document give its set once in a task
        for batch in (part for batch in batches for part in slices(batch, 1)):
            sids, blobs = [], []
            for want, own in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), k), strict=True):
                if want not in seen and set_id(own) == want:
                    if len(seen) < SEEN:
                        seen.add(want)
                    sids.append(want)
                    blobs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], names=["sid", "elements"])

    return run


def _check(t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), "<u8"), np.frombuffer(right.as_buffer(), "<u8")
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(int((y[at] == x).sum()) >= t.overlap(len(x), len(y)) if len(y) else False)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No more than the number of shingles that sets of the class counts x and y differ in."""
    apart = x - y
    return np.minimum(apart, -apart).sum(1, dtype=np.int64)


def _hopeful(t: Threshold):
    """The members of a block pair whose class counts allow a link with another one, and the smallest set that such links may lead to."""

    def run(table: pa.Table) -> pa.Table:
        sids, n = table.column("sid").to_numpy(), table.column("n").to_numpy()
        counts = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.uint8).reshape(len(n), -1)
        mate = np.zeros(len(n), np.int64)
        alone = np.zeros(len(n), bool)
        left = np.ones(len(n), bool)
        for seed in range(len(n)):
            if not left[seed]:
                continue
            left[seed] = False
            group, done = [seed], 0
            while done < len(group):
                i, done = group[done], done + 1
                rest = np.flatnonzero(left)
                near = rest[_apart(counts[rest], counts[i]) <= n[i] + n[rest] - 2 * t.overlap(n[i], n[rest])]
                left[near] = False
                group += near.tolist()
            mate[group] = sids[group].min()
            alone[group] = len(group) == 1
        out = table.select(["list", "sid", "p", "q", "early"]).append_column("mate", pa.array(mate))
        return out.filter(pa.array(~alone))

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a bitmap from rows (part, place)."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        part, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for p in np.unique(part).tolist():
            if p not in parts:
                parts[p] = np.zeros(MARKS_PART, bool)
            parts[p][place[part == p]] = True
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])


def _only(bits: np.ndarray):
    """(doc, text) of rows (doc, text, place) whose place in the bitmap is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).fill_null(0).to_numpy()
            keep = pa.array((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["doc", "text"])

    return run


def _asked_texts(source: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of source whose doc is in asked, and few others."""
    place = F.xxhash64("doc").bitwiseAND(MARKS - 1)
    where = asked.select(place.alias("at")).select(F.expr(f"at div {MARKS_PART}").alias("part"), F.expr(f"at % {MARKS_PART}").alias("place"))
    bits = np.zeros(MARKS // 8, np.uint8)
    for row in where.repartition("part").mapInArrow(_marked, "part long, bits binary").toLocalIterator():
        bits[row["part"] * MARKS_PART // 8 : (row["part"] + 1) * MARKS_PART // 8] = np.frombuffer(row["bits"], np.uint8)
    return source.withColumn("place", place).mapInArrow(tidy(_only(bits)), "doc long, text string")


def forest(t: Threshold, sids: np.ndarray, own: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among sets."""
    n = np.array([len(x) for x in own], np.int64)
    values, index = np.unique(np.concatenate(own), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    left = np.ones(len(own), bool)
    out_a, out_b = [], []
    pieces = [index[b : b + m] for b, m in zip(begin, n, strict=True)]
    for seed in range(len(own)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            mark = np.zeros(len(values), np.int32)
            mark[pieces[i]] = 1
            shared = np.add.reduceat(mark[np.concatenate([pieces[r] for r in rest])], np.concatenate([[0], np.cumsum(n[rest])[:-1]]))
            for j in rest[shared >= t.overlap(n[i], n[rest])]:
                left[j] = False
                queue.append(j)
                out_a.append(min(sids[i], sids[j]))
                out_b.append(max(sids[i], sids[j]))
    return out_a, out_b


def _forest(t: Threshold):
    """A spanning forest of the links among the sets of a block pair."""

    def run(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("elements").combine_chunks()]
        a, b = forest(t, table.column("sid").to_numpy(), own)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _forests(t: Threshold, k: int):
    """Spanning forests of the links in the groups of rows (group, sid, text), which are in the order of groups."""

    def links(held: dict[int, np.ndarray]) -> tuple[list[int], list[int]]:
        return forest(t, np.array(list(held), np.int64), list(held.values())) if len(held) > 1 else ([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in (part for batch in batches for part in slices(batch, 2)):
            a, b = [], []
            for of, sid, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2), k), strict=True):
                if of != group:
                    for out, found in zip((a, b), links(held), strict=True):
                        out += found
                    group, held = of, {}
                # rows that share a doc_id may have other texts
                if sid not in held and set_id(own) == sid:
                    held[sid] = own
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = links(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(t: Threshold, links: DataFrame, pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the components of links, and of what pairs and members link by their sets."""

    def near(pairs: DataFrame, members: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("sid").alias("a"), F.col("elements").alias("x")), sets.select(F.col("sid").alias("b"), F.col("elements").alias("y"))
        checked = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(_check(t)), "a long, b long")
        return checked.union(members.join(sets, "sid").groupBy("list", "p", "q").applyInArrow(_forest(t), "a long, b long"))

    roots = components(links.union(near(pairs.filter("early"), members.filter("early"))))
    apart = pairs.filter("not early")
    for side in ("a", "b"):
        apart = apart.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    apart = apart.filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    placed = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = placed.groupBy("list", "p", "q").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("early").alias("all_early")).filter("least < most and not all_early")
    late = written(near(apart, members.join(mixed.select("list", "p", "q"), ["list", "p", "q"], "left_semi").select("list", "sid", "p", "q")))
    if not late.isEmpty():
        # late links join whole components: only their roots take part in the rounds
        lifted = late
        for side in ("a", "b"):
            lifted = lifted.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(side, F.coalesce(f"r{side}", side))
        joined = components(lifted.select("a", "b"))
        onward = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = written(roots.join(onward, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(joined.select("node", "root")))
    return roots


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest key that links lead to."""
    spark = docs.sparkSession
    settle(spark)
    t = Threshold(num, den)
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    profile = written(source.mapInArrow(tidy(_profile(k)), "doc long, n long, sid long, classes binary, chunk int, counts binary"))
    base = profile.filter("chunk is null").select("doc", "n", "sid")
    sketch = np.zeros(SKETCH, np.uint32)
    for row in profile.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_summed, "chunk int, counts binary").toLocalIterator():
        sketch[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<u4")
    histogram = {r["n"]: r["count"] for r in base.filter(f"n between 1 and {LARGEST_LIGHT}").groupBy("n").count().collect()}
    x = boundary(histogram, t)
    level = np.minimum(levels(sketch), 31)
    del sketch
    release()

    packed = source.select("text").mapInArrow(tidy(_postings(k, t, x, level, buckets(docs))), "bucket long, entries binary")
    met = written(packed.groupBy("bucket").applyInArrow(_meet(t, x), "kind int, a long, b long, p long, q long"))
    first = profile.filter("chunk is null and n > 0").groupBy("sid").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("classes").alias("classes"))
    first = written(first)
    pairs = met.filter("kind in (1, 3)").groupBy("a", "b").agg((F.min("kind") == 1).alias("early"))
    for side in ("a", "b"):
        pairs = pairs.join(first.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("classes").alias(f"c{side}")), side)
    pairs = written(pairs.select("a", "b", "na", "nb", "ca", "cb", "early").mapInArrow(_plausible(t), "a long, b long, early boolean"))
    members = met.filter("kind in (2, 4)").select(F.col("a").alias("list"), F.col("b").alias("sid"), "p", "q", (F.col("kind") == 2).alias("early"))
    members = members.join(first.select("sid", "n", "classes"), "sid").groupBy("list", "p", "q")
    members = written(members.applyInArrow(_hopeful(t), "list long, sid long, p long, q long, early boolean, mate long"))

    # the components of what may link: each is searched by one task, if it isn't too large for that
    hope = components(pairs.select("a", "b").union(members.select(F.col("sid").alias("a"), F.col("mate").alias("b"))))
    hope = hope.union(hope.select(F.col("root").alias("node"), "root").distinct()).join(first.select(F.col("sid").alias("node"), "n", "doc"), "node")
    most = hope.groupBy("root").agg((F.count("*") * F.sum("n") > GROUP_WORK).alias("many"), (F.sum("n") > GROUP_SIZE).alias("long"))
    asked = written(hope.join(most, "root").select("root", F.col("node").alias("sid"), "doc", F.expr("many or long").alias("large")))
    texts = _asked_texts(source, asked)
    groups = asked.filter("not large").join(texts, "doc").select("root", "sid", "text").repartition("root").sortWithinPartitions("root")
    links = written(groups.mapInArrow(tidy(_forests(t, k)), "a long, b long")).union(met.filter("kind = 0").select("a", "b"))
    wanted = asked.filter("large").select("sid", "doc")
    if wanted.isEmpty():
        roots = components(links)
    else:
        pairs = pairs.join(wanted.select(F.col("sid").alias("a")), "a", "left_semi")
        members = members.join(wanted.select("sid"), "sid", "left_semi").select("list", "sid", "p", "q", "early")
        sets = written(wanted.join(texts, "doc").select("sid", "text").mapInArrow(tidy(_fetch(k)), "sid long, elements binary"))
        roots = _linked(t, links, pairs, members, sets)
    first = first.select("sid", "doc")
    labelled = roots.join(first, roots["node"] == first["sid"]).select("sid", "root", "doc")
    roots_doc = first.select(F.col("sid").alias("root"), F.col("doc").alias("root_doc"))
    least = labelled.groupBy("root").agg(F.min("doc").alias("least")).join(roots_doc, "root").select("root", F.least("least", "root_doc").alias("component"))
    by_sid = labelled.select("sid", "root").union(least.select(F.col("root").alias("sid"), "root")).join(least, "root").select("sid", "component")
    of_set = written(first.join(by_sid, "sid", "left").select("sid", F.coalesce("component", "doc").alias("component")))
    return base.join(of_set, "sid", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
