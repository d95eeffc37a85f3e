"""Real repositories as tables: loose objects, packs, references, logs and the index.

`spark.read.format("history").option("table", "commits").load(path)` reads the metadata folder of a repository (the folder
that holds HEAD and objects, or its parent).  Tables: objects, commits, commit_parents, tree_entries, tags, refs, reflog,
index_entries, pack_objects, commit_graph, alternates.

Loose objects are dealt by their fan-out folders, packs by ranges of their index; every partition resolves the delta
chains of its own objects, with a bounded cache of bases.  Paths may be any that pyarrow's file systems know.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the storage format.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, REF_DELTA = 6, 7
OBJECTS_PER_PARTITION = 20_000
CACHED_BASES = 256

_IDENT = "struct<name:string,email:string,ts:bigint,tz:string>"
SCHEMAS = {
    "objects": "oid string, type string, size bigint, disk_size bigint, pack string, content binary",
    "commits": "oid string, tree_oid string, subject string, message string, author_name string, author_email string, author_ts bigint, author_tz string, committer_name string, committer_email string, committer_ts bigint, committer_tz string, encoding string",
    "commit_parents": "oid string, ord int, parent string",
    "tree_entries": "tree_oid string, name string, mode int, type string, oid string",
    "tags": "oid string, object_oid string, object_type string, name string, tagger string, tagger_ts bigint, message string",
    "refs": "refname string, kind string, oid string, peeled_oid string, symref string",
    "reflog": "refname string, seq bigint, old_oid string, new_oid string, name string, email string, ts bigint, tz string, message string",
    "index_entries": "path string, stage int, mode int, oid string, size bigint, mtime bigint",
    "commit_graph": "oid string, tree_oid string, parents array<string>, generation bigint, commit_ts bigint",
    "alternates": "folder string, depth int",
    "pack_objects": "pack string, oid string, type string, size bigint, size_in_pack bigint, offset bigint, depth int, base_oid string",
}


def open_folder(path: str):
    """(file system, root) of a metadata folder."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    names = {f.base_name for f in store.get_file_info(fs.FileSelector(root))}
    if "HEAD" in names and "objects" in names:
        return store, root
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.type == fs.FileType.Directory and f.base_name.startswith("."):
            inner = {g.base_name for g in store.get_file_info(fs.FileSelector(f.path))}
            if "HEAD" in inner and "objects" in inner:
                return store, f.path
    raise ValueError(f"no repository in {path}")


def _read(store, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def _walk(store, root: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File)


def parse_loose(data: bytes) -> tuple[str, bytes]:
    raw = zlib.decompress(data)
    head, _, body = raw.partition(b"\0")
    return head.split(b" ")[0].decode(), body


def parse_index(data: bytes) -> list[tuple[str, int]]:
    """(oid, offset) rows of a pack index, version 2."""
    if data[:8] != b"\xfftOc\x00\x00\x00\x02":
        raise ValueError("not a pack index of version 2")
    count = struct.unpack_from(">I", data, 8 + 255 * 4)[0]
    ids, crcs = 8 + 1024, 8 + 1024 + 20 * count
    small = crcs + 4 * count
    large = small + 4 * count
    out = []
    for i in range(count):
        at = struct.unpack_from(">I", data, small + 4 * i)[0]
        if at >> 31:
            at = struct.unpack_from(">Q", data, large + 8 * (at & 0x7FFFFFFF))[0]
        out.append((data[ids + 20 * i : ids + 20 * i + 20].hex(), at))
    return out


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target of a delta of copies and insertions."""

    def size(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = delta[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if not b & 128:
                return n, at

    source, at = size(0)
    target, at = size(at)
    if source != len(base):
        raise ValueError("a delta's base has another size")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            place = length = 0
            for i in range(4):
                if op >> i & 1:
                    place |= delta[at] << 8 * i
                    at += 1
            for i in range(3):
                if op >> (4 + i) & 1:
                    length |= delta[at] << 8 * i
                    at += 1
            length = length or 0x10000
            out += base[place : place + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("a reserved delta instruction")
    if len(out) != target:
        raise ValueError("a delta's target has another size")
    return bytes(out)


class Pack:
    """Random reads of one pack."""

    def __init__(self, store, path: str):
        self.name = path.rsplit("/", 1)[1].removesuffix(".pack")
        self.rows = parse_index(_read(store, path.removesuffix(".pack") + ".idx"))
        self.place = dict(self.rows)
        self.ids = {at: oid for oid, at in self.rows}
        self.file = store.open_input_file(path)
        ordered = sorted(self.ids)
        self.end = dict(zip(ordered, [*ordered[1:], self.file.size() - 20], strict=True))
        self.cache: OrderedDict[int, tuple[str, bytes, int]] = OrderedDict()

    def raw(self, at: int) -> tuple[int, int, int | str | None, bytes]:
        """(kind, size, base as an offset or id, data) as stored."""
        self.file.seek(at)
        data = self.file.read(self.end[at] - at)
        b, i = data[0], 1
        kind, size, shift = b >> 4 & 7, b & 15, 4
        while b & 128:
            b = data[i]
            i += 1
            size |= (b & 127) << shift
            shift += 7
        base = None
        if kind == OFFSET_DELTA:
            b = data[i]
            i += 1
            back = b & 127
            while b & 128:
                b = data[i]
                i += 1
                back = (back + 1) << 7 | b & 127
            base = at - back
        elif kind == REF_DELTA:
            base, i = data[i : i + 20].hex(), i + 20
        return kind, size, base, zlib.decompress(data[i:])

    def read(self, at: int) -> tuple[str, bytes, int]:
        """(type, content, delta depth); a chain is followed in a loop, not by recursion."""
        chain, here = [], at
        while here not in self.cache:
            kind, _, base, data = self.raw(here)
            if base is None:
                self._keep(here, (KINDS[kind], data, 0))
                break
            chain.append((here, data))
            here = self.place[base] if isinstance(base, str) else base
        kind, content, depth = self.cache[here]
        for place, delta in reversed(chain):
            content, depth = apply_delta(content, delta), depth + 1
            self._keep(place, (kind, content, depth))
        return kind, content, depth

    def _keep(self, at: int, value: tuple[str, bytes, int]) -> None:
        self.cache[at] = value
        self.cache.move_to_end(at)
        while len(self.cache) > CACHED_BASES:
            self.cache.popitem(last=False)


# records ---------------------------------------------------------------------------------------


def _person(text: str) -> tuple[str, str, int, str]:
    m = re.match(r"(.*?) ?<(.*?)>(?: (\d+))?(?: ([+-]\d{4}))?", text)
    if not m:
        return text, "", 0, ""
    ts = int(m[3] or 0)
    return m[1], m[2], ts if ts < 1 << 63 else 0, m[4] or ""


def headers(text: str) -> tuple[list[tuple[str, str]], str]:
    """Header lines (continuations joined) and the message."""
    head, _, message = text.partition("\n\n")
    out: list[tuple[str, str]] = []
    for line in head.split("\n"):
        if line.startswith(" ") and out:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + line[1:])
        elif line:
            key, _, value = line.partition(" ")
            out.append((key, value))
    return out, message


def _text(body: bytes) -> str:
    m = re.search(rb"^encoding (\S+)$", body.partition(b"\n\n")[0], re.M)
    try:
        return body.decode(m[1].decode() if m else "utf-8")
    except (LookupError, UnicodeDecodeError):
        return body.decode("latin-1")


def commit_row(oid: str, body: bytes) -> tuple:
    fields, message = headers(_text(body))
    one = dict(reversed(fields))
    return (oid, one.get("tree"), message.split("\n")[0], message, *_person(one.get("author", "")), *_person(one.get("committer", "")), one.get("encoding"))


def parent_rows(oid: str, body: bytes) -> Iterator[tuple]:
    parents = [v for k, v in headers(_text(body))[0] if k == "parent"]
    return ((oid, n, p) for n, p in enumerate(parents, 1))


def tree_rows(oid: str, body: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(body):
        blank, end = body.index(b" ", at), body.index(b"\0", at)
        mode = int(body[at:blank], 8)
        kind = "tree" if mode == 0o40000 else "commit" if mode == 0o160000 else "blob"
        yield oid, body[blank + 1 : end].decode("utf-8", "replace"), mode, kind, body[end + 1 : end + 21].hex()
        at = end + 21


def tag_row(oid: str, body: bytes) -> tuple:
    fields, message = headers(_text(body))
    one = dict(fields)
    who = _person(one.get("tagger", ""))
    return oid, one.get("object"), one.get("type"), one.get("tag"), who[0], who[2], message


def parse_staging(data: bytes) -> Iterator[tuple]:
    """Entries of an index file, versions 2 to 4."""
    signature, version, count = struct.unpack_from(">4sII", data)
    if signature != b"DIRC" or version not in (2, 3, 4):
        raise ValueError("not an index")
    at, before = 12, b""
    for _ in range(count):
        begin = at
        mtime, mode, size = struct.unpack_from(">I", data, at + 8)[0], struct.unpack_from(">I", data, at + 24)[0], struct.unpack_from(">I", data, at + 36)[0]
        oid, flags = data[at + 40 : at + 60].hex(), struct.unpack_from(">H", data, at + 60)[0]
        at += 64 if version >= 3 and flags & 0x4000 else 62
        if version == 4:
            b = data[at]
            at += 1
            cut = b & 127
            while b & 128:
                b = data[at]
                at += 1
                cut = (cut + 1) << 7 | b & 127
            end = data.index(b"\0", at)
            before = before[: len(before) - cut] + data[at:end]
            path, at = before, end + 1
        else:
            end = data.index(b"\0", at)
            path = data[at:end]
            at = begin + ((end - begin) // 8 + 1) * 8
        yield path.decode("utf-8", "replace"), flags >> 12 & 3, mode, oid, size, mtime


def ref_kind(name: str) -> str:
    for prefix, kind in (("refs/heads/", "branch"), ("refs/tags/", "tag"), ("refs/remotes/", "remote"), ("refs/", "other")):
        if name.startswith(prefix):
            return kind
    return "HEAD" if name == "HEAD" else "pseudo"


def read_refs(store, root: str) -> list[tuple]:
    """Loose references over packed ones, symbolic ones resolved; tags peeled where the packed file says so."""
    found: dict[str, list] = {}
    try:
        packed = _read(store, f"{root}/packed-refs").decode()
    except FileNotFoundError:
        packed = ""
    last = None
    for line in packed.splitlines():
        if line.startswith("^") and last:
            found[last][1] = line[1:]
        elif line and not line.startswith("#"):
            oid, last = line.split(" ", 1)
            found[last] = [oid, None, None]
    names = [*_walk(store, f"{root}/refs"), f"{root}/HEAD"]
    for path in names:
        value = _read(store, path).decode().strip()
        name = path.removeprefix(f"{root}/")
        found[name] = [None, None, value[5:].strip()] if value.startswith("ref:") else [value, None, None]
    for value in found.values():
        target, hops = value[2], 0
        while target and value[0] is None and hops < 10:
            other = found.get(target)
            if other is None:
                break
            value[0], target, hops = other[0], other[2], hops + 1
    return [(name, ref_kind(name), oid, peeled, symref) for name, (oid, peeled, symref) in sorted(found.items())]


def read_reflog(store, root: str, path: str) -> Iterator[tuple]:
    name = path.removeprefix(f"{root}/logs/")
    for n, line in enumerate(_read(store, path).decode("utf-8", "replace").splitlines(), 1):
        head, _, message = line.partition("\t")
        old, new, who = head.split(" ", 2)
        yield (name, n, old, new, *_person(who), message)


# the data source -------------------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    kind: str
    path: str
    begin: int = 0
    end: int = 0


class HistorySource(DataSource):
    """A repository's tables."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


class HistoryReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "commits")
        if self.table not in SCHEMAS:
            raise ValueError(f"unknown table: {self.table}")

    def partitions(self) -> list[Part]:
        store, root = open_folder(self.path)
        if self.table in ("commit_graph", "alternates"):
            return [Part(self.table, root)]
        if self.table == "refs":
            return [Part("refs", root)]
        if self.table == "index_entries":
            return [Part("index", f"{root}/index")]
        if self.table == "reflog":
            return [Part("log", p) for p in _walk(store, f"{root}/logs")] or [Part("none", "")]
        files = _walk(store, f"{root}/objects")
        parts = []
        if self.table != "pack_objects":
            fans = sorted({p.rsplit("/", 1)[0] for p in files if re.search(r"/[0-9a-f]{2}/[0-9a-f]{38}$", p)})
            parts += [Part("loose", p) for p in fans]
        for p in files:
            if p.endswith(".pack"):
                # the count alone: eight bytes and the last fan-out entry
                n = struct.unpack(">I", _read(store, p.removesuffix(".pack") + ".idx")[8 + 255 * 4 : 12 + 255 * 4])[0]
                parts += [Part("pack", p, i, min(n, i + OBJECTS_PER_PARTITION)) for i in range(0, n, OBJECTS_PER_PARTITION)]
        return parts or [Part("none", "")]

    def read(self, part: Part) -> Iterator[tuple]:
        store, root = open_folder(self.path)
        if part.kind == "refs":
            yield from read_refs(store, root)
        elif part.kind == "commit_graph":
            info = f"{root}/objects/info"
            chain = [p for p in _walk(store, info) if p == f"{info}/commit-graph"]
            if not chain and (lists := [p for p in _walk(store, f"{info}/commit-graphs") if p.endswith("commit-graph-chain")]):
                chain = [f"{info}/commit-graphs/graph-{name}.graph" for name in _read(store, lists[0]).decode().split()]
            yield from parse_commit_graph([_read(store, p) for p in chain])
        elif part.kind == "alternates":
            yield from alternates(store, f"{root}/objects")
        elif part.kind == "index":
            try:
                data = _read(store, part.path)
            except FileNotFoundError:
                return
            yield from parse_staging(data)
        elif part.kind == "log":
            yield from read_reflog(store, root, part.path)
        elif part.kind == "loose":
            for path in _walk(store, part.path):
                data = _read(store, path)
                kind, body = parse_loose(data)
                yield from self._rows(path[-41:].replace("/", ""), kind, body, len(data), None)
        elif part.kind == "pack":
            pack = Pack(store, part.path)
            for oid, at in pack.rows[part.begin : part.end]:
                stored = pack.end[at] - at
                kind, body, depth = pack.read(at)
                if self.table == "pack_objects":
                    base = pack.raw(at)[2]
                    yield pack.name, oid, kind, len(body), stored, at, depth, pack.ids.get(base) if isinstance(base, int) else base
                else:
                    yield from self._rows(oid, kind, body, stored, pack.name)

    def _rows(self, oid: str, kind: str, body: bytes, stored: int, pack: str | None) -> Iterator[tuple]:
        if self.table == "objects":
            yield oid, kind, len(body), stored, pack, body
        elif self.table == "commits" and kind == "commit":
            yield commit_row(oid, body)
        elif self.table == "commit_parents" and kind == "commit":
            yield from parent_rows(oid, body)
        elif self.table == "tree_entries" and kind == "tree":
            yield from tree_rows(oid, body)
        elif self.table == "tags" and kind == "tag":
            yield tag_row(oid, body)


def parse_commit_graph(layers: list[bytes]) -> Iterator[tuple]:
    """Rows of a commit graph, whose layers build on each other: parents are numbered over all of them.

    A layer is `CGPH`, version, hash version, numbers of chunks and of layers below, a table of (id, offset), and the chunks: OIDL holds the sorted ids,
    CDAT for each the tree, two parents, and 30 bits of generation before 34 bits of time; EDGE holds further parents.
    """
    none, more, last = 0x70000000, 0x80000000, 0x80000000
    ids: list[str] = []
    parsed = []
    for data in layers:
        if data[:4] != b"CGPH" or data[4] != 1:
            raise ValueError("not a commit graph")
        size = {1: 20, 2: 32}[data[5]]
        table = [struct.unpack_from(">4sQ", data, 8 + 12 * i) for i in range(data[6] + 1)]
        chunks = {name: (begin, end) for (name, begin), (_, end) in zip(table, table[1:], strict=False)}
        begin, end = chunks[b"OIDL"]
        own = [data[i : i + size].hex() for i in range(begin, end, size)]
        ids += own
        parsed.append((data, size, chunks, own))
    for data, size, chunks, own in parsed:
        at = chunks[b"CDAT"][0]
        for oid in own:
            first, second, high, low = struct.unpack_from(">IIII", data, at + size)
            parents = [ids[first]] if first != none else []
            if second & more and second != none:
                edge = chunks[b"EDGE"][0] + 4 * (second & ~more)
                while True:
                    (value,) = struct.unpack_from(">I", data, edge)
                    parents.append(ids[value & ~last])
                    edge += 4
                    if value & last:
                        break
            elif second != none:
                parents.append(ids[second])
            yield oid, data[at : at + size].hex(), parents, high >> 2, (high & 3) << 32 | low
            at += size + 16


def alternates(store, objects: str, most: int = 5) -> Iterator[tuple[str, int]]:
    """(folder, depth) of an object folder, at depth 0, and of those that it borrows from, each once."""
    seen, todo = set(), [(objects, 0)]
    while todo:
        folder, depth = todo.pop(0)
        if folder in seen or depth > most:
            continue
        seen.add(folder)
        yield folder, depth
        try:
            lines = _read(store, f"{folder}/info/alternates").decode().splitlines()
        except FileNotFoundError:
            continue
        for line in lines:
            if line and not line.startswith("#"):
                todo.append((line if line.startswith("/") else posixpath.normpath(f"{folder}/{line}"), depth + 1))


def load_all(spark: SparkSession, paths: dict[str, str], table: str = "commits") -> DataFrame:
    """One table of several repositories, with their names in `repo`."""
    out = None
    for name, path in paths.items():
        rows = spark.read.format("history").option("table", table).load(path).withColumn("repo", F.lit(name))
        out = rows if out is None else out.union(rows)
    if out is None:
        raise ValueError("no repository is named")
    return out


def objects_with_alternates(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a repository and of those that it borrows from, with `source`, the folder; an object that several hold is taken from the nearest."""
    folders = spark.read.format("history").option("table", "alternates").load(path).orderBy("depth", "folder").collect()
    out = None
    for r in folders:
        rows = spark.read.format("history").option("table", "objects").load(posixpath.dirname(r["folder"])).withColumn("source", F.lit(r["folder"])).withColumn("depth", F.lit(r["depth"]))
        out = rows if out is None else out.union(rows)
    nearest = out.groupBy("oid").agg(F.min(F.struct("depth", "source")).alias("x"))
    return out.join(nearest.select("oid", "x.*"), ["oid", "depth", "source"], "left_semi").drop("depth").dropDuplicates(["oid"])


def register(spark: SparkSession) -> None:
    """Makes format("history") known to a session."""
    spark.dataSource.register(HistorySource)


# writing, for fixtures and exports ---------------------------------------------------------------


def loose_object(kind: str, body: bytes) -> tuple[str, bytes]:
    """(oid, compressed file) of an object."""
    raw = f"{kind} {len(body)}".encode() + b"\0" + body
    return hashlib.sha1(raw).hexdigest(), zlib.compress(raw)
