"""WARC writing and reading with boundary-chain verification.

Writing: one record a row.  Of rows with equal payloads (by SHA-1) of at least revisit_from bytes the one with the smallest
key is a `response`; the others are `revisit` records without a body that name it.  Every task writes one archive under a
name of its own attempt and renames it at the end.

Reading: archives are dealt out in byte blocks.  A task finds every place in its block that looks like a record (the magic
bytes may as well stand inside a payload), reads its header, and takes the place of its successor from its length.  Candidates
whose successors stay inside the block are followed at once, so that each candidate is emitted with the first place behind the
block that its chain reaches.  Pointer jumping over these (file, place) -> (file, place) rows, doubling in each round, then
finds the entry place of each block that is reachable from the file's start; records are read from these entries only.
Candidates inside payloads are never reached.

Defined results: a null payload is empty; rows that repeat the response's key and payload are responses as well; a null key is
written and read as null, and is a response only where no row of equal payload has a key; a null url is read back as ''; headers may have any
length; empty tables give no archives; a chain that doesn't reach the end of its file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import math
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, tidy, written

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Bytes of a block of reading, and of the first look at a header: longer ones are read on.
BLOCK = 4 << 20
HEADER = 8 << 10
#: What stands for itself in a url, besides letters, digits and _.-~
URL_SAFE = ":/?#[]@!$&()*+,;=~'"
#: A fixed date, so that archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with refers_to a revisit without a body."""
    body = payload if refers_to is None else b""
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{key}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return MAGIC + "\r\n".join(lines).encode() + END + body + END


def parse_header(head: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of the header that head begins with; None if it isn't one."""
    stop = head.find(END)
    if not head.startswith(MAGIC) or stop < 0:
        return None
    try:
        fields = dict(line.split(": ", 1) for line in head[len(MAGIC) : stop].decode().split("\r\n"))
        if int(fields["Content-Length"]) < 0:
            return None
    except (ValueError, KeyError):
        return None
    return fields, stop + len(END)


def read_header(stream, at: int, size: int, data: bytes = b"") -> tuple[dict[str, str], int] | None:
    """Fields and length of the header at a place of a file of `size` bytes; data are bytes from there on that are known already.

    What has no end mark is read on, twice as much each time, up to the end of the file.
    """
    while True:
        if END in data or at + len(data) >= size:
            return parse_header(data)
        stream.seek(at)
        data = stream.read(min(max(HEADER, 2 * len(data)), size - at))
        if not data.startswith(MAGIC):
            return None


def write_archives(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0) -> DataFrame:
    """Writes archives; returns their manifest (folder, name, bytes), itself written.

    The first of each payload comes from an aggregate over digests, which combines before its shuffle; rows
    then meet it in a plain equi-join, whose hot digests adaptive execution splits.
    """
    folder = folder or shared_dir(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    first = rows.filter(F.octet_length("payload") >= revisit_from).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([zip_.compress(p) for p in batch.column(3).to_pylist()], pa.binary())], names=["sha", "key", "url", "payload"])

    # payloads are compressed for the shuffle
    small = rows.select("sha", "key", "url", "payload").mapInArrow(packed, "sha binary, key long, url string, payload binary")
    joined = small.join(first, "sha", "left").select("key", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        unzip = zstandard.ZstdDecompressor()
        context = TaskContext.get()
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = f"pages-{context.partitionId():06d}.warc"
        own = f"{root}/.{name}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        size = 0
        with files.open_output_stream(own) as out:
            for batch in batches:
                for k, u, body, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = unzip.decompress(body)
                    data = record(k, u, body, None if f is None or f == k else f)
                    size += len(data)
                    out.write(data)
        if not size:
            files.delete_file(own)
            return
        files.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"folder": [folder], "name": [name], "bytes": [size]})

    return written(joined.mapInArrow(tidy(run), "folder string, name string, bytes long"))


def _blocks(manifest: DataFrame) -> DataFrame:
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(BLOCK).cast("long"))
    return manifest.select("folder", "name", "bytes", F.explode(begins).alias("begin")).repartition(parts)


def candidates(manifest: DataFrame) -> DataFrame:
    """(name, place, exit): every candidate record and where its chain leaves its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, root = _filesystem(row["folder"])
                begin, size = row["begin"], row["bytes"]
                end = min(begin + BLOCK, size)
                with store.open_input_file(f"{root}/{row['name']}") as stream:
                    stream.seek(begin)
                    data = stream.read(end - begin + HEADER)
                    successor = {}
                    at = data.find(MAGIC)
                    while 0 <= at < end - begin:
                        stop = data.find(END, at)
                        known = data[at : stop + len(END) if stop >= 0 else len(data)]
                        parsed = read_header(stream, begin + at, size, known)
                        if parsed:
                            after = begin + at + parsed[1] + int(parsed[0]["Content-Length"]) + len(END)
                            if after <= size:
                                successor[begin + at] = after
                        at = data.find(MAGIC, at + 1)
                leaves: dict[int, int] = {}
                for place in sorted(successor, reverse=True):
                    after = successor[place]
                    if after >= end:
                        leaves[place] = after
                    elif after in leaves:
                        leaves[place] = leaves[after]
                    elif after not in successor:  # the chain breaks inside the block
                        leaves[place] = -1
                    else:
                        leaves[place] = leaves[after]
                if leaves:
                    yield pa.RecordBatch.from_pydict({"name": [row["name"]] * len(leaves), "place": list(leaves), "leaves": list(leaves.values())})

    return _blocks(manifest).mapInArrow(run, "name string, place long, leaves long")


def reachable(manifest: DataFrame) -> DataFrame:
    """(folder, name, bytes, place): the entry of each block that the chain from the file's start reaches.

    The joins are by (name, place) and merge sorted rows: no side is broadcast, as each grows with the archives.
    """
    rounds = manifest.agg(F.max("bytes")).collect()[0][0] or 1
    rounds = math.ceil(math.log2(max(1, math.ceil(rounds / BLOCK)))) + 1
    jumps = written(candidates(manifest))
    reached = manifest.select("name", F.lit(0).cast("long").alias("place"))
    for k in range(rounds):
        hop = jumps.filter("leaves >= 0")
        reached = written(reached.union(reached.join(hop.hint("merge"), ["name", "place"]).select("name", F.col("leaves").alias("place"))).distinct())
        if k + 1 < rounds:
            onward = jumps.select("name", F.col("place").alias("leaves"), F.col("leaves").alias("onward"))
            jumps = written(jumps.join(onward.hint("merge"), ["name", "leaves"]).select("name", "place", F.col("onward").alias("leaves")).filter("leaves >= 0"))
    placed = reached.join(manifest.hint("merge"), "name")
    broken = manifest.join(placed.filter("place = bytes"), "name", "left_anti").select("name").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0][0]}: the chain of records doesn't reach the end of the file")
    return placed.filter("place < bytes").select("folder", "name", "bytes", "place")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row a verified record: key, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits)."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    schema = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                store, root = _filesystem(row["folder"])
                at, end = row["place"], min((row["place"] // BLOCK + 1) * BLOCK, row["bytes"])
                out, held = [], 0
                with store.open_input_file(f"{root}/{row['name']}") as stream:
                    while at < end:
                        parsed = read_header(stream, at, row["bytes"])
                        if parsed is None:
                            raise ValueError(f"{row['name']}: no record at {at}")
                        fields, head = parsed
                        length = int(fields["Content-Length"])
                        stream.seek(at + head)
                        body = stream.read(length)
                        kind = fields["WARC-Type"]
                        sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest(body) != sha:
                            raise ValueError(f"{row['name']}: the payload at {at} doesn't match its digest")
                        refers = fields.get("WARC-Refers-To")
                        page = lambda x: None if "None" in x else int(x.removeprefix("<urn:x-page:").removesuffix(">"))
                        size = length if kind == "response" else int(fields["X-Payload-Bytes"])
                        out.append((page(fields["WARC-Record-ID"]), urllib.parse.unquote(fields["WARC-Target-URI"]), size, sha, kind, refers and page(refers), body if kind == "response" else None))
                        held += length
                        at += head + length + len(END)
                        if held > 4 << 20 or len(out) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return reachable(manifest).repartition(parts).mapInArrow(tidy(run), schema)
