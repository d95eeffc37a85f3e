"""The repository source over a hand-made repository: loose objects, a pack with deltas, references, logs, the index."""

import hashlib
import struct
import zlib

import pytest

from palimpsest.sources import repository as repo


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def packed(kind, size, extra, data):
    head = [(kind << 4) | size & 15]
    size >>= 4
    while size:
        head[-1] |= 128
        head.append(size & 127)
        size >>= 7
    return bytes(head) + extra + zlib.compress(data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    meta = root / ".meta"
    for d in ("objects/pack", "refs/heads", "refs/tags", "logs/refs/heads"):
        (meta / d).mkdir(parents=True)
    made = {}

    def loose(name, kind, body):
        oid, data = repo.loose_object(kind, body)
        path = meta / "objects" / oid[:2]
        path.mkdir(exist_ok=True)
        (path / oid[2:]).write_bytes(data)
        made[name] = oid
        return oid

    blob = loose("blob", "blob", b"hello\n")
    tree = loose("tree", "tree", b"100644 a.txt\0" + bytes.fromhex(blob) + b"40000 d\0" + bytes.fromhex(blob))
    who = "A B <a@b> 1000 +0130"
    one = loose("one", "commit", f"tree {tree}\nauthor {who}\ncommitter {who}\n\nfirst\n\nbody\n".encode())
    two = loose("two", "commit", f"tree {tree}\nparent {one}\nauthor {who}\ncommitter C <c@d> 2000 -0700\nencoding latin-1\n\nsecond é\n".encode("latin-1"))
    tag = loose("tag", "tag", f"object {two}\ntype commit\ntag v1\ntagger {who}\n\nrelease\n".encode())
    base = b"".join(b"line %d\n" % i for i in range(100))
    target = base[:300] + b"inserted" + base[300:]
    delta = varint(len(base)) + varint(len(target)) + bytes([0b10010000 | 0b100000, 300 & 255, 300 >> 8]) + bytes([8]) + b"inserted"
    rest = len(base) - 300
    delta += bytes([0b10110011, 300 & 255, 300 >> 8, rest & 255, rest >> 8])
    oid = lambda b: hashlib.sha1(b"blob %d\0" % len(b) + b).hexdigest()
    body = b"PACK" + struct.pack(">II", 2, 2)
    first = len(body)
    body += packed(3, len(base), b"", base)
    second = len(body)
    back = second - first
    offset = [back & 127]
    while back := back >> 7:
        back -= 1
        offset.insert(0, back & 127 | 128)
    body += packed(6, len(delta), bytes(offset), delta)
    body += hashlib.sha1(body).digest()
    rows = sorted([(oid(base), first), (oid(target), second)])
    fan = [sum(int(o[:2], 16) <= i for o, _ in rows) for i in range(256)]
    index = b"\xfftOc" + struct.pack(">I", 2) + struct.pack(">256I", *fan) + b"".join(bytes.fromhex(o) for o, _ in rows) + bytes(8) + b"".join(struct.pack(">I", a) for _, a in rows)
    (meta / "objects/pack/pack-x.pack").write_bytes(body)
    (meta / "objects/pack/pack-x.idx").write_bytes(index)
    made |= {"base": oid(base), "target": oid(target)}
    (meta / "HEAD").write_text("ref: refs/heads/main\n")
    (meta / "refs/heads/main").write_text(two + "\n")
    (meta / "packed-refs").write_text(f"# pack-refs\n{one} refs/heads/main\n{tag} refs/tags/v1\n^{two}\n")
    (meta / "logs/refs/heads/main").write_text(f"{'0' * 40} {one} {who}\tcommit (initial): first\n{one} {two} {who}\tcommit: second\n")
    entry = struct.pack(">10I20sH", 0, 0, 77, 0, 0, 0, 0o100644, 0, 0, 6, bytes.fromhex(blob), 5) + b"a.txt"
    entry += bytes(8 - len(entry) % 8)
    (meta / "index").write_bytes(b"DIRC" + struct.pack(">II", 2, 1) + entry + bytes(20))
    return str(root), made


def read(spark, folder, table):
    repo.register(spark)
    return spark.read.format("history").option("table", table).load(folder[0]).collect()


def test_objects(spark, folder):
    made = folder[1]
    got = {r["oid"]: r for r in read(spark, folder, "objects")}
    assert set(got) == set(made.values())
    assert bytes(got[made["target"]]["content"])[300:308] == b"inserted" and got[made["base"]]["pack"] == "pack-x"
    for oid, r in got.items():
        assert hashlib.sha1(f"{r['type']} {r['size']}".encode() + b"\0" + bytes(r["content"])).hexdigest() == oid


def test_commits_trees_and_tags(spark, folder):
    made = folder[1]
    commits = {r["oid"]: r for r in read(spark, folder, "commits")}
    assert commits[made["one"]]["subject"] == "first" and commits[made["two"]]["subject"] == "second é"
    assert (commits[made["two"]]["committer_ts"], commits[made["two"]]["committer_tz"], commits[made["one"]]["author_name"]) == (2000, "-0700", "A B")
    assert [(r["oid"], r["ord"], r["parent"]) for r in read(spark, folder, "commit_parents")] == [(made["two"], 1, made["one"])]
    assert {(r["name"], r["mode"], r["type"]) for r in read(spark, folder, "tree_entries")} == {("a.txt", 0o100644, "blob"), ("d", 0o40000, "tree")}
    assert [(r["name"], r["object_oid"]) for r in read(spark, folder, "tags")] == [("v1", made["two"])]


def test_refs_logs_index_and_packs(spark, folder):
    made = folder[1]
    refs = {r["refname"]: r for r in read(spark, folder, "refs")}
    assert refs["refs/heads/main"]["oid"] == refs["HEAD"]["oid"] == made["two"] and refs["HEAD"]["symref"] == "refs/heads/main"
    assert refs["refs/tags/v1"]["peeled_oid"] == made["two"] and refs["refs/tags/v1"]["kind"] == "tag"
    assert [(r["seq"], r["new_oid"], r["message"]) for r in read(spark, folder, "reflog")] == [(1, made["one"], "commit (initial): first"), (2, made["two"], "commit: second")]
    assert [(r["path"], r["stage"], r["oid"], r["size"], r["mtime"]) for r in read(spark, folder, "index_entries")] == [("a.txt", 0, made["blob"], 6, 77)]
    assert {(r["oid"], r["depth"], r["base_oid"]) for r in read(spark, folder, "pack_objects")} == {(made["base"], 0, None), (made["target"], 1, made["base"])}


def test_no_repository(tmp_path):
    with pytest.raises(ValueError):
        repo.open_folder(str(tmp_path))
