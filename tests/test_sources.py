"""Commit graphs, alternates, several repositories, symbolic links, mailboxes, mailmaps and JSON programs on small fixtures."""

import json
import struct

import pytest

from palimpsest.functions import convert, linediff
from palimpsest.operators import log, trees
from palimpsest.sources import repository as repo
from palimpsest.sources import streams


def graph_file(rows, below=()):
    """A commit graph layer of (oid, tree, parents, generation, ts) rows over the ids of the layers below."""
    ids = sorted(r[0] for r in rows)
    number = {oid: n for n, oid in enumerate([*below, *ids])}
    data, edges = b"", b""
    for oid, tree, parents, generation, ts in sorted(rows):
        first = number[parents[0]] if parents else 0x70000000
        second = 0x70000000 if len(parents) < 2 else number[parents[1]] if len(parents) == 2 else 0x80000000 | len(edges) // 4
        if len(parents) > 2:
            edges += b"".join(struct.pack(">I", number[p] | (0x80000000 if p == parents[-1] else 0)) for p in parents[1:])
        data += bytes.fromhex(tree) + struct.pack(">IIII", first, second, generation << 2 | ts >> 32, ts & 0xFFFFFFFF)
    chunks = [(b"OIDL", b"".join(map(bytes.fromhex, ids))), (b"CDAT", data), (b"EDGE", edges)]
    at = 8 + 12 * (len(chunks) + 1)
    table = b""
    for name, body in chunks:
        table += struct.pack(">4sQ", name, at)
        at += len(body)
    return b"CGPH" + bytes([1, 1, len(chunks), len(below) > 0]) + table + struct.pack(">4sQ", b"", at) + b"".join(b for _, b in chunks)


def test_commit_graph():
    oid = lambda n: f"{n:040x}"
    low = [(oid(9), oid(100), [], 1, 5), (oid(3), oid(101), [oid(9)], 2, (1 << 33) + 7)]
    high = [(oid(1), oid(102), [oid(3), oid(9)], 3, 20), (oid(2), oid(103), [oid(3), oid(9), oid(1)], 4, 30)]
    got = list(repo.parse_commit_graph([graph_file(low), graph_file(high, [oid(3), oid(9)])]))
    assert sorted(got) == sorted((o, t, p, g, ts) for o, t, p, g, ts in low + high)
    with pytest.raises(ValueError):
        list(repo.parse_commit_graph([b"CGPX\1\1\0\0"]))


def repository_at(root, names):
    (root / "objects/info").mkdir(parents=True)
    (root / "HEAD").write_text("ref: refs/heads/main\n")
    for name in names:
        oid, data = repo.loose_object("blob", name.encode())
        (root / "objects" / oid[:2]).mkdir(exist_ok=True)
        (root / "objects" / oid[:2] / oid[2:]).write_bytes(data)


def test_alternates_and_several_repositories(spark, tmp_path):
    repo.register(spark)
    for name, blobs in (("a", "xy"), ("b", "yz"), ("c", "w")):
        repository_at(tmp_path / name, blobs)
    (tmp_path / "a/objects/info/alternates").write_text(f"../../b/objects\n# no\n{tmp_path}/c/objects\n")
    (tmp_path / "b/objects/info/alternates").write_text("../../a/objects\n")
    oid = {c: repo.loose_object("blob", c.encode())[0] for c in "wxyz"}
    got = {r["oid"]: r["source"] for r in repo.objects_with_alternates(spark, str(tmp_path / "a")).collect()}
    assert got == {oid["x"]: f"{tmp_path}/a/objects", oid["y"]: f"{tmp_path}/a/objects", oid["z"]: f"{tmp_path}/b/objects", oid["w"]: f"{tmp_path}/c/objects"}
    both = repo.load_all(spark, {n: str(tmp_path / n) for n in "ab"}, "objects")
    assert sorted((r["repo"], r["oid"]) for r in both.collect()) == sorted([("a", oid["x"]), ("a", oid["y"]), ("b", oid["y"]), ("b", oid["z"])])


def test_symbolic_links(spark):
    paths = [("d/f", None), ("d/e/g", None), ("l", "d"), ("d/up", "../top"), ("top", None), ("m", "l/e"), ("x", "y"), ("y", "x"), ("gone", "nowhere"), ("out", "../../z"), ("abs", "/z")]
    df = spark.createDataFrame([(1, p, t) for p, t in paths], "root int, path string, link string")
    asked = {"d/f": ("found", "d/f"), "l/f": ("found", "d/f"), "l/up": ("found", "top"), "m/g": ("found", "d/e/g"), "m": ("found", "d/e"), "x/a": ("loop", None), "gone": ("dangling", None), "out": ("outside", None), "abs/q": ("outside", None), "no": ("missing", None), "top/q": ("not_dir", None)}
    rows = spark.createDataFrame([(1, p) for p in asked], "root int, path string")
    got = {r["path"]: (r["result"], r["found"]) for r in trees.follow_links(rows, df, most_hops=5).collect()}
    assert got == asked


def test_mailboxes(spark, tmp_path):
    (tmp_path / "m.mbox").write_text("From a@b Thu Jan 1 2024\nFrom: A B <a@b>\nSubject: [PATCH] one\nDate: now\n\nbody\n---\ndiff -x\nFrom c@d Thu Jan 1 2024\nFrom: c@d\nSubject: two\n\n>From x\n")
    got = streams.mails(streams.whole_texts(spark, str(tmp_path))).orderBy("n").collect()
    assert [(r["n"], r["name"], r["email"], r["subject"], r["message"].strip()) for r in got] == [(1, "A B", "a@b", "one", "body"), (2, "", "c@d", "two", "From x")]
    raw = spark.createDataFrame([("p", ":100644 100755 abc def M\tx\n:100644 100644 abc abc R90\ta\tb\n")], "path string, text string")
    assert [(r["status"], r["score"], r["old_path"], r["new_path"]) for r in streams.raw_pairs(raw).collect()] == [("M", 0, "x", "x"), ("R", 90, "a", "b")]


def test_mailmap_lines(spark):
    lines = ["# a", "Proper <c@x>", "<p@x> <c@y>", "Proper P <p@x> <c@z>  # note", "Proper P <p@x> Old <c@w>", "nothing"]
    rows = log.parse_mailmap(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [tuple(r) for r in rows] == [("c@x", None, "Proper", None), ("c@y", None, None, "p@x"), ("c@z", None, "Proper P", "p@x"), ("c@w", "Old", "Proper P", "p@x")]


def test_json_programs():
    doc = json.dumps({"a": [{"n": 1, "s": "x"}, {"n": 5, "s": "y"}], "b": None, "c": "t"})
    for program, expected in [(".a[].n", "[1,5]"), (".a | map(.n) | add", "6"), (".a[] | select(.n > 2) | .s", '"y"'), (".b.z", "null"), ("keys", '["a","b","c"]'), (".a | length", "2"), (".a[-1].s", '"y"'), ("select(.c == \"u\")", "null"), ("[.c, .b]", '["t",null]'), (".a[0].n + 2 * 3", "7"), ("(.b == null) and (.c | not)", "false")]:
        assert convert.JsonProgram(program)(doc) == expected
    for bad in (".a[", "foo", "select(.a"):
        with pytest.raises((ValueError, IndexError)):
            convert.JsonProgram(bad)


def test_file_merges(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nB\nc", "a\nb\nC"), (2, "a", "b", "c")], "k int, base string, ours string, theirs string")
    got = {r["k"]: (r["conflicts"], r["merged"]) for r in linediff.merged_files(rows, "k").collect()}
    assert got[1] == (0, "a\nB\nC") or got[1][0] == 1
    assert got[2] == (1, "<<<<<<< ours\nb\n=======\nc\n>>>>>>> theirs")
