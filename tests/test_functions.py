"""Pattern compilers and scalar functions."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import patterns, scalars, sketches
from palimpsest.operators.objects import object_filter
from palimpsest.operators.refs import format_column


@pytest.mark.parametrize(
    ("pattern", "text", "fits"),
    [
        ("foo", "foo", True), ("foo", "bar", False), ("f*", "foo", True), ("*", "a/b", False), ("**", "a/b", True), ("**/foo", "foo", True),
        ("**/foo", "a/b/foo", True), ("a/**", "a/b/c", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a?c", "a/c", False),
        ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[!a-c]x", "/x", False), (r"\*", "*", True), (r"\*", "a", False), ("[]x]", "]", True), ("a[", "a[", True),
    ],
)
def test_globs(pattern, text, fits):
    assert bool(re.search(patterns.glob_regex(pattern), text)) == fits


def rows(spark, column, values, name="x"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return [r[0] for r in df.select(column).collect()]


def test_an_excluding_pathspec_alone_takes_the_rest(spark):
    files = ["file", "sub/file", "sub/sub/file", "sub/file2", "sub/sub/sub/file", "sub2/file"]
    alone = rows(spark, patterns.pathspec(F.col("x"), [":(exclude)sub"]), files)
    assert alone == rows(spark, patterns.pathspec(F.col("x"), [".", ":!sub"]), files) == [True, False, False, False, False, True]


def test_pathspec_words(spark):
    files = ["A/b", "a/B", "a*c", "abc"]
    assert rows(spark, patterns.pathspec(F.col("x"), [":(icase)a"]), files) == [True, True, False, False]
    assert rows(spark, patterns.pathspec(F.col("x"), [":(literal)a*c"]), files) == [False, False, True, False]
    assert rows(spark, patterns.pathspec(F.col("x"), [":(glob)a*"]), files) == [False, True, True, True]


def test_ignore_rules_last_match_wins(spark):
    got = rows(spark, patterns.ignore_rules(F.col("x"), ["*.log", "!keep.log", "build/", "/top"]), ["a.log", "d/keep.log", "build/x", "build", "top", "d/top"])
    assert got == [True, False, True, False, True, False]


def test_grep_expressions(spark):
    e = patterns.parse_grep(["-e", "a", "--and", "(", "-e", "b", "--or", "--not", "-e", "c", ")"])
    assert e == ("and", "a", ("or", "b", ("not", "c")))
    assert rows(spark, patterns.grep_expression(F.col("x"), e), ["ab", "ac", "a", "b"]) == [True, False, True, False]
    with pytest.raises(ValueError):
        patterns.parse_grep(["("])


def test_murmur3_vectors():
    assert [sketches.murmur3(x, 0) for x in (b"", b"Hello world!", b"The quick brown fox jumps over the lazy dog")] == [0, 0x627B0C2C, 0x2E4FF723]


def test_filter_of_the_empty_path():
    assert [sketches.murmur3(b"", s) for s in sketches.SEEDS][0] == 0x5615800C
    assert sketches.build_filter({""}) == bytes([0x11, 0x11])


def test_filters_have_no_false_negatives():
    paths = {f"d{i % 7}/f{i}" for i in range(200)}
    data = sketches.build_filter(paths)
    assert all(sketches.may_hold(data, p) for p in paths) and sketches.may_hold(data, "d3")
    assert sum(sketches.may_hold(data, f"no{i}") for i in range(500)) < 25
    assert sketches.build_filter({f"f{i}" for i in range(600)}) == b"\xff"


def test_idents(spark):
    got = rows(spark, scalars.ident(F.col("x")), ["A B <a@b> 12 +0130", "A <a> totally_bogus -0700", "A <a> 18446744073709551617 -0700", "<> 5 +0000"])
    assert [(r["name"], r["email"], r["ts"], r["tz_secs"], r["ts_status"]) for r in got] == [("A B", "a@b", 12, 5400, "Valid"), ("A", "a", 0, -25200, "NonNumeric"), ("A", "a", 0, -25200, "Overflow"), ("", "", 5, 0, "Valid")]


def test_versions_sort_by_value(spark):
    names = ["v1.10", "v1.9", "v1.9-rc1", "v2", "v1.x"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r["x"] for r in df.orderBy(scalars.version_key(F.col("x"))).collect()] == ["v1.9", "v1.9-rc1", "v1.10", "v1.x", "v2"]


def test_messages(spark):
    assert rows(spark, scalars.strip_comments(F.col("x")), ["# a\n\n b  \n\n\n\nc\n# d\n", "#\n", ""]) == [" b\n\nc", "", ""]
    assert rows(spark, scalars.revert_subject(F.col("x")), ["a", 'Revert "a"', 'Reapply "a"']) == ['Revert "a"', 'Reapply "a"', 'Revert "Reapply "a""']
    got = rows(spark, scalars.trailers(F.col("x")), ["s\n\nb\n\nA: 1\nB-c: 2", "s\n\nA: 1\nno", "A: 1"])
    assert [[(t["key"], t["value"]) for t in x] for x in got] == [[("A", "1"), ("B-c", "2")], [], []]
    assert rows(spark, scalars.annotation(F.col("x"), 2), ["\n a \n\nb\nc"]) == ["a b"]


def test_object_ids(spark):
    assert rows(spark, scalars.object_id("blob", F.col("x")), ["", "hello\n"]) == ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "ce013625030ba8dba906f756967f9e9ca394464a"]


def test_formats_and_filters(spark):
    df = spark.createDataFrame([("refs/heads/a", "1234567890")], "refname string, oid string")
    atoms = {"refname": F.col("refname"), "objectname": F.col("oid")}
    assert df.select(format_column("%(refname:short)%09%(objectname:short)%%%(refname:lstrip=1)", atoms)).collect()[0][0] == "a\t1234567%heads/a"
    with pytest.raises(ValueError):
        format_column("%(nothing)", atoms)
    objects = spark.createDataFrame([("blob", 5, 1), ("blob", 4096, 1), ("tree", 1, 0)], "type string, size long, depth int")
    assert objects.filter(object_filter("combine:blob:limit=4k+object:type=blob")).count() == 1
    assert objects.filter(object_filter("blob:none")).count() == 1


def test_quotes_sizes_and_prefixes(spark):
    assert rows(spark, scalars.c_quoted(F.col("x")), ["a", 'a"b', "a\tb"]) == ["a", '"a\\"b"', '"a\\tb"']
    assert rows(spark, scalars.parse_size(F.col("x")), ["12", "3k", "1M", "x"]) == [12, 3072, 1 << 20, None]
    assert rows(spark, scalars.path_prefixes(F.col("x")), ["a/b/c"]) == [["a", "a/b", "a/b/c"]]
    assert rows(spark, scalars.valid_ref_name(F.col("x")), ["refs/heads/a", "a", "refs/a..b", "refs/.a", "refs/a.lock"]) == [True, False, False, False, False]
