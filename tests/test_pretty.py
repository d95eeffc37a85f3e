"""The log format language, conversions and rules on single rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codecs, convert, patterns, scalars
from palimpsest.operators import diff, pretty
from palimpsest.operators import refs as formats


@pytest.fixture(scope="module")
def commit(spark):
    message = "\nFix the\n parser now\n\nbody one\n\nbody two\n\n"
    row = ("a" * 40, "b" * 40, ["c" * 40, "d" * 40], "Ann", "ann@x.org", 86400, 3600, "Bob", "bob@y.org", 90000, -1800, message, [])
    schema = "oid string, tree string, parents array<string>, author_name string, author_email string, author_ts long, author_tz int, committer_name string, committer_email string, committer_ts long, committer_tz int, message string, decorations array<string>"
    return spark.createDataFrame([row], schema)


def test_placeholders(commit):
    wanted = {
        "%h %t %p": "aaaaaaa bbbbbbb ccccccc ddddddd",
        "%an <%ae> %al": "Ann <ann@x.org> ann",
        "%ad": "Fri Jan 2 01:00:00 1970 +0100",
        "%ai|%aI|%at|%as": "1970-01-02 01:00:00 +0100|1970-01-02T01:00:00+01:00|86400|1970-01-02",
        "%cD": "Fri, 2 Jan 1970 00:30:00 -0030",
        "%s": "Fix the parser now",
        "%f": "Fix-the-parser-now",
        "%b": "body one\n\nbody two\n",
        "%d|%D": "|",
        "%%%x41%n": "%A\n",
        "%<(6)%an|%>(6)%an|%><(7)%an": "Ann   |   Ann|  Ann  ",
        "%<(8,trunc)%s|%<(8,ltrunc)%s|%<(8,mtrunc)%s": "Fix th..|..er now|Fix..now",
        "%C(red)%an%Creset": "Ann",
        "%+d% an%+an": " Ann\nAnn",
        "%ar": "2 days ago",
    }
    got = commit.select(*[pretty.pretty(t, now=3 * 86400).alias(str(i)) for i, t in enumerate(wanted)]).collect()[0]
    assert {t: got[str(i)] for i, t in enumerate(wanted)} == wanted
    assert commit.select(pretty.pretty("medium")).collect()[0][0].startswith(f"commit {'a' * 40}\nMerge: ccccccc ddddddd\nAuthor: Ann <ann@x.org>\nDate:   Fri Jan 2 01:00:00 1970 +0100\n\n")


def test_people_and_messages(commit):
    m = F.col("message")
    conditions = [
        pretty.person_matches("author", "^Ann <"),
        pretty.person_matches("committer", "BOB", icase=True),
        pretty.message_matches(["^ parser", "nothing"], m),
        pretty.message_matches(["^ parser", "nothing"], m, all_match=True),
        pretty.message_matches(["nothing"], m, invert=True),
    ]
    assert list(commit.select(*conditions).collect()[0]) == [True, True, True, False, True]


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_exact_dates(spark):
    texts = ["@12345", "1234567 +0100", "1970-01-02", "1970-01-01T00:00:10Z", "1970-01-01 01:00:00 +0100", "1970/1/1 00:00", "1971-02-29", "1972-02-29", "1970-13-01", "yesterday", None, "1970-01-01 25:00:00"]
    assert values(spark, texts, convert.exact_seconds) == [12345, 1234567, 86400, 10, 0, 0, None, 68169600, None, None, None, None]


def test_ignore_and_attribute_rules(spark):
    paths = ["doc/frotz/a", "doc/a.txt", "a/doc/frotz", "keep/x.log", "x.log", "#x", "deep/build/y/z", "build", "build/"]
    rules = ["doc/frotz/", "*.log", "!keep/*.log", r"\#x", "build/"]
    assert values(spark, paths, lambda c: patterns.ignore_rules(c, rules)) == [True, False, False, False, True, True, True, False, True]
    given = ["*.c diff=cpp text", "/d/* -text", "d/b.h !text diff"]
    got = values(spark, ["a.c", "d/a.c", "b.h", "d/b.h"], lambda c: F.to_json(F.struct(*[v.alias(k) for k, v in patterns.path_attributes(c, given, ["diff", "text"]).items()])))
    assert got == ['{"diff":"cpp","text":"set"}', '{"diff":"cpp","text":"unset"}', "{}", '{"diff":"set"}']


def test_formats_and_quoting(spark):
    template = "%(if:notequals=refs/tags/v1)%(refname)%(then)%(refname:lstrip=-1)%(else)%(align:6,middle)tag%(end)%(end)!"
    assert values(spark, ["refs/heads/a/b", "refs/tags/v1"], lambda c: formats.format_column(template, {"refname": c})) == ["b!", " tag  !"]
    with pytest.raises(ValueError):
        formats.format_column("%(if)%(refname)%(then)x", {"refname": F.col("x")})
    assert values(spark, ["a'b!"], lambda c: scalars.host_quoted(c, "shell")) == [r"'a'\''b'\!''"]
    assert values(spark, ["a'b"], lambda c: scalars.host_quoted(c, "perl")) == [r"'a\'b'"]
    assert values(spark, ["$x[1]"], lambda c: scalars.host_quoted(c, "tcl")) == [r'"\$x\[1\]"']


def test_compact_renames(spark):
    names = [("a/b/c", "a/d/c"), ("x", "y"), ("a/b", "a/b/c"), ("p/q/r.c", "p/r.c"), ("a/a", "a/a/a"), ("m/n", "o/n")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i int, o string, n string").orderBy("i")
    assert [r[0] for r in df.select(convert.compact_rename(F.col("o"), F.col("n"))).collect()] == [codecs.compact_rename(*n) for n in names]


def test_line_similarity_counts_all_lines(spark):
    texts = {1: "a\nb\nc\nd", 2: "a\nb\nc\nx", 3: "a\nb\nc\nd", 4: "q\nr", 5: "a\na\na\na", **{n: f"a\nb\nu{n}\nv{n}" for n in range(10, 60)}}
    rows = [(d, n, line) for d, t in texts.items() for n, line in enumerate(t.split("\n"))]
    got = {(r["a"], r["b"]): r["score"] for r in diff.line_similarity(spark.createDataFrame(rows, "doc_id long, line_no int, line string"), 30000).collect()}
    bags = {d: Counter(t.split("\n")) for d, t in texts.items()}
    expected = {(1, 3): 60000}
    for a in texts:
        for b in texts:
            if a < b and 3 not in (a, b) and (s := (bags[a] & bags[b]).total() * 60000 // max(bags[a].total(), bags[b].total())) >= 30000:
                expected[a, b] = s
    assert got == expected
