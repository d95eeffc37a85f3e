"""Line diffs, merges, attribution, codecs, dates, revisions."""

import random

import pytest

from palimpsest.functions import codecs, linediff
from palimpsest.functions.dates import approximate, parse_exact
from palimpsest.operators import revisions


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_scripts_are_shortest_and_apply():
    random.seed(3)
    for _ in range(300):
        a, b = (random.choices("abcd", k=random.randrange(0, 14)) for _ in range(2))
        same = linediff.matches(a, b)
        assert len(same) == longest(a, b)
        assert all(a[i] == b[j] for i, j in same) and all(p < q and r < s for (p, r), (q, s) in zip(same, same[1:]))
        for algorithm in linediff.ALGORITHMS:
            rows = linediff.script(a, b, algorithm)
            assert [r[3] for r in rows if r[0] != "+"] == a and [r[3] for r in rows if r[0] != "-"] == b


def test_unified_hunks():
    a = [f"line {i}" for i in range(1, 21)]
    b = [*a[:2], "new", *a[2:15], *a[16:]]
    assert linediff.unified(a, b, 1) == "@@ -2,2 +2,3 @@\n line 2\n+new\n line 3\n@@ -15,3 +16,2 @@\n line 15\n-line 16\n line 17"
    assert linediff.unified(a, a) == ""
    assert linediff.script(["a  b"], ["a b "], whitespace="change")[0][0] == " "


def test_merges():
    base = ["a", "b", "c", "d", "e"]
    assert linediff.merge3(base, ["A", *base[1:]], [*base[:4], "E"]) == (["A", "b", "c", "d", "E"], 0)
    lines, n = linediff.merge3(base, ["a", "x", "c", "d", "e"], ["a", "y", "c", "d", "e"])
    assert n == 1 and lines == ["a", "<<<<<<< ours", "x", "=======", "y", ">>>>>>> theirs", "c", "d", "e"]
    assert linediff.merge3(base, ["a", "x", *base[2:]], ["a", "y", *base[2:]], favour="union")[0] == ["a", "x", "y", "c", "d", "e"]
    assert linediff.merge3(base, base[1:], base[1:]) == (base[1:], 0)


def test_attribution_follows_edits():
    one = "\n".join(f"line {i}" for i in range(1, 6)) + "\n"
    two = one.replace("line 1\n", "line one\n").replace("line 3\n", "line three\n")
    assert [(n, v) for n, v, _ in linediff.attribute([(1, one), (2, two)])] == [(1, 2), (2, 1), (3, 2), (4, 1), (5, 1)]


def test_diffs_over_tables(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "a\nc\n"), (2, None, "x"), (3, None, None)], "id long, old string, new string")
    got = {(r["id"], r["op"], r["old_no"], r["new_no"], r["line"]) for r in linediff.diff_pairs(df, "id").collect()}
    assert got == {(1, " ", 1, 1, "a"), (1, "-", 2, None, "b"), (1, "+", None, 2, "c"), (2, "+", None, 1, "x")}
    chain = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, "a\nc\nb"), ("q", 5, "z")], "path string, version long, text string")
    assert {(r["path"], r["line_no"], r["version"]) for r in linediff.blame(chain).collect()} == {("p", 1, 1), ("p", 2, 2), ("p", 3, 1), ("q", 1, 5)}


def test_base85_round_trips():
    random.seed(1)
    for n in range(40):
        data = random.randbytes(n)
        assert codecs.decode85(codecs.encode85(data), n) == data
    with pytest.raises(ValueError):
        codecs.decode85("~~~~~", 4)


def test_versions():
    names = ["v1.10", "v1.9", "v1.09", "v1.9-rc1", "v1.9-rc10", "v1.9-rc2"]
    assert sorted(names, key=codecs.version_key) == ["v1.09", "v1.9", "v1.9-rc1", "v1.9-rc2", "v1.9-rc10", "v1.10"]
    assert codecs.compare_versions("v1-rc1", "v1", ("-rc",)) < 0


def test_similarity_and_names():
    a = b"".join(b"line %d\n" % i for i in range(100))
    assert codecs.similarity(a, a) == 60000 and codecs.similarity(a, b"") == 0
    assert 50000 < codecs.similarity(a, a.replace(b"line 5\n", b"")) < 60000
    assert codecs.compact_rename("arch/i386/Makefile", "arch/x86/Makefile") == "arch/{i386 => x86}/Makefile"
    assert codecs.compact_rename("a", "b") == "a => b"
    assert codecs.name_hash("a b") == codecs.name_hash("ab") != codecs.name_hash("ba")


def test_raw_records_and_mail():
    text = ":100644 100644 bcd1234 0123456 M\tfile0\n:100644 100644 abcd123 1234567 C68\tfile1\tfile2\n:000000 100644 0000000 1234567 A\tfile4\n"
    assert [(r["status"], r["score"], r["new_path"]) for r in codecs.parse_raw_pairs(text)] == [("M", 0, "file0"), ("C", 68, "file2"), ("A", 0, "file4")]
    box = "From x Mon Sep 17 00:00:00 2001\nFrom: A B <a@b>\nSubject: [PATCH 1/2] Re: do it\n\nwhy\n>From here\n---\n f | 1\n" * 2
    mails = codecs.split_mbox(box)
    info = codecs.mail_info(mails[0])
    assert len(mails) == 2 and (info["name"], info["email"], info["subject"], info["message"]) == ("A B", "a@b", "do it", "why\nFrom here\n")


def test_range_diff_pairs_patches():
    old, new = ["a\nb\nc\n", "x\ny\nz\n"], ["q\nr\ns\n", "a\nb\nc\n", "x\ny\nZ\n"]
    assert sorted(codecs.range_diff(old, new), key=str) == sorted([(None, 0, ">"), (0, 1, "="), (1, 2, "!")], key=str)
    random.seed(5)
    import itertools

    for _ in range(30):
        cost = [[random.randrange(20) for _ in range(4)] for _ in range(4)]
        got = sum(cost[i][j] for i, j in enumerate(codecs.assign(cost)))
        assert got == min(sum(cost[i][p[i]] for i in range(4)) for p in itertools.permutations(range(4)))


NOW = 1_251_660_000  # 2009-08-30 19:20:00


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("now", 0), ("5 seconds ago", -5), ("10 minutes ago", -600), ("yesterday", -86400), ("3 days ago", -259200), ("3.days.ago", -259200), ("two weeks ago", -1209600), ("last week", -604800), ("noon", -26400),
        ("tea", -8400), ("midnight", -69600), ("noon yesterday", -112800), ("12:34:56", -24304), ("never", -NOW),
    ],
)
def test_approximate_dates(text, expected):
    assert approximate(text, NOW) - NOW == expected


def test_exact_dates():
    assert parse_exact("2008-02-14 20:30:45 -0500") == 1203039045
    assert parse_exact("2008-02-14T20:30:45Z") == 1203021045
    assert parse_exact("@1251660000") == NOW
    assert parse_exact("tomorrow") is None and parse_exact("2008-13-40") is None
    assert approximate("3 months ago", NOW) == parse_exact("2009-05-30 19:20:00")


def test_revision_language():
    s = revisions.parse(["main..topic", "^old", "x~3^2", "--not", "y", "a...b"])
    assert [n.base for n in s.positive] == ["topic", "x"] and [n.base for n in s.negative] == ["main", "old", "y"]
    assert s.positive[1].steps == (("~", 3), ("^", 2)) and [(a.base, b.base) for a, b in s.symmetric] == [("a", "b")]
    assert revisions.parse_name("main@{2}").steps == (("@", 2),) and revisions.parse_name("@").base == "HEAD"
    assert revisions.parse_name("v1^{commit}").steps == (("peel", "commit"),)


def test_revisions_select(spark):
    refs = spark.createDataFrame([("refs/heads/main", "C"), ("refs/heads/topic", "F")], "refname string, oid string")
    edges = spark.createDataFrame([("B", 1, "A"), ("C", 1, "B"), ("E", 1, "B"), ("F", 1, "E"), ("F", 2, "C")], "oid string, ord int, parent string")
    commits = spark.createDataFrame([(x, f"subject {x}", n) for n, x in enumerate("ABCEF")], "oid string, subject string, ts long")
    log = spark.createDataFrame([("main", 1, "A", 10), ("main", 2, "C", 20)], "ref string, seq long, new_id string, ts long")
    r = revisions.Resolver(refs, edges, commits, log, now=100)
    ask = lambda *tokens: {x["oid"] for x in r.select(revisions.parse(list(tokens))).collect()}
    assert ask("main..topic") == ask("^main", "topic") == {"E", "F"}
    assert ask("topic^2~1") == {"A", "B"} and ask("E...main") == {"E", "C"}
    assert ask("main@{1}") == {"A"} and ask(":/subject E") == {"A", "B", "E"} and ask("nowhere") == set()


def test_ranges_with_nulls_and_ties_merge_as_in_sql(spark, tmp_path):
    import duckdb

    from palimpsest.plans import catalogue

    rows = [(1, 5, 3), (1, 5, 3), (1, None, 3), (1, 40, 1), (1, 40, None), (2, None, None), (3, 7, None), (3, 7, 2), (None, 4, 4), (None, 6, 4), (4, None, 9), (4, 10, 0), (4, 10, 0), (4, 12, 0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.queries()["line_ranges_merged"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    expected = con.execute(catalogue.oracle_sql()["line_ranges_merged"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_changed_lines_take_one_shuffle(spark):
    from palimpsest.operators import diff

    rows = [(1, 0, "a"), (1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (1, 3, "b"), (1, 3, None), (2, 2, "a"), (2, 3, "a"), (3, 0, "z")]
    changes = diff.changed_lines(spark.createDataFrame(rows, "doc_id long, version long, line string"))
    assert changes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    expected = [(1, 1, "a", 0, 1), (1, 2, "a", 0, 1), (1, 2, "b", 1, 0), (1, 3, "b", 1, 0), (1, 3, None, 1, 0), (2, 2, "a", 1, 0), (3, 1, "z", 0, 1)]
    assert sorted(map(repr, map(tuple, changes.collect()))) == sorted(map(repr, expected))
