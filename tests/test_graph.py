"""Graph operators on drawn graphs, with the sets that they must give."""

import pytest

from palimpsest.operators import graph


def edges_of(spark, text):
    """`child: parent parent` items, separated by semicolons, as nodes and edges."""
    nodes, edges = [], []
    for item in text.split(";"):
        child, _, rest = item.strip().partition(":")
        nodes.append((child,))
        edges += [(child, n + 1, p) for n, p in enumerate(rest.split())]
    return spark.createDataFrame(nodes, "oid string"), spark.createDataFrame(edges, "oid string, ord int, parent string")


@pytest.fixture(scope="module")
def crossing(spark):
    nodes, edges = edges_of(spark, "E; D: E; F: E; C: D; B: C; A: B; G: B E; H: A F")
    return nodes, edges, graph.closure(nodes, edges)


@pytest.fixture(scope="module")
def ladder(spark):
    nodes, edges = edges_of(spark, "A; B: A; C: B; D: C; E: D; F: E; G: C; H: G E; I: H; J: I F; K: A; L: K J; M: L")
    return nodes, edges, graph.closure(nodes, edges)


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string")


def test_merge_base(spark, crossing):
    _, edges, reach = crossing
    assert [r["base"] for r in graph.merge_bases(pair(spark, "G", "H"), reach, edges).collect()] == ["B"]
    assert [r["base"] for r in graph.merge_bases(pair(spark, "H", "G"), reach, edges).collect()] == ["B"]


def test_merge_base_with_unsynchronised_clocks(spark):
    nodes, edges = edges_of(spark, "S; C0: S; C1: C0; C2: C1; L0: S; L1: L0; L2: L1; R0: S; R1: R0; R2: R1; PL: L2 C2; PR: C2 R2")
    reach = graph.closure(nodes, edges)
    assert [r["base"] for r in graph.merge_bases(pair(spark, "PL", "PR"), reach, edges).collect()] == ["C2"]


def test_independent(spark, crossing):
    _, _, reach = crossing
    heads = spark.createDataFrame([(1, x) for x in "AHG"] + [(2, "H")], "k int, oid string")
    got = {(r["k"], r["oid"]) for r in graph.independent(heads, reach, ["k"]).collect()}
    assert got == {(1, "H"), (1, "G"), (2, "H")}


def test_ranges_and_ancestry_path(spark, ladder):
    _, edges, reach = ladder
    sets = graph.pair_sets(pair(spark, "D", "M"), reach)
    assert {r["oid"] for r in sets.filter("in_b and not in_a").collect()} == set("EFGHIJKLM")
    assert {r["oid"] for r in graph.ancestry_path(pair(spark, "D", "M"), reach, edges).collect()} == set("EFHIJLM")
    both = graph.pair_sets(pair(spark, "F", "I"), reach)
    assert {r["oid"] for r in both.filter("in_a <> in_b").collect()} == set("FGHI")


def test_symmetric_difference_is_two_ranges(spark, ladder):
    _, _, reach = ladder
    for a, b in (("F", "I"), ("K", "J"), ("G", "E")):
        sets = graph.pair_sets(pair(spark, a, b), reach).collect()
        tips = {r["oid"] for r in reach.filter(f"tip = '{a}'").collect()}, {r["oid"] for r in reach.filter(f"tip = '{b}'").collect()}
        assert {r["oid"] for r in sets if r["in_a"] != r["in_b"]} == tips[0] ^ tips[1]


def test_closure_walk_and_generations_agree(spark, ladder):
    nodes, edges, reach = ladder
    tips = nodes.selectExpr("oid as tip", "oid")
    walked = graph.walk(tips, edges)
    assert {(r["tip"], r["oid"]) for r in walked.collect()} == {(r["tip"], r["oid"]) for r in reach.collect()}
    level = {r["oid"]: r["generation"] for r in graph.generations(nodes, edges).collect()}
    assert level == {r["oid"]: r["generation"] for r in graph.generation_numbers(reach).collect()}
    assert level["A"] == 1 and level["M"] == 10
    chain = {(r["tip"], r["oid"], r["depth"]) for r in graph.chain(reach).collect()}
    assert chain == {(r["tip"], r["oid"], r["depth"]) for r in graph.walk(tips, edges, first_parent=True).collect()}
    assert chain == {(r["tip"], r["oid"], r["depth"]) for r in graph.first_parents(tips, edges).collect()}
    assert {(r["tip"], r["oid"]) for r in graph.reach_of(tips, edges).collect()} == {(r["tip"], r["oid"]) for r in reach.collect()}
    few = nodes.filter("oid in ('G', 'F')")
    assert {r["oid"] for r in graph.reached(few, edges).collect()} == {r["oid"] for r in reach.filter("tip in ('G', 'F')").collect()}


def test_first_parents_of_one_long_branch(spark):
    n = 20_000
    edges = spark.range(1, n).selectExpr("id as oid", "1 as ord", "id - 1 as parent")
    tips = spark.createDataFrame([(n - 1,), (n // 2,)], "tip long")
    got = graph.first_parents(tips, edges)
    assert got.count() == n + n // 2 + 1
    assert got.filter("tip - depth <> oid").count() == 0


def test_a_walk_stops(spark, ladder):
    nodes, edges, _ = ladder
    stop = spark.createDataFrame([("E",), ("C",)], "oid string")
    tips = spark.createDataFrame([("J", "J")], "tip string, oid string")
    assert {r["oid"] for r in graph.walk(tips, edges, stop=stop).collect()} == set("JIFHG")


def test_names_by_walk_and_by_closure_agree(spark, ladder):
    _, edges, reach = ladder
    named = spark.createDataFrame([("M", "v2"), ("F", "v1"), ("J", "top")], "oid string, name string")
    by_walk = {(r["oid"], r["name"], r["distance"]) for r in graph.name_by_walk(named, edges).collect()}
    assert by_walk == {(r["oid"], r["name"], r["distance"]) for r in graph.nearest_names(named, reach).collect()}
    assert ("E", "v1", 1) in by_walk and ("A", "v2", 2 + 1) in by_walk


def test_parent_counts(spark):
    nodes, edges = edges_of(spark, "one; two: one; three: two; four: three; five; six: two; seven: three; eight: four; normal: four five; tri: normal six seven; tetra: normal six seven eight")
    n = {r["oid"]: r["count"] for r in edges.groupBy("oid").count().collect()}
    assert {x for x, k in n.items() if k >= 3} == {"tri", "tetra"}
    roots = {r["oid"] for r in nodes.join(edges, "oid", "left_anti").collect()}
    assert roots == {"one", "five"}


def test_bisect_takes_the_middle(spark):
    nodes, edges = edges_of(spark, "a; b: a; c: b; d: c; e: d")
    numbered = nodes.selectExpr("ascii(oid) as oid"), edges.selectExpr("ascii(oid) as oid", "ord", "ascii(parent) as parent")
    reach = graph.closure(*numbered)
    sets = graph.pair_sets(spark.createDataFrame([(97, 101)], "a int, b int"), reach)
    r = graph.bisect(sets, numbered[1]).collect()[0]
    assert (chr(r["oid"]), r["weight"], r["total"]) == ("c", 2, 4)
