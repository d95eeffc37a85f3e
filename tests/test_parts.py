"""Walks of whole parts against those of graph, on random graphs, and as queries over odd tables."""

import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import graph, parts
from palimpsest.plans import catalogue


@pytest.fixture(scope="module")
def drawn(spark):
    random.seed(5)
    edges = [(-7, i, 1, i - 1) for i in range(500_001, 500_020)] + [(9, 90_000, 1, 90_001), (9, 90_001, 1, 90_002), (9, 90_002, 1, 90_001), (9, 90_003, 1, 90_000)]
    for part in range(6):
        n = [2, 5, 20, 12, 66, 8][part]
        edges += [(part + 100, part * 1000 + i, 1, part * 1000 + random.randrange(i)) for i in range(1, n)]
        edges += [(part + 100, part * 1000 + i, 2, part * 1000 + random.randrange(i)) for i in range(1, n) if random.random() < 0.4]
    rows = graph.settled(spark.createDataFrame(edges, "part long, oid long, ord int, parent long"))
    by_part = {}
    for part, child, _, parent in edges:
        by_part.setdefault(part, set()).update((child, parent))
    tips = [(p, x) for p, own in by_part.items() for x in random.sample(sorted(own), min(4, len(own)))]
    pairs = [(p, *random.sample(sorted(own), 2)) for p, own in by_part.items() for _ in range(2)]
    return rows, spark.createDataFrame([*tips, (77, 600_000)], "part long, tip long"), spark.createDataFrame(pairs, "part long, a long, b long")


def same(x, y):
    assert x.columns == y.columns
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))


@pytest.fixture(scope="module")
def by_rounds(drawn):
    edges, tips, pairs = drawn
    reach = graph.settled(graph.reach_of(tips, edges))
    sides = graph.settled(graph.reach_of(pairs.select(F.col("a").alias("tip")).union(pairs.select("b")), edges))
    sets = graph.settled(graph.pair_sets(pairs.select("a", "b").distinct(), sides))
    weights = graph.settled(graph.bisect_weights(sets, edges).select("a", "b", "oid", "weight", "total"))
    between = graph.settled(graph.ancestry_path(pairs.select("a", "b").distinct(), sides, edges))
    held = graph.settled(reach.join(tips, "tip").filter("oid % 3 <> 0"))
    return reach, sets, weights, between, held, graph.settled(graph.uncovered(held.select("tip", "oid"), edges))


@pytest.mark.parametrize("large, held", [([], 50), ([], 1 << 20), ([-7, 9, 102], 50)])
def test_parts_give_what_rounds_give(spark, drawn, by_rounds, large, held, monkeypatch):
    edges, tips, pairs = drawn
    reach, sets, weights, between, held_rows, best = by_rounds
    monkeypatch.setattr(parts, "HELD", held)
    big = spark.createDataFrame([(x,) for x in large], "part long")
    same(parts.reach_of(tips, edges, big), reach)
    same(parts.reached(tips.withColumnRenamed("tip", "oid"), edges, big), reach.select("oid").distinct())
    same(parts.pair_sets(pairs, edges, big), sets)
    same(parts.bisect_weights(pairs, edges, big), weights)
    same(parts.ancestry_path(pairs, edges, big), between)
    same(parts.best_of(held_rows, edges, big), best)
    named = tips.withColumn("name", F.min("tip").over(Window.partitionBy("part")))
    same(parts.counted(named, edges, big), named.join(reach, "tip").groupBy("name").agg(F.countDistinct("oid").alias("n")))


def test_no_round_is_written(spark, drawn, monkeypatch):
    """Walks of small parts settle nothing: rounds did, one or more for four steps."""
    edges, tips, pairs = drawn
    monkeypatch.setattr(graph, "settled", lambda df: pytest.fail("a round was written"))
    none = spark.createDataFrame([], "part long")
    plan = parts.bisect_weights(pairs, edges, none)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3
    assert parts.reach_of(tips, edges, none).count()


@pytest.mark.parametrize("name", ["bisect_all", "fork_point", "prune_recent", "ancestry_path", "boundary_commits", "rev_list_all", "bitmap_union", "reachability_bitmaps", "bitmap_bits"])
def test_an_order_of_two_groups_joins_their_graphs(spark, tmp_path, name):
    random.seed(6)
    rows = [(i, random.randrange(12), f"19{random.randrange(92, 99)}-0{random.randrange(1, 9)}-11 00:00:00", "5-LOW", "F") for i in range(60)]
    rows += [(7, 11, "1999-01-01 00:00:00", "5-LOW", "F"), (7, 1, "1991-01-01 00:00:00", "5-LOW", "F")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_orderstatus string")
    orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", ["bitmap_union", "reachability_bitmaps", "bitmap_bits"])
def test_bitmaps_are_no_wider_than_their_group(spark, tmp_path, name):
    """Commits a million ids apart: a fixed bitmap for each of them took 4 KB a row."""
    rows = [(i * 1_000_000, i % 7, f"1995-01-{1 + i // 7:02d} 00:00:00", "5-LOW", "F") for i in range(140)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_orderstatus string")
    orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.queries()[name](spark, str(tmp_path))
    assert "bitmap_construct_agg" not in got._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == sorted(con.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_follow_reads_chains_once(spark, monkeypatch):
    from palimpsest.operators import trees

    monkeypatch.setattr(trees, "settled", lambda df: pytest.fail("a round was written"))
    start = spark.createDataFrame([(9, "a"), (5, "x"), (5, "y")], "tip long, path string")
    chain = spark.createDataFrame([(9, 9 - d, d) for d in range(9)] + [(5, 5 - d, d) for d in range(3)] + [(5, 50, 2), (4, 4, 0)], "tip long, oid long, depth long")
    renames = spark.createDataFrame([(8, "b", "a"), (8, "z", "q"), (6, "c", "b"), (4, "w", "x"), (2, "d", "c")], "oid long, old_path string, new_path string")
    got = sorted(map(tuple, trees.follow(start, chain, renames).collect()))
    first = [(9, o, "a" if o > 7 else "b" if o > 5 else "c" if o > 1 else "d") for o in range(1, 10)]
    second = [(5, 5, "x"), (5, 5, "y"), (5, 4, "x"), (5, 4, "y"), *((5, o, p) for o in (3, 50) for p in ("w", "y"))]
    assert got == sorted(first + second)
