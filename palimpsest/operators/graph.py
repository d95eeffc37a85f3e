"""Commit-graph operators: reachability, revision sets, merge bases, generations and walks.

Edges are (oid, ord, parent) rows with ord 1 for the first parent.  Timestamps never prune a walk, as a parent may be newer than its
child.  Walks start from the tips that are asked about and take HOPS steps a round; chains of first parents double their length in each
round.  Rounds are written to the shared folder; the driver only learns whether something is left.  `closure` holds all pairs and is for small graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import settled

#: What a step to another parent than the first costs when the nearest name is sought.
MERGE_COST = 65535


def closure(nodes: DataFrame, edges: DataFrame, merge_cost: int = MERGE_COST, most_rounds: int = 40) -> DataFrame:
    """(tip, oid, far, near): every ancestor of every node, itself included, in about log2(depth) rounds.

    far is the longest number of steps between the two; near the cheapest, where a step to a first parent costs 1 and
    any other one merge_cost.  A pair with near below merge_cost lies on the first-parent chain, near steps down.
    """
    own = nodes.select(F.col("oid").alias("tip"), "oid", F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("near"))
    cost = F.when(F.col("ord") == 1, 1).otherwise(merge_cost).cast("long")
    step = edges.select(F.col("oid").alias("tip"), F.col("parent").alias("oid"), F.lit(1).cast("long"), cost)

    def best(rows: DataFrame) -> DataFrame:
        return settled(rows.groupBy("tip", "oid").agg(F.max("far").alias("far"), F.min("near").alias("near")))

    now, state = best(own.union(step)), None
    for _ in range(most_rounds):
        seen = tuple(now.agg(F.count("*"), F.sum("far"), F.sum("near")).collect()[0])
        if seen == state:
            return now
        state = seen
        onward = now.select(F.col("tip").alias("oid"), F.col("oid").alias("end"), F.col("far").alias("far_on"), F.col("near").alias("near_on"))
        joined = now.join(onward, "oid")
        now = best(joined.select("tip", F.col("end").alias("oid"), (F.col("far") + F.col("far_on")).alias("far"), (F.col("near") + F.col("near_on")).alias("near")))
    raise RuntimeError("the closure did not settle")


def walk(tips: DataFrame, edges: DataFrame, first_parent: bool = False, stop: DataFrame | None = None) -> DataFrame:
    """(tip, oid, depth): ancestors of each tip by a frontier, with the least number of steps.

    stop holds oids at which the walk ends without taking them.
    """
    step = edges.filter("ord = 1") if first_parent else edges
    frontier = settled(tips.select("tip", "oid", F.lit(0).cast("long").alias("depth")).distinct())
    seen = frontier
    while not frontier.isEmpty():
        reached = frontier.join(step, "oid").select("tip", F.col("parent").alias("oid"), (F.col("depth") + 1).alias("depth")).distinct()
        if stop is not None:
            reached = reached.join(stop.select("oid"), "oid", "left_anti").select("tip", "oid", "depth")
        frontier = settled(reached.join(seen, ["tip", "oid"], "left_anti"))
        seen = seen.union(frontier)
    return seen


#: Steps of a walk that one round takes: rounds write their frontier, steps within one don't.
HOPS = 4


def reached(tips: DataFrame, edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(oid): what any of the tips reaches, themselves included, each commit expanded once, whichever tip came first.

    `within` holds the oids that a walk may enter.  A round takes HOPS steps from the newest commits; only whether some are left reaches the driver.
    """
    step = edges.select("oid", "parent")
    if within is not None:
        step = step.join(within.select(F.col("oid").alias("parent")), "parent", "left_semi").select("oid", "parent")
        tips = tips.join(within, "oid", "left_semi")
    step = settled(step)
    seen = frontier = settled(tips.select("oid").distinct())
    while not frontier.isEmpty():
        wave, found = frontier, None
        for _ in range(HOPS):
            wave = wave.join(step, "oid").select(F.col("parent").alias("oid")).distinct()
            found = wave if found is None else found.union(wave)
        frontier = settled(found.distinct().join(seen, "oid", "left_anti"))
        seen = seen.union(frontier)
    return seen


def reach_of(tips: DataFrame, edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(tip, oid): what each of the tips reaches, itself included; as `reached`, for each tip on its own.

    A tip may be any value where `tips` has an oid as well, at which its walk starts.

    `within` holds the (tip, oid) rows that a walk may enter.  Work and result follow the asked tips, not all commits.
    """
    step = settled(edges.select("oid", "parent").distinct())
    seen = frontier = settled(tips.select("tip", F.col("oid" if "oid" in tips.columns else "tip").alias("oid")).distinct())
    while not frontier.isEmpty():
        wave, found = frontier, None
        for _ in range(HOPS):
            wave = wave.join(step, "oid").select("tip", F.col("parent").alias("oid")).distinct()
            if within is not None:
                wave = wave.join(within, ["tip", "oid"], "left_semi")
            found = wave if found is None else found.union(wave)
        frontier = settled(found.distinct().join(seen, ["tip", "oid"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def first_parents(tips: DataFrame, edges: DataFrame) -> DataFrame:
    """(tip, oid, depth): the first-parent chain of each tip, itself at depth 0, in log2(depth) rounds.

    Each round doubles the length of the jumps along first parents and of the chains that they extend.
    """
    jump = settled(edges.filter("ord = 1").select("oid", "parent"))
    seen, length = settled(tips.select("tip", F.col("tip").alias("oid"), F.lit(0).cast("long").alias("depth")).distinct()), 1
    while not jump.isEmpty():
        further = seen.join(jump, "oid").select("tip", F.col("parent").alias("oid"), (F.col("depth") + length).alias("depth"))
        seen = settled(seen.union(further))
        onward = jump.select(F.col("oid").alias("parent"), F.col("parent").alias("end"))
        jump = settled(jump.join(onward, "parent").select("oid", F.col("end").alias("parent")))
        length *= 2
    return seen


def chain(reach: DataFrame, merge_cost: int = MERGE_COST) -> DataFrame:
    """(tip, oid, depth): the first-parent chain of every node, itself at depth 0, from a closure."""
    return reach.filter(F.col("near") < merge_cost).select("tip", "oid", F.col("near").alias("depth"))


def generation_numbers(reach: DataFrame) -> DataFrame:
    """(oid, generation) from a closure: one more than the longest way down."""
    return reach.groupBy(F.col("tip").alias("oid")).agg((F.max("far") + 1).alias("generation"))


def risen(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(oid, value): the least values that aren't below those of the (oid, value) nodes and are above those of all parents.

    From 1 everywhere these are generation numbers, from commit times corrected commit dates.
    """
    step = settled(edges.select("oid", "parent").distinct())
    best = frontier = settled(nodes.select("oid", F.col("value").cast("long").alias("value")))
    while not frontier.isEmpty():
        wave, found = frontier, best
        for _ in range(HOPS):
            above = wave.select(F.col("oid").alias("parent"), "value").join(step, "parent")
            wave = above.groupBy("oid").agg((F.max("value") + 1).alias("value"))
            found = found.union(wave)
        after = settled(found.groupBy("oid").agg(F.max("value").alias("value")))
        frontier = settled(after.join(best.withColumnRenamed("value", "old"), "oid").filter("value > old").select("oid", "value"))
        best = after
    return best


def generations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(oid, generation): 1 for roots, else one more than the largest of the parents."""
    return risen(nodes.select("oid", F.lit(1).alias("value")), edges).withColumnRenamed("value", "generation")


def reachable(tips: DataFrame, reach: DataFrame) -> DataFrame:
    """Ancestors of rows (…, tip), their columns kept, from a closure."""
    return tips.join(reach, "tip")


def excluded(positive: DataFrame, negative: DataFrame, by: list[str]) -> DataFrame:
    """Rows of positive without those that negative reaches: `positive --not negative`."""
    return positive.join(negative.select(*by), by, "left_anti")


def pair_sets(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """For rows (a, b): (a, b, oid, in_a, in_b) of every commit that either reaches.

    One aggregate over the union of both closures gives ranges, symmetric differences, common ancestors and counts alike.
    """
    left = pairs.join(reach, pairs["a"] == reach["tip"]).select("a", "b", "oid", F.lit(1).alias("l"), F.lit(0).alias("r"))
    right = pairs.join(reach, pairs["b"] == reach["tip"]).select("a", "b", "oid", F.lit(0).alias("l"), F.lit(1).alias("r"))
    both = left.union(right).groupBy("a", "b", "oid").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return both.select("a", "b", "oid", (F.col("l") == 1).alias("in_a"), (F.col("r") == 1).alias("in_b"))


def best_common(common: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Of common ancestors (by…, oid) those that no other one reaches.

    All ancestors of a common ancestor are common, so one that another reaches is the parent of a common one: edges are enough.
    """
    covered = common.join(edges.select("oid", "parent"), "oid").select(*by, F.col("parent").alias("oid")).distinct()
    return common.join(covered, [*by, "oid"], "left_anti")


def merge_bases(pairs: DataFrame, reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, base): every best common ancestor of each pair."""
    common = pair_sets(pairs, reach).filter("in_a and in_b").select("a", "b", "oid")
    return best_common(common, edges, ["a", "b"]).withColumnRenamed("oid", "base")


def fork_points(tips: DataFrame, log: DataFrame, reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(tip, oid): for (tip, ref) rows the best of the values that the ref's (ref, oid) log has had and the tip reaches.

    Null where the tip reaches none, or where several are best, as then no entry is the one.
    """
    held = tips.join(log.select("ref", "oid").distinct(), "ref").join(reach, ["tip", "oid"], "left_semi").select("tip", "oid")
    return only_best(tips, uncovered(held, edges))


def uncovered(held: DataFrame, edges: DataFrame) -> DataFrame:
    """(tip, oid): of the (tip, oid) rows of each tip those that no other one of it reaches."""
    inner = held.select(F.col("oid").alias("tip")).distinct()
    below = reach_of(inner, edges).filter("tip <> oid").withColumnRenamed("tip", "upper")
    covered = held.withColumnRenamed("oid", "upper").join(below, "upper").select("tip", "oid").distinct()
    return held.join(covered, ["tip", "oid"], "left_anti").select("tip", "oid")


def only_best(tips: DataFrame, best: DataFrame) -> DataFrame:
    """(tip, oid): the best of each tip, null where it has none or several."""
    one = best.groupBy("tip").agg(F.count("*").alias("n"), F.min("oid").alias("oid"))
    return tips.select("tip").distinct().join(one, "tip", "left").select("tip", F.when(F.col("n") == 1, F.col("oid")).alias("oid"))


def all_reached(targets: DataFrame, tips: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (all_reached, n_missing): whether some tip reaches each (oid) target."""
    return none_missing(targets, reached(tips, edges))


def none_missing(targets: DataFrame, found: DataFrame) -> DataFrame:
    """One row (all_reached, n_missing): whether each (oid) target is among the found ones."""
    missing = targets.select("oid").distinct().join(found, "oid", "left_anti")
    return missing.agg((F.count("*") == 0).alias("all_reached"), F.count("*").alias("n_missing"))


def prunable(objects: DataFrame, tips: DataFrame, edges: DataFrame, expire: int) -> DataFrame:
    """Of (oid, mtime) objects those that may go: no tip reaches them, nor anything newer than expire that no tip reaches either."""
    lost = objects.join(reached(tips, edges), "oid", "left_anti")
    young = reached(lost.filter(F.col("mtime") > expire).select("oid"), edges)
    return lost.filter(F.col("mtime") <= expire).join(young, "oid", "left_anti")


def sources(tips: DataFrame, reach: DataFrame) -> DataFrame:
    """(oid, source): the name of the (tip, name) that reaches each commit; of several the smallest."""
    return reach.join(tips, "tip").groupBy("oid").agg(F.min("name").alias("source"))


def ahead_behind(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """(a, b, ahead, behind): commits only a reaches, and only b reaches."""
    sets = pair_sets(pairs, reach)
    return sets.groupBy("a", "b").agg(F.count_if(F.expr("in_a and not in_b")).alias("ahead"), F.count_if(F.expr("in_b and not in_a")).alias("behind"))


def independent(heads: DataFrame, reach: DataFrame, by: list[str]) -> DataFrame:
    """Of heads (by…, oid) in each group those that no other head of it reaches; reach holds what the heads reach."""
    covered = heads.withColumnRenamed("oid", "tip").join(reach.filter("tip <> oid"), "tip").select(*by, "oid").distinct()
    return heads.join(covered, [*by, "oid"], "left_anti")


def _induced(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among the (a, b, oid) rows of each pair, with (a, b, oid) structs as nodes."""
    inner = rows.join(edges.select("oid", "parent"), "oid").select("a", "b", "oid", "parent")
    inner = inner.join(rows.select("a", "b", F.col("oid").alias("parent")), ["a", "b", "parent"])
    return inner.select(F.struct("a", "b", "oid").alias("oid"), F.struct("a", "b", F.col("parent").alias("oid")).alias("parent"))


def ancestry_path(pairs: DataFrame, reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, oid): commits of a..b on a path between them: descendants of a that b reaches, a itself left out.

    The walk goes up from a, inside what b reaches.
    """
    inside = settled(pairs.join(reach, pairs["b"] == reach["tip"]).select("a", "b", "oid"))
    up = _induced(inside, edges).select(F.col("parent").alias("oid"), F.col("oid").alias("parent"))
    start = inside.filter("oid = a").select(F.struct("a", "b", "oid").alias("oid"))
    return reached(start, up).select("oid.*").filter("oid <> a")


def children(edges: DataFrame) -> DataFrame:
    """(oid, children): children of each commit that has some, ascending, joined by blanks."""
    return edges.groupBy(F.col("parent").alias("oid")).agg(F.array_join(F.array_sort(F.collect_set("oid")).cast("array<string>"), " ").alias("children"))


def bisect_weights(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, oid, weight, total): for each commit of a..b how much of the range it reaches, walked inside the range; sets as of `pair_sets`."""
    range_ = settled(sets.filter("in_b and not in_a").select("a", "b", "oid"))
    reach = reach_of(range_.select(F.struct("a", "b", "oid").alias("tip")), _induced(range_, edges))
    weights = reach.groupBy("tip").agg(F.count("*").alias("weight")).select("tip.*", "weight")
    return weights.join(range_.groupBy("a", "b").agg(F.count("*").alias("total")), ["a", "b"])


def bisect(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, oid, weight, total): the commit of a..b whose reach inside the range is nearest to half; ties to the smaller id."""
    return middle(bisect_weights(sets, edges))


def middle(weights: DataFrame) -> DataFrame:
    """(a, b, oid, weight, total): of the weights of each pair the one that is nearest to half; ties to the smaller id."""
    best = F.max_by(F.struct("oid", "weight", "total"), F.struct(F.least(F.col("weight"), F.col("total") - F.col("weight")), -F.col("oid")))
    return weights.groupBy("a", "b").agg(best.alias("x")).select("a", "b", "x.*")


def nearest_names(named: DataFrame, reach: DataFrame) -> DataFrame:
    """(oid, name, distance): the nearest of (oid, name) rows above each commit, from a closure; ties to the smaller name."""
    rows = named.withColumnRenamed("oid", "tip").join(reach, "tip").groupBy("oid")
    return rows.agg(F.min(F.struct(F.col("near").alias("distance"), "name")).alias("x")).select("oid", "x.name", "x.distance")


def name_by_walk(named: DataFrame, edges: DataFrame, merge_cost: int = MERGE_COST) -> DataFrame:
    """(oid, name, distance): the nearest name of each commit that some name reaches; ties to the smaller name.

    A step to a first parent costs 1, to any other parent merge_cost.  A round relaxes HOPS steps from what changed and keeps the best of each commit.
    """
    step = settled(edges.select("oid", "parent", F.when(F.col("ord") == 1, 1).otherwise(merge_cost).cast("long").alias("cost")))
    least = lambda rows: rows.groupBy("oid").agg(F.min(F.struct("distance", "name")).alias("x")).select("oid", "x.distance", "x.name")
    best = changed = settled(least(named.select("oid", F.lit(0).cast("long").alias("distance"), "name")))
    while not changed.isEmpty():
        wave, found = changed, best
        for _ in range(HOPS):
            wave = least(wave.join(step, "oid").select(F.col("parent").alias("oid"), (F.col("distance") + F.col("cost")).alias("distance"), "name"))
            found = found.union(wave)
        after = settled(least(found))
        changed = settled(after.join(best, ["oid", "distance", "name"], "left_anti").select("oid", "distance", "name"))
        best = after
    return best.select("oid", "name", "distance")


def simplified(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Commits of default history simplification for a path: where the path differs from every parent.

    changed holds (oid, parent) edges on which it differs; roots must be in it with a null parent where the path exists.
    """
    same = edges.join(changed.filter("parent is not null"), ["oid", "parent"], "left_anti").select("oid").distinct()
    differs = changed.select("oid").distinct()
    return differs.join(same, "oid", "left_anti").join(nodes.select("oid"), "oid", "left_semi")


def ranked(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)
