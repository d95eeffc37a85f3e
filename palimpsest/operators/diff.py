"""Diff operators: trees, renames, line counts, occurrences, patch ids, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tree_diff(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(oid, parent, path, old_flag, new_flag, old_content, new_content, status) for child-parent edges.

    Status is A, D, T (flag differs) or M (content differs); equal paths are left out.  Both sides meet in
    one aggregate over (edge, path) instead of an outer join, so that the tree table is shuffled once for each side.
    """
    old = edges.join(paths.withColumnRenamed("oid", "parent"), "parent").select("oid", "parent", "path", F.struct("flag", "content").alias("old"), F.lit(None).cast("struct<flag:string,content:bigint>").alias("new"))
    new = edges.join(paths, "oid").select("oid", "parent", "path", F.lit(None).cast("struct<flag:string,content:bigint>").alias("old"), F.struct("flag", "content").alias("new"))
    both = old.union(new).groupBy("oid", "parent", "path").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old.flag") != F.col("new.flag"), "T").when(F.col("old.content") != F.col("new.content"), "M")
    named = both.select("oid", "parent", "path", F.col("old.flag").alias("old_flag"), F.col("new.flag").alias("new_flag"), F.col("old.content").alias("old_content"), F.col("new.content").alias("new_content"), status.alias("status"))
    return named.filter("status is not null")


def status_filter(status: Column, letters: str) -> Column:
    """Upper-case letters take statuses in, lower-case ones leave them out."""
    wanted = [c for c in letters if c.isupper()]
    barred = [c.upper() for c in letters if c.islower()]
    out = status.isin(*wanted) if wanted else F.lit(True)
    return out & ~status.isin(*barred) if barred else out


def whole_changesets(diffs: DataFrame, hit: Column) -> DataFrame:
    """All changes of each (oid, parent) of which one hits; a partial aggregate and a semi join, so that no changeset is gathered."""
    found = diffs.filter(hit).select("oid", "parent").distinct()
    return diffs.join(found, ["oid", "parent"], "left_semi")


def at_depth(diffs: DataFrame, depth: int, by: list[str]) -> DataFrame:
    """(by…, path, n): changes under the first `depth` components of their paths."""
    return diffs.groupBy(*by, F.array_join(F.slice(F.split("path", "/"), 1, depth), "/").alias("path")).agg(F.count("*").alias("n"))


def combined(diffs: DataFrame, edges: DataFrame) -> DataFrame:
    """(oid, path, statuses): paths of merges that differ from every parent, a letter for each parent in order."""
    n = edges.groupBy("oid").agg(F.count("*").alias("n")).filter("n > 1")
    rows = diffs.join(edges.select("oid", "parent", "ord"), ["oid", "parent"]).join(n, "oid")
    grouped = rows.groupBy("oid", "path", "n").agg(F.array_sort(F.collect_list(F.struct("ord", "status"))).alias("s"))
    return grouped.filter(F.size("s") == F.col("n")).select("oid", "path", F.array_join(F.transform("s", lambda x: x["status"]), "").alias("statuses"))


def exact_renames(diffs: DataFrame) -> DataFrame:
    """(oid, old_path, new_path): deleted paths matched with added ones of equal flag and content, each used once, in path order."""
    gone = diffs.filter("status = 'D'").select("oid", F.col("path").alias("old_path"), F.col("old_flag").alias("flag"), F.col("old_content").alias("content"))
    come = diffs.filter("status = 'A'").select("oid", F.col("path").alias("new_path"), F.col("new_flag").alias("flag"), F.col("new_content").alias("content"))
    key = ["oid", "flag", "content"]
    gone = gone.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("old_path")))
    come = come.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("new_path")))
    return gone.join(come, [*key, "k"]).select("oid", "old_path", "new_path")


def directory_votes(renames: DataFrame, by: list[str]) -> DataFrame:
    """(by…, old_dir, new_dir, votes): where most files of a directory went; a tie drops it."""
    dirs = renames.select(*by, F.regexp_extract("old_path", "^(.*)/", 1).alias("old_dir"), F.regexp_extract("new_path", "^(.*)/", 1).alias("new_dir")).filter("old_dir <> new_dir")
    votes = dirs.groupBy(*by, "old_dir", "new_dir").agg(F.count("*").alias("votes"))
    own = Window.partitionBy(*by, "old_dir")
    top = votes.withColumn("top", F.max("votes").over(own)).filter("votes = top").withColumn("n", F.count("*").over(own))
    return top.filter("n = 1").select(*by, "old_dir", "new_dir", "votes")


def remapped(paths: DataFrame, renames: DataFrame, by: list[str]) -> DataFrame:
    """paths (by…, path) that lie in a renamed directory, with `moved`: of the (by…, old_dir, new_dir) renames the longest above a path decides.

    Each path meets its own directories by an equi-join, never all renames.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = paths.filter(F.size(parts) > 1).select(*by, "path", F.explode(above).alias("old_dir"))
    best = steps.join(renames.select(*by, "old_dir", "new_dir"), [*by, "old_dir"]).groupBy(*by, "path").agg(F.max_by(F.struct("old_dir", "new_dir"), F.length("old_dir")).alias("x"))
    return best.select(*by, "path", F.concat("x.new_dir", F.substring(F.col("path"), F.length("x.old_dir") + 1, F.length("path"))).alias("moved"))


def line_similarity(lines: DataFrame, least: int, top: int = 60000) -> DataFrame:
    """(a, b, score): pairs of blobs by shared lines as a multiset, score of `top` at least `least`, over all lines.

    Blobs of equal lines are a class: each is paired with the smallest of it (score `top`), and only those are compared.  Candidates share one of the
    rarest lines: a pair of score `least` has the share least / top of the larger side in common, so that it shares a line among the first
    (top - least) / top of either side, rarest first; common lines are looked at only in blobs that have little else.
    """
    counts = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    whole = counts.groupBy("doc_id").agg(F.sum("n").alias("size"), F.count("*").alias("kinds"), F.bit_xor(F.xxhash64("line", "n")).alias("x"), F.sum(F.xxhash64("n", "line").cast("decimal(38,0)")).alias("y"))
    classed = whole.withColumn("rep", F.min("doc_id").over(Window.partitionBy("size", "kinds", "x", "y")))
    same = classed.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(top).cast("long").alias("score"))
    kept = counts.join(classed.filter("doc_id = rep").select("doc_id", "size"), "doc_id")
    often = kept.groupBy("line").agg(F.count("*").alias("df"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("df", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = F.ceil(F.col("size") * F.lit(least) / F.lit(top))
    prefix = kept.join(often, "line").withColumn("before", before).filter(F.col("before") <= F.col("size") - needed).select("doc_id", "line", "size")
    left = prefix.select("line", F.col("doc_id").alias("a"), F.col("size").alias("sa"))
    right = prefix.select("line", F.col("doc_id").alias("b"), F.col("size").alias("sb"))
    pairs = left.join(right, "line").filter((F.col("a") < F.col("b")) & (F.least("sa", "sb") * top >= F.greatest("sa", "sb") * least)).select("a", "b", "sa", "sb").distinct()
    first, second = kept.select(F.col("doc_id").alias("a"), "line", F.col("n").alias("na")), kept.select(F.col("doc_id").alias("b"), "line", F.col("n").alias("nb"))
    shared = pairs.join(first, "a").join(second, ["b", "line"]).groupBy("a", "b", "sa", "sb").agg(F.sum(F.least("na", "nb")).alias("shared"))
    scored = shared.select("a", "b", F.expr(f"shared * {top} div greatest(sa, sb)").alias("score")).filter(F.col("score") >= least)
    return scored.union(same)


def changed_lines(versions: DataFrame, last: int = 3) -> DataFrame:
    """(doc_id, version, line, added, deleted): per step to `version`, 1 to last, lines by how many more or fewer there are.

    One aggregate counts a line in all versions, so that a line is shuffled once for each document, not for each version and step.
    """
    held = versions.filter(F.col("version").between(0, last)).groupBy("doc_id", "line").agg(*[F.count_if(F.col("version") == v).alias(f"n{v}") for v in range(last + 1)])
    more = [F.struct(F.lit(v).cast("long").alias("version"), (F.col(f"n{v}") - F.col(f"n{v - 1}")).alias("more")) for v in range(1, last + 1)]
    steps = held.select("doc_id", "line", F.explode(F.filter(F.array(*more), lambda x: x["more"] != 0)).alias("x"))
    return steps.select("doc_id", F.col("x.version").cast(versions.schema["version"].dataType).alias("version"), "line", F.greatest("x.more", F.lit(0)).alias("added"), F.greatest(-F.col("x.more"), F.lit(0)).alias("deleted"))


def numstat(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_id", "version").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def patch_id(changes: DataFrame) -> DataFrame:
    """(doc_id, version, patch_id): a digest of the changed lines without blanks, in no order."""
    body = F.regexp_replace("line", "[ \t\r]", "")
    signed = changes.select("doc_id", "version", F.explode(F.filter(F.array(F.when(F.col("added") > 0, F.concat(F.lit("+"), body)), F.when(F.col("deleted") > 0, F.concat(F.lit("-"), body))), lambda x: x.isNotNull())).alias("x"))
    grouped = signed.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("doc_id", "version", F.sha1(F.array_join("xs", "\n").cast("binary")).alias("patch_id"))


def continuous_origin(versions: DataFrame, last: int) -> DataFrame:
    """(doc_id, line_no, origin): for each line of the last version, the first version since which it never went."""
    rows = versions.groupBy("doc_id", "line_no", "line").agg(F.collect_set("version").alias("vs"))
    missing = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda v: ~F.array_contains(F.col("vs"), v.cast("long")))
    return rows.filter(F.array_contains("vs", last)).select("doc_id", "line_no", (F.coalesce(F.array_max(missing), F.lit(-1)) + 1).cast("long").alias("origin"))


def occurrences(text: Column, needle: str) -> Column:
    """How often a fixed string stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
