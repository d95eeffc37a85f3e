"""Repository views over relational tables: commits, parents, refs, trees, blobs and logs.

Orders are commits of one branch a customer; four neighbouring branches form a group, inside which every fifth
commit merges the latest earlier commit of the branch before it.  Line items are the paths of a
commit's tree, documents are blobs, events are a reference log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, branch, grp, ts, subject, kind, p1): p1 is the commit before it on its branch."""
    own = Window.partitionBy("branch").orderBy("ts", "oid")
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("oid"),
        F.col("o_custkey").alias("branch"),
        F.expr("o_custkey div 4").alias("grp"),
        F.unix_timestamp("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("subject"),
        F.col("o_orderstatus").alias("kind"),
    )
    return rows.withColumn("p1", F.lag("oid").over(own))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, ord, parent): ord 1 is the first parent, ord 2 the merged one."""
    return grouped_parents(spark, sf_dir).drop("grp")


def grouped_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, ord, parent, grp): parents with the group of both ends, as no edge leaves it.

    The merged parent is an as-of join, done as a union and a carried-forward window: no pair of
    commits is ever formed but the one that is wanted.
    """
    c = commits(spark, sf_dir)
    first = c.filter("p1 is not null").select("oid", F.lit(1).alias("ord"), F.col("p1").alias("parent"), "grp")
    given = c.filter("(branch + 1) div 4 = grp").select((F.col("branch") + 1).alias("branch"), "grp", "ts", "oid", F.col("oid").alias("other"), F.lit(False).alias("asks"))
    asked = c.filter("oid % 5 = 0 and p1 is not null").select("branch", "grp", "ts", "oid", F.lit(None).cast("long").alias("other"), F.lit(True).alias("asks"))
    latest = F.last("other", ignorenulls=True).over(Window.partitionBy("branch").orderBy("ts", "oid").rowsBetween(Window.unboundedPreceding, -1))
    second = given.union(asked).withColumn("parent", latest).filter("asks and parent is not null").select("oid", F.lit(2).alias("ord"), "parent", "grp")
    return first.union(second)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(branch, grp, oid): the latest commit of each branch."""
    return commits(spark, sf_dir).groupBy("branch", "grp").agg(F.max(F.struct("ts", "oid"))["oid"].alias("oid"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(refname, kind, oid, objecttype): branches on their latest commits, tags on urgent commits."""
    branch = heads(spark, sf_dir).select(F.concat(F.lit("refs/heads/c"), "branch").alias("refname"), F.lit("branch").alias("kind"), "oid", F.lit("commit").alias("objecttype"))
    when = F.timestamp_seconds("ts")
    tag = commits(spark, sf_dir).filter("subject = '1-URGENT'")
    tag = tag.select(F.concat(F.lit("refs/tags/v"), F.year(when), F.lit("."), F.month(when), F.lit("."), "oid").alias("refname"), F.lit("tag").alias("kind"), "oid", F.lit("tag").alias("objecttype"))
    return branch.union(tag)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, path, flag, content): the flattened tree of each commit; flag acts as the mode."""
    path = F.concat(F.lit("b"), F.col("l_partkey") % 6, F.lit("/t"), F.col("l_suppkey") % 2)
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("oid"), path.alias("path"))
    return rows.agg(F.max("l_returnflag").alias("flag"), F.expr("cast(max(l_quantity) as bigint) div 10").alias("content"))


def blob_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): lines of each document, from 1."""
    split = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return split.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, version, line_no, line): versions 0 to 3 of each document by a fixed edit script."""
    numbers = F.explode(F.array(*[F.lit(v).cast("long") for v in range(4)]))
    kept = blob_lines(spark, sf_dir).select("doc_id", numbers.alias("version"), "line_no", "line").filter("(line_no + version) % 5 <> 0")
    edits = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(v).cast("long") for v in range(1, 4)])).alias("version"))
    return kept.union(edits.select("doc_id", "version", (F.col("version") + 1000).alias("line_no"), F.concat(F.lit("edit "), "version")))


def reflog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, seq, old_id, new_id, ts, action, note): events of a user as the log of a reference, seq from 1."""
    own = Window.partitionBy("ref").orderBy("at", "new_id")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("ref"), F.col("event_id").alias("new_id"), F.col("ts").alias("at"), F.unix_timestamp("ts").alias("ts"), F.col("event_type").alias("action"), F.col("props").alias("note"))
    return rows.select("ref", F.row_number().over(own).cast("long").alias("seq"), F.lag("new_id").over(own).alias("old_id"), "new_id", "ts", "action", "note")


def mailmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_email, commit_name, proper_name): one rule by email for each nation, one by name and email for every seventh customer."""
    nation = load(spark, sf_dir, "nation")
    general = nation.select(F.concat(F.lit("N"), "n_nationkey", F.lit("@Example.org")).alias("commit_email"), F.lit(None).cast("string").alias("commit_name"), F.col("n_name").alias("proper_name"))
    customer = load(spark, sf_dir, "customer").filter("c_custkey % 7 = 0")
    special = customer.select(F.concat(F.lit("n"), "c_nationkey", F.lit("@example.ORG")), F.upper("c_name"), F.concat(F.lit("Account "), "c_custkey"))
    return general.union(special)
