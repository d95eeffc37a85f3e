"""Log operators: summaries by author, identity mapping, reference logs as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shortlog(rows: DataFrame, keys: Column, subject: str = "subject") -> DataFrame:
    """(key, n, newest): commits by each of their keys, once for each distinct key of a commit."""
    exploded = rows.select(F.explode(F.array_distinct(keys)).alias("key"), F.struct("ts", "oid").alias("at"), F.col(subject).alias("subject"))
    return exploded.groupBy("key").agg(F.count("*").alias("n"), F.max("at")["oid"].alias("newest"))


def apply_mailmap(rows: DataFrame, rules: DataFrame, name: str = "name", email: str = "email") -> DataFrame:
    """rows with proper_name: a rule by name and address beats one by address; case doesn't matter; without one the name stays.

    rules has (commit_email, commit_name, proper_name).
    """
    special = rules.filter("commit_name is not null").select(F.lower("commit_email").alias("__e"), F.lower("commit_name").alias("__n"), F.col("proper_name").alias("__special")).dropDuplicates(["__e", "__n"])
    general = rules.filter("commit_name is null").select(F.lower("commit_email").alias("__g"), F.col("proper_name").alias("__general")).dropDuplicates(["__g"])
    out = rows.join(special, (F.lower(rows[email]) == F.col("__e")) & (F.lower(rows[name]) == F.col("__n")), "left")
    out = out.join(general, F.lower(rows[email]) == F.col("__g"), "left")
    return out.withColumn("proper_name", F.coalesce("__special", "__general", F.col(name))).drop("__e", "__n", "__g", "__special", "__general")


def as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (ref, probe, at) with new_id, the value of the log (ref, seq, new_id, ts) at that time, null before its first entry.

    A union and one carried-forward window a reference: each entry and probe is shuffled once.
    """
    entries = log.select("ref", F.col("ts").alias("at"), F.lit(0).alias("asks"), "seq", F.struct("new_id").alias("value"), F.lit(None).cast("long").alias("probe"))
    asked = probes.select("ref", "at", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(entries.schema["value"].dataType).alias("value"), F.col("probe").cast("long").alias("probe"))
    carried = F.last("value", ignorenulls=True).over(Window.partitionBy("ref").orderBy("at", "asks", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return entries.union(asked).withColumn("found", carried).filter("asks = 1").select("ref", "probe", "at", F.col("found.new_id").alias("new_id"))


def expire(log: DataFrame, now: Column, total: int, unreachable: int, is_unreachable: Column) -> DataFrame:
    """Entries that stay: younger than total, and than unreachable where the entry can't be reached."""
    age = now - F.col("ts")
    return log.filter((age <= total) & (~is_unreachable | (age <= unreachable)))


def selector(log: DataFrame, n: int) -> DataFrame:
    """(ref, n, new_id): ref@{0} to ref@{n - 1}, the newest first."""
    w = Window.partitionBy("ref").orderBy(F.desc("seq"))
    return log.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("ref", (F.col("k") - 1).cast("long").alias("n"), "new_id")


def with_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """rows (oid, …) with `notes`, the texts of (oid, text) notes joined by blank lines, null where there are none."""
    joined = notes.groupBy("oid").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n\n").alias("notes"))
    return rows.join(joined, "oid", "left")


def parse_mailmap(lines: DataFrame, line: str = "line") -> DataFrame:
    """(commit_email, commit_name, proper_name, proper_email) of mailmap lines; comments and lines without an address give no rows.

    `Proper <commit@>`, `<proper@> <commit@>`, `Proper <proper@> <commit@>` and `Proper <proper@> Commit <commit@>`.
    """
    text = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    form = r"^([^<>]*)<([^<>]*)>\s*(?:([^<>]*)<([^<>]*)>)?\s*$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(text, form, i)), F.lit(""))
    rows = lines.filter(text.rlike(form))
    second = part(4)
    return rows.select(F.coalesce(second, part(2)).alias("commit_email"), F.when(second.isNotNull(), part(3)).alias("commit_name"), part(1).alias("proper_name"), F.when(second.isNotNull(), part(2)).alias("proper_email"))
