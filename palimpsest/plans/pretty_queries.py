"""Queries over log formats and the filters of log walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pretty as ops
from ..sources import views
from .graph_queries import LINEAGE, commits, heads, parents
from .log_queries import _AT, _ZONE
from .registry import query
from .storage import once

LOG = LINEAGE + """, sha AS (SELECT oid, sha1('commit ' || oid) AS id, sha1('tree ' || oid) AS tree FROM commits),
above AS (SELECT parents.oid, list(sha1('commit ' || parent) ORDER BY ord) AS parents FROM parents GROUP BY parents.oid),
log AS (SELECT commits.oid AS number, id, sha.tree AS tree, coalesce(parents, []) AS parents, c_name AS name, 'c' || branch || '@example.org' AS email, ts,
  CASE branch % 3 WHEN 0 THEN 0 WHEN 1 THEN 19800 ELSE -28800 END AS tz, subject || CASE WHEN commits.oid % 2 = 0 THEN '' ELSE ' v1..2?' END AS subject,
  'kind ' || kind || chr(10) || 'branch ' || branch AS body FROM commits JOIN sha ON sha.oid = commits.oid JOIN customer ON c_custkey = branch LEFT JOIN above ON above.oid = commits.oid) """
_WHEN = f"{_AT.replace('ts + tz', 'ts + tz')}"
_DEFAULT = f"strftime({_AT}, '%a %b %-d %H:%M:%S %Y ') || {_ZONE.format(c='')}"


def log(spark, sf):
    """Commit rows as the format language wants them: the committer is the author an hour later, in UTC."""

    def build():
        sha = lambda c: F.sha1(F.concat(F.lit("commit "), c).cast("binary"))
        above = parents(spark, sf).groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "parent"))), lambda x: sha(x["parent"].cast("string"))).alias("parents"))
        who = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("branch"), F.col("c_name").alias("author_name"))
        rows = commits(spark, sf).join(above, "oid", "left").join(who, "branch")
        subject = F.concat("subject", F.when(F.col("oid") % 2 == 0, "").otherwise(" v1..2?"))
        return rows.select(
            F.col("oid").alias("number"),
            sha(F.col("oid").cast("string")).alias("oid"),
            F.sha1(F.concat(F.lit("tree "), "oid").cast("binary")).alias("tree"),
            F.coalesce("parents", F.array().cast("array<string>")).alias("parents"),
            "author_name",
            F.concat(F.lit("c"), "branch", F.lit("@example.org")).alias("author_email"),
            F.col("ts").alias("author_ts"),
            F.when(F.col("branch") % 3 == 0, 0).when(F.col("branch") % 3 == 1, 19800).otherwise(-28800).alias("author_tz"),
            F.lit("Keeper").alias("committer_name"),
            F.lit("keeper@example.org").alias("committer_email"),
            (F.col("ts") + 3600).alias("committer_ts"),
            F.lit(0).alias("committer_tz"),
            F.concat(subject, F.lit("\n\nkind "), "kind", F.lit("\nbranch "), "branch", F.lit("\n")).alias("message"),
        )

    return once(spark, sf, "log", build)


@query(LOG + """SELECT number, id || ' ' || substr(id, 1, 7) || '|' || substr(tree, 1, 7) || '|' || array_to_string(parents, ' ') || '|' || array_to_string(list_transform(parents, lambda x: substr(x, 1, 7)), ' ')
  || '|' || name || ' <' || email || '>|' || ts || '|' || subject || '%' || chr(9) AS line FROM log""")
def log_placeholders(spark, sf):
    """Ids, parents, people and subjects under a format."""
    return log(spark, sf).select("number", ops.pretty("%H %h|%t|%P|%p|%an <%ae>|%at|%s%%%x09").alias("line"))


@query(LOG + f"SELECT number, {_DEFAULT} || '|' || strftime({_AT}, '%Y-%m-%d') || '|' || strftime({_AT}, '%a, %-d %b %Y %H:%M:%S ') || {_ZONE.format(c='')} || '|' || (ts + 3600) || '|Keeper' AS line FROM log")
def log_dates(spark, sf):
    """Dates of authors and committers under a format."""
    return log(spark, sf).select("number", ops.pretty("%ad|%as|%aD|%ct|%cn").alias("line"))


@query(LOG + r"""SELECT number, subject AS s, regexp_replace(regexp_replace(regexp_replace(subject, '[^A-Za-z0-9._]+', '-', 'g'), '\.{2,}', '.', 'g'), '^-+|[-.]+$', '', 'g') AS f, body || chr(10) AS b, subject || chr(10) || chr(10) || body || chr(10) AS whole FROM log""")
def log_messages(spark, sf):
    """Subjects, file names of them, bodies and whole messages."""
    return log(spark, sf).select("number", *[ops.pretty(p).alias(n) for p, n in (("%s", "s"), ("%f", "f"), ("%b", "b"), ("%B", "whole"))])


_INDENTED = "'    ' || subject || chr(10) || '    ' || chr(10) || '    kind ' || split_part(substr(body, 6), chr(10), 1) || chr(10) || '    ' || split_part(body, chr(10), 2)"
_MERGE = "CASE WHEN len(parents) > 1 THEN 'Merge: ' || array_to_string(list_transform(parents, lambda x: substr(x, 1, 7)), ' ') || chr(10) ELSE '' END"
_RAW = f"ts || ' ' || {_ZONE.format(c='')}"


@query(LOG + f"""SELECT number, id || ' ' || subject AS oneline, 'commit ' || id || chr(10) || 'Author: ' || name || ' <' || email || '>' || chr(10) || chr(10) || '    ' || subject || chr(10) AS short,
  'commit ' || id || chr(10) || {_MERGE} || 'Author: ' || name || ' <' || email || '>' || chr(10) || 'Date:   ' || {_DEFAULT} || chr(10) || chr(10) || {_INDENTED} || chr(10) AS medium,
  'commit ' || id || chr(10) || {_MERGE} || 'Author: ' || name || ' <' || email || '>' || chr(10) || 'Commit: Keeper <keeper@example.org>' || chr(10) || chr(10) || {_INDENTED} || chr(10) AS full_,
  substr(id, 1, 7) || ' (' || subject || ', ' || strftime({_AT}, '%Y-%m-%d') || ')' AS reference,
  'commit ' || id || chr(10) || 'tree ' || tree || chr(10) || array_to_string(list_transform(parents, lambda x: 'parent ' || x || chr(10)), '') || 'author ' || name || ' <' || email || '> ' || {_RAW} || chr(10)
    || 'committer Keeper <keeper@example.org> ' || (ts + 3600) || ' +0000' || chr(10) || chr(10) || {_INDENTED} || chr(10) AS raw FROM log""")
def log_named_formats(spark, sf):
    """The named formats."""
    return log(spark, sf).select("number", *[ops.pretty(n).alias("full_" if n == "full" else n) for n in ("oneline", "short", "medium", "full", "reference", "raw")])


@query(LOG + """SELECT number, rpad(name, 20, ' ') || '|' || lpad(substr(id, 1, 7), 9, ' ') || '|' || CASE WHEN length(subject) > 8 THEN substr(subject, 1, 6) || '..' ELSE rpad(subject, 8, ' ') END AS line FROM log""")
def log_padded(spark, sf):
    """Placeholders padded and cut to widths."""
    return log(spark, sf).select("number", ops.pretty("%<(20)%an|%>(9)%h|%<(8,trunc)%s").alias("line"))


@query(LOG + "SELECT number FROM log WHERE regexp_matches(name || ' <' || email || '>', '0[0-4] <c[0-9]+@')")
def log_author(spark, sf):
    """Commits whose author fits an expression."""
    return log(spark, sf).filter(ops.person_matches("author", "0[0-4] <c[0-9]+@")).select("number")


@query(LOG + "SELECT number FROM log WHERE regexp_matches(subject || chr(10) || body, '(?i)urgent|medium') AND NOT regexp_matches(body, 'kind O')")
def log_grep_message(spark, sf):
    """Commits whose message fits one expression in any case, but for those that fit another."""
    message = F.col("message")
    hit = ops.message_matches(["urgent", "medium"], message, icase=True) & ops.message_matches(["^kind O"], message, invert=True)
    return log(spark, sf).filter(hit).select("number")


@query(LOG + "SELECT number FROM log WHERE regexp_matches(subject, '^[1-3]-') AND regexp_matches(body, 'branch [0-9]*5')")
def log_grep_all_match(spark, sf):
    """Commits whose message fits every expression."""
    return log(spark, sf).filter(ops.message_matches(["^[1-3]-", "^branch [0-9]*5"], F.col("message"), all_match=True)).select("number")


@query(LINEAGE + "SELECT oid AS number, ts FROM commits WHERE ts >= 820000000")
def log_since_as_filter(spark, sf):
    """Commits since a time wherever they stand: nothing is cut off behind an older one."""
    return commits(spark, sf).filter("ts >= 820000000").select(F.col("oid").alias("number"), "ts")


@query(LINEAGE + """, heads AS (SELECT branch, arg_max(oid, ts * 1000000000 + oid) AS oid FROM commits GROUP BY branch),
seen AS (SELECT heads.oid FROM heads JOIN commits ON commits.oid = heads.oid AND ts >= 820000000
  UNION SELECT parent FROM seen JOIN parents ON parents.oid = seen.oid JOIN commits ON commits.oid = parent AND ts >= 820000000)
SELECT oid AS number FROM seen""")
def log_since(spark, sf):
    """Commits since a time, where a walk ends at the first older one."""
    from ..operators import graph

    young = commits(spark, sf).filter("ts >= 820000000").select("oid")
    return graph.reached(heads(spark, sf).select("oid"), parents(spark, sf), young).select(F.col("oid").alias("number"))


@query(LINEAGE + """, heads AS (SELECT branch, arg_max(oid, ts * 1000000000 + oid) AS oid FROM commits GROUP BY branch),
refs AS (SELECT oid, 'refs/heads/c' || branch AS name FROM heads UNION ALL SELECT oid, 'refs/tags/v' || oid FROM commits WHERE subject = '1-URGENT')
SELECT oid AS number, string_agg(name, ', ' ORDER BY name) AS decoration FROM refs WHERE name LIKE 'refs/heads/%' AND NOT regexp_matches(name, '^refs/heads/c1[^/]*$') GROUP BY oid""")
def log_decorate_filter(spark, sf):
    """Decorations by names under one pattern but for those under another."""
    from ..functions import patterns
    from .ref_queries import refs

    name = F.col("refname")
    kept = refs(spark, sf).filter(patterns.ref_matches(name, "refs/heads") & ~patterns.ref_matches(name, "refs/heads/c1*"))
    return kept.groupBy(F.col("oid").alias("number")).agg(F.array_join(F.array_sort(F.collect_list("refname")), ", ").alias("decoration"))


@query(LINEAGE + """SELECT oid AS number, coalesce('note ' || CASE WHEN kind = 'F' THEN oid END, '') || '|' || subject AS line FROM commits""")
def log_notes(spark, sf):
    """Notes of commits under a format: a left join, an empty note where there is none."""
    from ..operators.log import with_notes

    notes = commits(spark, sf).filter("kind = 'F'").select("oid", F.concat(F.lit("note "), "oid").alias("text"))
    rows = with_notes(commits(spark, sf).select("oid", F.col("subject").alias("message")), notes)
    return rows.select(F.col("oid").alias("number"), ops.pretty("%N|%s").alias("line"))


@query("""WITH t AS (SELECT l_orderkey AS oid, 'b' || (l_partkey % 6) || '/t' || (l_suppkey % 2) AS path, max(l_returnflag) AS flag, max(l_quantity)::BIGINT // 10 AS content FROM lineitem GROUP BY 1, 2)
SELECT oid, path, '100644 blob ' || substr(sha1('blob ' || content), 1, 7) || ' ' || lpad((content * 100)::VARCHAR, 7, ' ') || chr(9) || path AS line FROM t""")
def ls_tree_format(spark, sf):
    """Tree entries under a format with a padded size."""
    from ..operators import refs as formats

    rows = views.paths(spark, sf).select("oid", "path", F.sha1(F.concat(F.lit("blob "), "content").cast("binary")).alias("id"), (F.col("content") * 100).alias("size"))
    atoms = {"objectmode": F.lit("100644"), "objecttype": F.lit("blob"), "objectname": F.col("id"), "objectsize:padded": F.lpad(F.col("size").cast("string"), 7, " "), "path": F.col("path")}
    return rows.select("oid", "path", formats.format_column("%(objectmode) %(objecttype) %(objectname:short) %(objectsize:padded)%x09%(path)".replace("%x09", "%09"), atoms).alias("line"))
