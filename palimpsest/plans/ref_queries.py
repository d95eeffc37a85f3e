"""Queries over references: listing, filters, sorting, pages, short names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns, scalars
from ..operators import refs as ops
from ..sources import views
from .graph_queries import HEADS, LINEAGE, commits
from .registry import query
from .storage import once

REFS = f"""{LINEAGE}, {HEADS}, refs AS (
  SELECT 'refs/heads/c' || branch AS refname, 'branch' AS kind, oid, 'commit' AS objecttype FROM heads
  UNION ALL SELECT 'refs/tags/v' || year(to_timestamp(ts) AT TIME ZONE 'UTC') || '.' || month(to_timestamp(ts) AT TIME ZONE 'UTC') || '.' || oid, 'tag', oid, 'tag' FROM commits WHERE subject = '1-URGENT') """


def refs(spark, sf):
    return once(spark, sf, "refs", lambda: views.refs(spark, sf))


@query(REFS + "SELECT refname, oid::VARCHAR || ' ' || objecttype || chr(9) || regexp_replace(refname, '^refs/(heads|tags|remotes)/', '') AS line FROM refs WHERE refname LIKE 'refs/heads/%'")
def for_each_ref(spark, sf):
    """The branch listing under a format."""
    rows = refs(spark, sf).filter(patterns.ref_matches(F.col("refname"), "refs/heads"))
    atoms = {"refname": F.col("refname"), "objectname": F.col("oid"), "objecttype": F.col("objecttype")}
    return rows.select("refname", ops.format_column("%(objectname) %(objecttype)%09%(refname:short)", atoms).alias("line"))


@query(REFS + "SELECT refname, oid FROM refs WHERE regexp_matches(refname, '^refs/tags/v199[0-9]\\.1[^/]*$')")
def refs_glob(spark, sf):
    """Tags under a glob."""
    return refs(spark, sf).filter(patterns.ref_matches(F.col("refname"), "refs/tags/v199[0-9].1*")).select("refname", "oid")


@query(REFS + "SELECT r.refname, r.oid, h.refname AS head FROM refs r JOIN refs h ON h.kind = 'branch' AND h.oid = r.oid WHERE r.kind = 'tag'")
def refs_points_at(spark, sf):
    """Tags that point at the tip of a branch."""
    r = refs(spark, sf)
    head = r.filter("kind = 'branch'").select("oid", F.col("refname").alias("head"))
    return r.filter("kind = 'tag'").join(head, "oid").select("refname", "oid", "head")


_VKEY = """array_to_string(list_transform(regexp_split_to_array(refname, '[.-]'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '0' || lpad(s, 20, '0') ELSE '1' || s END), chr(1))"""


@query(REFS + f"SELECT refname, row_number() OVER (PARTITION BY kind ORDER BY {_VKEY} DESC, refname)::BIGINT AS place FROM refs WHERE kind = 'tag'")
def refs_version_sort(spark, sf):
    """Tags in descending order of their versions."""
    from pyspark.sql import Window

    order = ops.sort_keys(["-version:refname"])
    return refs(spark, sf).filter("kind = 'tag'").select("refname", F.row_number().over(Window.partitionBy("kind").orderBy(*order)).cast("long").alias("place"))


@query(REFS + "SELECT refname, oid, more FROM (SELECT *, count(*) OVER () > 25 AS more, row_number() OVER (ORDER BY refname) AS n FROM (SELECT * FROM refs WHERE refname > 'refs/heads/c5' ORDER BY refname LIMIT 26)) WHERE n <= 25")
def refs_start_after(spark, sf):
    """A page of 25 names behind a marker."""
    return ops.page_after(refs(spark, sf), "refs/heads/c5", 25).select("refname", "oid", "more")


@query(REFS + """, n AS (SELECT 'c' || o_custkey AS name FROM orders GROUP BY o_custkey UNION ALL SELECT 'heads/c' || o_custkey FROM orders GROUP BY o_custkey),
t AS (SELECT name, rule, replace(p, '{}', name) AS refname FROM n, (VALUES (0, '{}'), (1, 'refs/{}'), (2, 'refs/tags/{}'), (3, 'refs/heads/{}'), (4, 'refs/remotes/{}'), (5, 'refs/remotes/{}/HEAD')) r(rule, p))
SELECT name, arg_min(t.refname, rule) AS refname, arg_min(oid, rule) AS oid, count(*)::BIGINT AS matches FROM t JOIN refs ON refs.refname = t.refname GROUP BY name""")
def ref_dwim(spark, sf):
    """What short names stand for."""
    h = refs(spark, sf).filter("kind = 'branch'")
    names = h.select(F.explode(F.array(F.regexp_replace("refname", "^refs/heads/", ""), F.regexp_replace("refname", "^refs/", ""))).alias("name"))
    return ops.resolve_short(names, refs(spark, sf))


@query(REFS + "SELECT refname FROM refs WHERE regexp_matches(refname, '(^|/)c12$') OR regexp_matches(refname, '(^|/)heads/c13$')")
def refs_tail_match(spark, sf):
    name = F.col("refname")
    return refs(spark, sf).filter(patterns.tail_matches(name, "c12") | patterns.tail_matches(name, "heads/c13")).select("refname")


@query(REFS + """SELECT refname, CASE WHEN refname = 'refs/heads/c12' THEN false WHEN refname IN ('refs/heads/c1', 'refs/heads/c13') THEN true ELSE false END AS hidden FROM refs WHERE kind = 'branch'""")
def refs_hidden(spark, sf):
    """Hidden references: a rule fits a name or what goes on behind a slash, the last that fits decides, ! shows again."""
    rules = ["refs/heads/c1", "refs/heads/c12/", "^refs/heads/c13", "!refs/heads/c12"]
    return refs(spark, sf).filter("kind = 'branch'").select("refname", patterns.hidden_ref(F.col("refname"), rules).alias("hidden"))


@query(REFS + "SELECT refname, CASE WHEN oid = (SELECT max(oid) FROM refs WHERE kind = 'branch') THEN '*' ELSE ' ' END || ' ' || substr(refname, 12) AS line FROM refs WHERE kind = 'branch'")
def refs_head_marker(spark, sf):
    """Branches with a star at the one that is checked out."""
    rows = refs(spark, sf).filter("kind = 'branch'")
    head = rows.agg(F.max_by("refname", "oid").alias("head"))
    atoms = {"refname": F.col("refname"), "HEAD": F.when(F.col("refname") == F.col("head"), "*").otherwise(" ")}
    return rows.crossJoin(F.broadcast(head)).select("refname", ops.format_column("%(HEAD) %(refname:short)", atoms).alias("line"))


@query(REFS + """SELECT refname, coalesce(CASE WHEN refs.kind = 'tag' AND refs.oid % 2 = 0 THEN ts + 60 END, ts, 0)::BIGINT AS creator FROM refs LEFT JOIN commits ON commits.oid = refs.oid""")
def refs_creator_date(spark, sf):
    """The date of a tag's tagger, where it has one, else that of its commit."""
    tagger = F.when((F.col("kind") == "tag") & (F.col("oid") % 2 == 0), F.col("ts") + 60)
    return refs(spark, sf).join(commits(spark, sf).select("oid", "ts"), "oid", "left").select("refname", scalars.creator_date(tagger, F.col("ts")).alias("creator"))


@query(REFS + r"""SELECT refname, chr(39) || replace(refname, chr(39), chr(39) || '\' || chr(39) || chr(39)) || chr(39) || ' "' || refname || '"' AS line FROM (SELECT CASE WHEN oid % 3 = 0 THEN refname || chr(39) || 's' ELSE refname END AS refname FROM refs)""")
def refs_quoted(spark, sf):
    """Names quoted for a shell and for Tcl."""
    name = F.when(F.col("oid") % 3 == 0, F.concat("refname", F.lit("'s"))).otherwise(F.col("refname"))
    rows = refs(spark, sf).select(name.alias("refname"))
    return rows.select("refname", F.concat(scalars.host_quoted(F.col("refname"), "shell"), F.lit(" "), scalars.host_quoted(F.col("refname"), "tcl")).alias("line"))


@query(REFS + """SELECT refname, rpad(CASE WHEN kind = 'branch' THEN 'B' ELSE 'T' END, 3, ' ') || lpad(oid::VARCHAR, 8, ' ') || '|' || array_to_string(string_split(refname, '/')[3:], '/') AS line FROM refs""")
def refs_aligned(spark, sf):
    """A format with alignment, a condition and stripped components."""
    atoms = {"refname": F.col("refname"), "objectname": F.col("oid"), "objecttype": F.col("objecttype")}
    template = "%(align:3)%(if:equals=commit)%(objecttype)%(then)B%(else)T%(end)%(end)%(align:8,right)%(objectname)%(end)|%(refname:lstrip=2)"
    return refs(spark, sf).select("refname", ops.format_column(template, atoms).alias("line"))


@query(REFS + "SELECT commits.oid, string_agg(refname, ', ' ORDER BY refname) AS decoration FROM commits JOIN refs ON refs.oid = commits.oid GROUP BY commits.oid")
def log_decorations(spark, sf):
    """Commits that references name, with those."""
    return refs(spark, sf).join(commits(spark, sf).select("oid"), "oid").groupBy("oid").agg(F.array_join(F.array_sort(F.collect_list("refname")), ", ").alias("decoration"))


@query("""WITH o AS (SELECT DISTINCT sha1('commit ' || o_orderkey) AS id FROM orders),
n AS (SELECT id, lag(id) OVER (ORDER BY id) AS b, lead(id) OVER (ORDER BY id) AS a FROM o),
k AS (SELECT id, list_max(list_filter(range(0, 41), lambda i: substr(id, 1, i::BIGINT) = substr(coalesce(b, '-'), 1, i::BIGINT))) AS x,
  list_max(list_filter(range(0, 41), lambda i: substr(id, 1, i::BIGINT) = substr(coalesce(a, '-'), 1, i::BIGINT))) AS y FROM n)
SELECT id, substr(id, 1, greatest(4, x + 1, y + 1)::BIGINT) AS short FROM k""")
def abbrev_oid(spark, sf):
    """Shortest unique prefixes of at least four characters."""
    ids = views.load(spark, sf, "orders").select(F.sha1(F.concat(F.lit("commit "), "o_orderkey").cast("binary")).alias("id"))
    return ops.abbreviations(ids, "id", 4)


@query("SELECT c_custkey, 'refs/heads/' || replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '..' WHEN c_custkey % 3 = 1 THEN '/' ELSE '~' END) AS refname, c_custkey % 3 = 1 AS valid FROM customer")
def ref_name_validity(spark, sf):
    """Whether made-up names are valid as references."""
    k = F.col("c_custkey") % 3
    name = F.concat(F.lit("refs/heads/"), F.replace(F.col("c_name"), F.lit("#"), F.when(k == 0, "..").when(k == 1, "/").otherwise("~")))
    return views.load(spark, sf, "customer").select("c_custkey", name.alias("refname")).withColumn("valid", scalars.valid_ref_name(F.col("refname")))
