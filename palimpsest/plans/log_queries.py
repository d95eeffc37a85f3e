"""Queries over logs and summaries: authors, identities, statistics, reference logs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import log, objects
from ..sources import views
from ..streaming import reflog as stream
from .graph_queries import CLOSURE, GRAPH, HEADS, LINEAGE, _DOWN, _GEN, _TREE, closure, commits, generations, heads
from .registry import query
from .storage import once

REFLOG = """WITH reflog AS (SELECT user_id AS ref, row_number() OVER w AS seq, lag(event_id) OVER w AS old_id, event_id AS new_id, floor(epoch(ts))::BIGINT AS ts, event_type AS action, props AS note
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY events.ts, event_id)) """


def reflog(spark, sf):
    return once(spark, sf, "reflog", lambda: views.reflog(spark, sf))


@query(LINEAGE + "SELECT c_name AS key, count(*)::BIGINT AS n, max(ts * 1000000000 + oid) % 1000000000 AS newest FROM commits JOIN customer ON c_custkey = branch GROUP BY c_name")
def shortlog_author(spark, sf):
    """Commits and the newest one by author."""
    author = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("branch"), "c_name")
    return log.shortlog(commits(spark, sf).join(author, "branch"), F.array("c_name"))


@query(LINEAGE + """, k AS (SELECT oid, ts, 'subject ' || subject AS key FROM commits UNION SELECT oid, ts, 'kind ' || kind FROM commits UNION SELECT oid, ts, 'year ' || year(to_timestamp(ts) AT TIME ZONE 'UTC') FROM commits)
SELECT key, count(*)::BIGINT AS n, max(ts * 1000000000 + oid) % 1000000000 AS newest FROM k GROUP BY key""")
def shortlog_multi_group(spark, sf):
    """Commits under each of several keys."""
    keys = F.array(F.concat(F.lit("subject "), "subject"), F.concat(F.lit("kind "), "kind"), F.concat(F.lit("year "), F.year(F.timestamp_seconds("ts")).cast("string")))
    return log.shortlog(commits(spark, sf), keys)


@query(LINEAGE + """, t AS (SELECT oid, unnest([struct_pack(key := 'Reviewed-by', value := 'C' || branch % 5), struct_pack(key := 'Signed-off-by', value := kind)]) AS t FROM commits WHERE oid % 4 <> 0)
SELECT t.key AS key, t.value AS value, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def shortlog_trailer(spark, sf):
    """Commits by the trailers of their messages; a last paragraph with other lines has none."""
    good = F.concat("subject", F.lit("\n\nbody\n\nReviewed-by: C"), F.col("branch") % 5, F.lit("\nSigned-off-by: "), "kind")
    message = F.when(F.col("oid") % 4 == 0, F.concat("subject", F.lit("\n\nno trailer here"))).otherwise(good)
    rows = commits(spark, sf).select(F.explode(scalars.trailers(message)).alias("t"))
    return rows.groupBy("t.key", "t.value").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Account ' || c_custkey ELSE n_name END AS proper_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def mailmap_apply(spark, sf):
    """Proper names of customers by address, and by name and address."""
    who = views.load(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("n"), "c_nationkey", F.lit("@example.org")).alias("email"))
    return log.apply_mailmap(who, views.mailmap(spark, sf)).select("c_custkey", "proper_name")


@query("""SELECT coalesce(type, 'all') AS type, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, max(size)::BIGINT AS largest FROM (
  SELECT 'blob' AS type, octet_length(encode(text)) AS size FROM documents UNION ALL SELECT 'commit', octet_length(encode(o_orderpriority)) FROM orders UNION ALL SELECT 'entry', octet_length(encode(l_returnflag)) FROM lineitem)
GROUP BY ROLLUP (type)""")
def repo_structure(spark, sf):
    """Numbers and sizes of objects by type, with a total."""
    parts = [("documents", "text", "blob"), ("orders", "o_orderpriority", "commit"), ("lineitem", "l_returnflag", "entry")]
    rows = None
    for name, column, kind in parts:
        part = views.load(spark, sf, name).select(F.lit(kind).alias("type"), F.octet_length(column).cast("long").alias("size"))
        rows = part if rows is None else rows.union(part)
    out = rows.rollup("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return out.withColumn("type", F.coalesce("type", F.lit("all")))


@query(GRAPH + f""", {_TREE}, s AS (SELECT commits.oid, 100 + 10 * count(path) AS size FROM commits LEFT JOIN paths ON paths.oid = commits.oid GROUP BY commits.oid)
SELECT tip, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM heads JOIN closure ON tip = heads.oid JOIN s ON s.oid = closure.oid GROUP BY tip""")
def disk_usage_by_ref(spark, sf):
    """Sizes of all objects that each branch reaches."""
    n = views.paths(spark, sf).groupBy("oid").agg(F.count("*").alias("n"))
    sizes = commits(spark, sf).join(n, "oid", "left").select("oid", (100 + 10 * F.coalesce("n", F.lit(0))).alias("size"))
    return objects.disk_usage(heads(spark, sf).select(F.col("oid").alias("tip")), closure(spark, sf), sizes)


@query(f"{LINEAGE}, {_DOWN}, {_GEN} SELECT generation::BIGINT AS depth, count(*)::BIGINT AS n FROM gen GROUP BY generation")
def pack_depth_histogram(spark, sf):
    """How many objects stand at each chain depth."""
    return generations(spark, sf).groupBy(F.col("generation").alias("depth")).agg(F.count("*").alias("n"))


@query(LINEAGE + """, p AS (SELECT grp, branch, count(*) AS weight FROM commits GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS k, coalesce(sum(weight) OVER (PARTITION BY grp ORDER BY weight, branch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WINDOW w AS (PARTITION BY grp ORDER BY weight, branch)),
l AS (SELECT *, coalesce(max(CASE WHEN weight < 2 * before THEN k END) OVER (PARTITION BY grp), 0) AS last FROM k)
SELECT grp, count(*) FILTER (k <= last)::BIGINT AS n_rolled, coalesce(sum(weight) FILTER (k <= last), 0)::BIGINT AS weight FROM l GROUP BY grp""")
def pack_geometry_split(spark, sf):
    """Which packs of a group roll up into one, so that sizes grow geometrically."""
    packs = commits(spark, sf).groupBy("grp", F.col("branch").alias("pack")).agg(F.count("*").alias("weight"))
    return objects.geometry_split(packs, ["grp"])


@query(REFLOG + """, p AS (SELECT (ref + 1) % 150 AS ref, new_id AS probe, ts - 3600 AS asked FROM reflog)
SELECT p.ref, probe, asked AS "at", r.new_id FROM p ASOF LEFT JOIN (SELECT ref, ts, arg_max(new_id, seq) AS new_id FROM reflog GROUP BY ref, ts) r ON r.ref = p.ref AND p.asked >= r.ts""")
def reflog_as_of(spark, sf):
    """Values of references at given times."""
    r = reflog(spark, sf)
    probes = r.select(((F.col("ref") + 1) % 150).alias("ref"), F.col("new_id").alias("probe"), (F.col("ts") - 3600).alias("at"))
    return log.as_of(r, probes)


@query(REFLOG + ", n AS (SELECT max(ts) AS now FROM reflog) SELECT ref, seq, new_id FROM reflog, n WHERE now - ts <= 864000 AND (action <> 'error' OR now - ts <= 259200)")
def reflog_expire(spark, sf):
    """Entries that expiry leaves, unreachable ones going sooner."""
    r = reflog(spark, sf)
    now = r.agg(F.max("ts").alias("now"))
    kept = log.expire(r.join(F.broadcast(now)), F.col("now"), 864000, 259200, F.col("action") == "error")
    return kept.select("ref", "seq", "new_id")


@query(REFLOG + "SELECT ref, n, new_id FROM (SELECT ref, (row_number() OVER (PARTITION BY ref ORDER BY seq DESC) - 1)::BIGINT AS n, new_id FROM reflog) WHERE n < 3")
def reflog_selector(spark, sf):
    return log.selector(reflog(spark, sf), 3)


@query(REFLOG + "SELECT ref, seq, old_id, new_id FROM reflog")
def reflog_walk(spark, sf):
    """Each entry with the value before it."""
    return reflog(spark, sf).select("ref", "seq", "old_id", "new_id")


@query(REFLOG + "SELECT new_id, (note->>'$.k')::BIGINT AS k, '{\"ref\":' || ref || ',\"k\":' || (note->>'$.k') || '}' AS line FROM reflog")
def json_project(spark, sf):
    """A value out of a JSON note, and a line of JSON."""
    r = reflog(spark, sf)
    k = F.get_json_object("note", "$.k").cast("long")
    return r.select("new_id", k.alias("k"), F.to_json(F.struct("ref", k.alias("k"))).alias("line"))


_IDENT = "CASE WHEN c_custkey % 11 = 0 THEN 'bogus' WHEN c_custkey % 13 = 0 THEN '18446744073709551617' ELSE (c_custkey * 100000)::VARCHAR END"


@query(f"""SELECT c_custkey, c_name AS name, 'n' || c_nationkey || '@example.org' AS email,
  CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 0 ELSE c_custkey * 100000 END AS ts, CASE WHEN c_custkey % 2 = 0 THEN 19800 ELSE -25200 END AS tz_secs,
  CASE WHEN c_custkey % 11 = 0 THEN 'NonNumeric' WHEN c_custkey % 13 = 0 THEN 'Overflow' ELSE 'Valid' END AS ts_status FROM customer""")
def ident_parse(spark, sf):
    """Identity lines taken apart."""
    k = F.col("c_custkey")
    stamp = F.when(k % 11 == 0, "bogus").when(k % 13 == 0, "18446744073709551617").otherwise((k * 100000).cast("string"))
    text = F.concat("c_name", F.lit(" <n"), "c_nationkey", F.lit("@example.org> "), stamp, F.when(k % 2 == 0, " +0530").otherwise(" -0700"))
    return views.load(spark, sf, "customer").select("c_custkey", scalars.ident(text).alias("x")).select("c_custkey", "x.*")


_AT = "(to_timestamp(ts + tz) AT TIME ZONE 'UTC')"
_ZONE = "CASE tz WHEN 0 THEN '+00{c}00' WHEN 19800 THEN '+05{c}30' ELSE '-08{c}00' END"


@query(LINEAGE + f""", z AS (SELECT oid, ts, CASE branch % 3 WHEN 0 THEN 0 WHEN 1 THEN 19800 ELSE -28800 END AS tz FROM commits)
SELECT oid, strftime({_AT}, '%Y-%m-%d') AS short, strftime({_AT}, '%Y-%m-%d %H:%M:%S ') || {_ZONE.format(c="")} AS iso,
  strftime({_AT}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN tz = 0 THEN 'Z' ELSE {_ZONE.format(c=":")} END AS iso_strict,
  strftime({_AT}, '%a, %-d %b %Y %H:%M:%S ') || {_ZONE.format(c="")} AS rfc, ts || ' ' || {_ZONE.format(c="")} AS raw, ts::VARCHAR AS unix FROM z""")
def date_modes(spark, sf):
    """Commit times in all fixed formats."""
    tz = F.when(F.col("branch") % 3 == 0, 0).when(F.col("branch") % 3 == 1, 19800).otherwise(-28800)
    modes = scalars.date_modes(F.col("ts"), F.col("tz"))
    return commits(spark, sf).withColumn("tz", tz).select("oid", *[c.alias(n) for n, c in modes.items()])


@query(LINEAGE + """, a AS (SELECT oid, 1000000000 - ts AS age FROM commits), u AS (SELECT oid, age, CASE WHEN age >= 31536000 THEN 31536000 WHEN age >= 2592000 THEN 2592000 WHEN age >= 604800 THEN 604800 WHEN age >= 86400 THEN 86400 WHEN age >= 3600 THEN 3600 WHEN age >= 60 THEN 60 ELSE 1 END AS s FROM a)
SELECT oid, CASE WHEN age < 0 THEN 'in the future' ELSE (age // s) || CASE s WHEN 31536000 THEN ' year' WHEN 2592000 THEN ' month' WHEN 604800 THEN ' week' WHEN 86400 THEN ' day' WHEN 3600 THEN ' hour' WHEN 60 THEN ' minute' ELSE ' second' END || CASE WHEN age // s = 1 THEN '' ELSE 's' END || ' ago' END AS shown FROM u""")
def relative_date(spark, sf):
    return commits(spark, sf).select("oid", scalars.relative_date(F.col("ts"), 1_000_000_000).alias("shown"))


@query(LINEAGE + """, s AS (SELECT oid, CASE oid % 3 WHEN 0 THEN subject WHEN 1 THEN 'Revert "' || subject || '"' ELSE 'Reapply "' || subject || '"' END AS subject FROM commits)
SELECT oid, CASE oid % 3 WHEN 1 THEN replace(subject, 'Revert', 'Reapply') ELSE 'Revert "' || subject || '"' END AS shown FROM s""")
def revert_subject(spark, sf):
    subject = F.when(F.col("oid") % 3 == 0, F.col("subject")).when(F.col("oid") % 3 == 1, F.concat(F.lit('Revert "'), "subject", F.lit('"'))).otherwise(F.concat(F.lit('Reapply "'), "subject", F.lit('"')))
    return commits(spark, sf).select("oid", scalars.revert_subject(subject).alias("shown"))


@query("SELECT conv_id, role, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL")
def thread_roles(spark, sf):
    """Messages of each thread by role."""
    return views.load(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT floor(epoch(date_trunc('day', ts)))::BIGINT AS begin, event_type AS action, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL""")
def reflog_stream_windows(spark, sf):
    """A stream of log entries in daily windows, drained."""
    return stream.drained(stream.windows(stream.event_stream(spark, sf)), "complete")


@query("""WITH e AS (SELECT user_id AS ref, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT ref, ts, sum(new) OVER (PARTITION BY ref ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT ref, floor(epoch(min(ts)))::BIGINT AS begin, count(*)::BIGINT AS n FROM s GROUP BY ref, k""")
def reflog_sessions(spark, sf):
    """Sessions of log entries."""
    return stream.sessions(views.load(spark, sf, "events"))


@query("SELECT event_id, user_id AS ref, c_name AS owner FROM events LEFT JOIN customer ON c_custkey = user_id")
def reflog_stream_annotated(spark, sf):
    """A stream of log entries joined with a static table of owners, drained."""
    owner = views.load(spark, sf, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_name").alias("owner"))
    events = stream.event_stream(spark, sf).select("event_id", F.col("user_id").alias("ref"))
    return stream.drained(stream.annotated(events, owner, "ref").select("event_id", "ref", "owner"))


@query(REFLOG + "SELECT ref, count(*)::BIGINT AS n, arg_max(new_id, seq) AS last_id FROM reflog GROUP BY ref")
def reflog_stream_state(spark, sf):
    """Numbers of entries and newest values by reference, from state that a stream keeps; the last state of each."""
    told = stream.drained(stream.running_values(stream.event_stream(spark, sf)), "update")
    return told.groupBy("ref").agg(F.max("n").alias("n"), F.max_by("last_id", "n").alias("last_id"))
