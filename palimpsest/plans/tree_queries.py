"""Queries over trees, ranges and lines, and over bitmaps of objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import diff, graph, parts, trees
from ..sources import views
from .content_queries import _RENAMES, DIFF, LINES, first_diffs, lines
from .graph_queries import FIRST, GRAPH, HEADS, LINEAGE, _TREE, chain, closure, commits, heads, pairs, parents, part, parted
from .registry import query

_VALUES = f"{_TREE}, val AS (SELECT oid, path, flag || content AS value FROM paths)"


def values(spark, sf):
    return views.paths(spark, sf).select("oid", "path", F.concat("flag", "content").alias("value"))


@query(GRAPH + f""", {_VALUES}, common AS (SELECT a, b, oid FROM sets WHERE in_a AND in_b),
best AS (SELECT a, b, min(oid) AS base FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN closure ON closure.tip = d.oid WHERE d.a = c.a AND d.b = c.b AND d.oid <> c.oid AND closure.oid = c.oid) GROUP BY a, b),
m AS (SELECT a, path, max(v) FILTER (s = 1) AS base, max(v) FILTER (s = 2) AS ours, max(v) FILTER (s = 3) AS theirs FROM (
  SELECT a, path, value AS v, 1 AS s FROM best JOIN val ON oid = base UNION ALL SELECT a, path, value, 2 FROM best JOIN val ON oid = a UNION ALL SELECT a, path, value, 3 FROM best JOIN val ON oid = b) GROUP BY a, path)
SELECT a AS key, path, base, ours, theirs, CASE WHEN ours IS NOT DISTINCT FROM theirs OR base IS NOT DISTINCT FROM ours OR base IS NOT DISTINCT FROM theirs THEN 'clean' ELSE 'conflict' END AS outcome
FROM m WHERE NOT (base IS NOT DISTINCT FROM ours AND base IS NOT DISTINCT FROM theirs)""")
def merge_trees_outcome(spark, sf):
    """Three-way merges of neighbouring branches over their merge base."""
    bases = graph.merge_bases(pairs(spark, sf), closure(spark, sf), parents(spark, sf)).groupBy("a", "b").agg(F.min("base").alias("base"))
    return trees.merge_trees(bases.select(F.col("a").alias("key"), "base", F.col("a").alias("ours"), F.col("b").alias("theirs")), values(spark, sf))


@query(GRAPH + f", {_VALUES} SELECT branch, count(*)::BIGINT AS n FROM (SELECT DISTINCT branch, path, value FROM heads JOIN closure ON tip = heads.oid JOIN val ON val.oid = closure.oid) GROUP BY branch")
def rev_list_objects(spark, sf):
    """How many distinct blobs each branch reaches."""
    tips = heads(spark, sf).select(F.col("oid").alias("tip"), "branch")
    return trees.reachable_objects(tips, closure(spark, sf), values(spark, sf), ["branch"]).groupBy("branch").agg(F.count("*").alias("n"))


@query(DIFF + """, f AS (SELECT diffs.oid, path FROM diffs JOIN parents p ON p.oid = diffs.oid AND p.parent = diffs.parent AND ord = 1 WHERE status IS NOT NULL)
SELECT oid, count(DISTINCT x)::BIGINT AS n FROM (SELECT oid, path AS x FROM f UNION ALL SELECT oid, split_part(path, '/', 1) FROM f) GROUP BY oid""")
def changed_path_prefixes(spark, sf):
    """How many paths and directories each commit changes."""
    return trees.changed_prefixes(first_diffs(spark, sf).select("oid", "path")).groupBy("oid").agg(F.count("*").alias("n"))


@query(LINEAGE + """, r AS (SELECT oid AS old, parent AS new FROM parents WHERE ord = 1 AND oid % 4 = 0),
w AS (SELECT old, new, 1 AS n FROM r UNION ALL SELECT w.old, r.new, n + 1 FROM w JOIN r ON r.old = w.new),
l AS (SELECT old, arg_max(new, n) AS new FROM w GROUP BY old)
SELECT parents.oid, ord::INT AS ord, coalesce(new, parent) AS parent FROM parents LEFT JOIN l ON old = parent""")
def replaced_parents(spark, sf):
    """The parent table when every fourth commit is replaced by its first parent."""
    p = parents(spark, sf)
    swaps = p.filter("ord = 1 and oid % 4 = 0").select(F.col("oid").alias("old"), F.col("parent").alias("new"))
    return trees.replace_objects(p, swaps, "parent").select("oid", "ord", "parent")


@query("""WITH r AS (SELECT l_orderkey AS file, (l_partkey % 100)::BIGINT AS b, (l_partkey % 100 + 1 + l_suppkey % 12)::BIGINT AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
i AS (SELECT *, sum(CASE WHEN far IS NULL OR b > far THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT file, min(b) AS begin, max(e) AS "end" FROM i GROUP BY file, k""")
def line_ranges_merged(spark, sf):
    """Unions of line ranges of each file."""
    begin = (F.col("l_partkey") % 100).cast("long")
    r = views.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), begin.alias("begin"), (begin + 1 + F.col("l_suppkey") % 12).alias("end"))
    return trees.merge_ranges(r, ["file"])


@query(f"""WITH {LINES} SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header FROM lines""")
def function_headers(spark, sf):
    """For each line the nearest header line above it."""
    return trees.function_headers(lines(spark, sf), ["doc_id"], "^[A-Z][a-z]+ ").select("doc_id", "line_no", "header")


@query(f"""WITH {LINES}, x AS (SELECT CASE line_no % 4 WHEN 0 THEN repeat(' ', 8) WHEN 1 THEN ' ' || chr(9) ELSE '' END || line || CASE WHEN line_no % 3 = 0 THEN '  ' ELSE '' END AS line FROM lines),
e AS (SELECT 'blank-at-eol' AS kind FROM x WHERE regexp_matches(line, '[ \\t]+$') UNION ALL SELECT 'space-before-tab' FROM x WHERE regexp_matches(line, '^[ \\t]* \\t') UNION ALL SELECT 'indent-with-non-tab' FROM x WHERE regexp_matches(line, '^ {{8,}}'))
SELECT kind, count(*)::BIGINT AS n FROM e GROUP BY kind""")
def whitespace_errors(spark, sf):
    """White-space errors by kind, of lines that some blanks are added to."""
    before = F.when(F.col("line_no") % 4 == 0, F.repeat(F.lit(" "), F.lit(8))).when(F.col("line_no") % 4 == 1, " \t").otherwise("")
    x = lines(spark, sf).select(F.concat(before, "line", F.when(F.col("line_no") % 3 == 0, "  ").otherwise("")).alias("line"))
    return x.select(F.explode(trees.whitespace_errors(F.col("line"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(DIFF + f""", {_RENAMES}, {FIRST.replace("chain AS", "walked AS").replace("chain.", "walked.").replace("FROM chain", "FROM walked")}, {HEADS},
followed AS (SELECT heads.oid AS tip, heads.oid AS oid, 'b1/t1' AS path, 0::BIGINT AS depth FROM heads
  UNION ALL SELECT f.tip, w.oid, coalesce(r.old_path, f.path), f.depth + 1 FROM followed f JOIN walked w ON w.tip = f.tip AND w.depth = f.depth + 1 LEFT JOIN renames r ON r.oid = f.oid AND r.new_path = f.path)
SELECT tip, oid, path FROM followed""")
def follow_renames(spark, sf):
    """The name of one file along each branch, renames followed backwards."""
    start = heads(spark, sf).select(F.col("oid").alias("tip"), F.lit("b1/t1").alias("path"))
    return trees.follow(start, chain(spark, sf), diff.exact_renames(first_diffs(spark, sf)))


@query(f"""{LINEAGE}, {_VALUES}, s AS (SELECT h.oid, coalesce(h.path, w.path) AS path, h.value AS head, CASE WHEN length(coalesce(h.path, w.path)) % 2 = 1 OR h.path LIKE 'b1%' THEN h.value ELSE w.value END AS index, w.value AS work
  FROM (SELECT commits.oid, p1, path, value FROM commits JOIN val ON val.oid = p1) h FULL JOIN (SELECT commits.oid, path, value FROM commits JOIN val ON val.oid = commits.oid WHERE p1 IS NOT NULL) w ON h.oid = w.oid AND h.path = w.path)
SELECT path, count(*) FILTER (head IS DISTINCT FROM index)::BIGINT AS staged, count(*) FILTER (index IS NOT NULL AND index IS DISTINCT FROM work)::BIGINT AS unstaged,
  count(*) FILTER (index IS NULL AND head IS NULL AND work IS NOT NULL)::BIGINT AS untracked, count(*) FILTER (head IS DISTINCT FROM index) + count(*) FILTER (index IS NOT NULL AND index IS DISTINCT FROM work) + count(*) FILTER (index IS NULL AND head IS NULL AND work IS NOT NULL) = 0 AS clean
FROM s GROUP BY path""")
def status_summary(spark, sf):
    """Staged, unstaged and untracked states by path, the parent being the head, a mixture the index, the commit the work."""
    c = commits(spark, sf).filter("p1 is not null")
    h = c.select("oid", F.col("p1").alias("at")).join(values(spark, sf).withColumnRenamed("oid", "at"), "at").select("oid", "path", F.col("value").alias("head"))
    w = c.select("oid").join(values(spark, sf), "oid").withColumnRenamed("value", "work")
    met = h.join(w, ["oid", "path"], "full")
    taken = F.when((F.length("path") % 2 == 1) | (F.col("head").isNotNull() & F.col("path").startswith("b1")), F.col("head")).otherwise(F.col("work"))
    return trees.status_summary(met.withColumn("index", taken), ["path"])


@query(GRAPH + "SELECT branch, count(DISTINCT closure.oid)::BIGINT AS n FROM heads JOIN closure ON tip = heads.oid GROUP BY branch")
def reachability_bitmaps(spark, sf):
    """Sizes of the branches' reach, counted on the bitmaps of their group."""
    tips = heads(spark, sf).select(part(spark, sf).alias("part"), F.col("oid").alias("tip"), F.col("oid").alias("name"))
    sizes = parts.counted(tips, *parted(spark, sf))
    return heads(spark, sf).select("branch", F.col("oid").alias("name")).join(sizes, "name").groupBy("branch").agg(F.sum("n").alias("n"))


@query(GRAPH + "SELECT grp, count(DISTINCT closure.oid)::BIGINT AS n FROM heads JOIN closure ON tip = heads.oid GROUP BY grp")
def bitmap_union(spark, sf):
    """Sizes of unions of bitmaps; a group goes by the smallest of its tips."""
    h = heads(spark, sf).select("grp", part(spark, sf).alias("part"), F.col("oid").alias("tip"))
    named = h.groupBy("grp").agg(F.min("tip").alias("name"))
    tips = h.withColumn("name", F.min("tip").over(Window.partitionBy("grp"))).select("part", "tip", "name")
    return named.join(parts.counted(tips, *parted(spark, sf)), "name").select("grp", "n")


@query("""SELECT (SELECT count(*) FROM orders)::BIGINT AS n_objects, (SELECT sum(octet_length(encode(o_orderpriority))) FROM orders)::BIGINT AS bytes,
(SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))::BIGINT AS in_pack, (SELECT count(DISTINCT l_suppkey) FROM lineitem)::BIGINT AS packs""")
def count_objects(spark, sf):
    """One row about loose and packed objects."""
    o, li = views.load(spark, sf, "orders"), views.load(spark, sf, "lineitem")
    loose = o.agg(F.count("*").alias("n_objects"), F.sum(F.octet_length("o_orderpriority")).alias("bytes"))
    packed = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_semi").agg(F.count("*").alias("in_pack"))
    return loose.join(F.broadcast(packed)).join(F.broadcast(li.agg(F.countDistinct("l_suppkey").alias("packs"))))


@query("SELECT doc_id, source, lpad(source, 12, ' ') || chr(9) || n_chars AS line FROM documents")
def column_line(spark, sf):
    """A padded listing line."""
    d = views.load(spark, sf, "documents")
    return d.select("doc_id", "source", F.concat(F.lpad("source", 12, " "), F.lit("\t"), F.col("n_chars").cast("string")).alias("line"))


@query("""WITH w AS (SELECT DISTINCT c_mktsegment AS word FROM customer), p AS (SELECT DISTINCT p_type AS known FROM part),
d AS (SELECT word, known, levenshtein(word, known)::BIGINT AS distance FROM w, p)
SELECT word, known, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, known) AS k FROM d) WHERE k = 1""")
def nearest_words(spark, sf):
    """The known word nearest to each: a few dozen words on either side, by their nature."""
    words = views.load(spark, sf, "customer").select(F.col("c_mktsegment").alias("word")).distinct()
    known = views.load(spark, sf, "part").select(F.col("p_type").alias("known")).distinct().agg(F.array_sort(F.collect_set("known")).alias("all"))
    tried = words.join(F.broadcast(known)).select("word", F.explode("all").alias("known"))
    scored = tried.withColumn("distance", F.levenshtein("word", "known").cast("long"))
    return scored.groupBy("word").agg(F.min_by(F.struct("known", "distance"), F.struct("distance", "known")).alias("x")).select("word", "x.*")


@query(DIFF + """ SELECT oid, parent, path, ':' || CASE WHEN old_flag IS NULL THEN '000000' ELSE '100644' END || ' ' || CASE WHEN new_flag IS NULL THEN '000000' ELSE '100644' END || ' ' || coalesce(old_content::VARCHAR, '0') || ' ' || coalesce(new_content::VARCHAR, '0') || ' ' || status || chr(9) || path AS line
FROM diffs WHERE status IS NOT NULL""")
def raw_diff_lines(spark, sf):
    """Raw diff records of all changes."""
    from .content_queries import diffs

    mode = lambda c: F.when(F.col(c).isNull(), "000000").otherwise(scalars.octal_mode(F.lit(0o100644)))
    blob = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    line = F.concat(F.lit(":"), mode("old_flag"), F.lit(" "), mode("new_flag"), F.lit(" "), blob("old_content"), F.lit(" "), blob("new_content"), F.lit(" "), "status", F.lit("\t"), scalars.c_quoted(F.col("path")))
    return diffs(spark, sf).select("oid", "parent", "path", line.alias("line"))
