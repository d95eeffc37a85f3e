"""Queries over trees, blobs and their versions: diffs, renames, search, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns, scalars
from ..operators import diff
from ..sources import views
from .graph_queries import GRAPH, LINEAGE, _TREE, closure, commits, heads, parents
from .registry import query
from .storage import once

DIFF = f"""{LINEAGE}, {_TREE}, diffs AS (
  SELECT coalesce(n.oid, o.oid) AS oid, coalesce(n.parent, o.parent) AS parent, coalesce(n.path, o.path) AS path, o.flag AS old_flag, n.flag AS new_flag, o.content AS old_content, n.content AS new_content,
    CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' WHEN o.flag <> n.flag THEN 'T' WHEN o.content <> n.content THEN 'M' END AS status
  FROM (SELECT parents.oid, parent, path, flag, content FROM parents JOIN paths ON paths.oid = parents.oid) n
  FULL JOIN (SELECT parents.oid, parent, path, flag, content FROM parents JOIN paths ON paths.oid = parent) o ON n.oid = o.oid AND n.parent = o.parent AND n.path = o.path)"""
LINES = """lines AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) , LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""
VERSIONS = f"""WITH {LINES}, versions AS (
  SELECT doc_id, v AS version, line_no, line FROM lines, (SELECT unnest(range(0, 4)) AS v) WHERE (line_no + v) % 5 <> 0
  UNION ALL SELECT doc_id, v, 1000 + v, 'edit ' || v FROM documents, (SELECT unnest(range(1, 4)) AS v)),
cnt AS (SELECT doc_id, version, line, count(*) AS n FROM versions GROUP BY ALL),
changes AS (SELECT doc_id, version, line, greatest(sum(n) - sum(m), 0)::BIGINT AS added, greatest(sum(m) - sum(n), 0)::BIGINT AS deleted FROM (
  SELECT doc_id, version, line, n, 0 AS m FROM cnt WHERE version > 0 UNION ALL SELECT doc_id, version + 1, line, 0, n FROM cnt WHERE version < 3)
  GROUP BY doc_id, version, line HAVING sum(n) <> sum(m)) """


def diffs(spark, sf):
    return once(spark, sf, "diffs", lambda: diff.tree_diff(parents(spark, sf).select("oid", "parent"), views.paths(spark, sf)))


def lines(spark, sf):
    return once(spark, sf, "lines", lambda: views.blob_lines(spark, sf))


def versions(spark, sf):
    return once(spark, sf, "versions", lambda: views.versions(spark, sf))


def changes(spark, sf):
    return once(spark, sf, "changes", lambda: diff.changed_lines(views.versions(spark, sf)))


@query(DIFF + " SELECT oid, parent, path, status FROM diffs WHERE status IS NOT NULL")
def tree_diff_name_status(spark, sf):
    """Changed paths of every commit against each of its parents."""
    return diffs(spark, sf).select("oid", "parent", "path", "status")


@query(DIFF + " SELECT oid, parent, path, old_flag, new_flag FROM diffs WHERE status = 'T'")
def tree_diff_type_change(spark, sf):
    return diffs(spark, sf).filter("status = 'T'").select("oid", "parent", "path", "old_flag", "new_flag")


@query(DIFF + """ SELECT d.oid, path, string_agg(status, '' ORDER BY ord) AS statuses FROM diffs d JOIN parents p ON p.oid = d.oid AND p.parent = d.parent
WHERE status IS NOT NULL GROUP BY d.oid, path HAVING count(*) = (SELECT count(*) FROM parents q WHERE q.oid = d.oid) AND count(*) > 1""")
def combined_diff_paths(spark, sf):
    """Paths of merges that differ from all parents."""
    return diff.combined(diffs(spark, sf), parents(spark, sf))


_FIRST = "f AS (SELECT diffs.* FROM diffs JOIN parents p ON p.oid = diffs.oid AND p.parent = diffs.parent AND p.ord = 1)"
_RENAMES = f"""{_FIRST}, renames AS (SELECT x.oid, x.path AS old_path, y.path AS new_path FROM
  (SELECT *, row_number() OVER (PARTITION BY oid, old_flag, old_content ORDER BY path) AS k FROM f WHERE status = 'D') x JOIN
  (SELECT *, row_number() OVER (PARTITION BY oid, new_flag, new_content ORDER BY path) AS k FROM f WHERE status = 'A') y
  ON x.oid = y.oid AND x.old_flag = y.new_flag AND x.old_content = y.new_content AND x.k = y.k)"""


def first_diffs(spark, sf):
    return diffs(spark, sf).join(parents(spark, sf).filter("ord = 1").select("oid", "parent"), ["oid", "parent"])


@query(DIFF + f", {_RENAMES} SELECT oid, old_path, new_path FROM renames")
def exact_renames(spark, sf):
    """Renames without a change, against the first parent."""
    return diff.exact_renames(first_diffs(spark, sf))


@query(DIFF + f""", {_RENAMES}, d AS (SELECT oid, split_part(old_path, '/', 1) AS old_dir, split_part(new_path, '/', 1) AS new_dir FROM renames),
v AS (SELECT oid, old_dir, new_dir, count(*)::BIGINT AS votes FROM d WHERE old_dir <> new_dir GROUP BY oid, old_dir, new_dir)
SELECT oid, old_dir, new_dir, votes FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.oid = v.oid AND o.old_dir = v.old_dir AND o.new_dir <> v.new_dir AND o.votes >= v.votes)""")
def directory_rename_vote(spark, sf):
    return diff.directory_votes(diff.exact_renames(first_diffs(spark, sf)), ["oid"])


@query(DIFF + " SELECT oid, parent, path FROM diffs WHERE old_content = 3 AND new_content IS DISTINCT FROM 3 OR new_content = 3 AND old_content IS DISTINCT FROM 3")
def find_object(spark, sf):
    """Changes that take a given blob in or out."""
    return diffs(spark, sf).filter("(old_content <=> 3) <> (new_content <=> 3)").select("oid", "parent", "path")


@query(f"""WITH {LINES}, d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(string_split(text, chr(10)))) AS rep, len(string_split(text, chr(10))) AS size FROM documents),
k AS (SELECT line, lines.doc_id, size, count(*) AS n FROM lines JOIN d ON d.doc_id = lines.doc_id WHERE d.doc_id = rep GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, greatest(x.size, y.size) AS size, sum(least(x.n, y.n)) AS shared FROM k x JOIN k y ON x.line = y.line AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, (shared * 60000 // size)::BIGINT AS score FROM p WHERE shared * 60000 // size >= 30000 UNION ALL SELECT rep, doc_id, 60000 FROM d WHERE doc_id <> rep""")
def similarity_renames(spark, sf):
    """Pairs of blobs that share half of their lines or more; equal blobs are paired with the first of them only."""
    return diff.line_similarity(lines(spark, sf), 30000)


@query(VERSIONS + "SELECT doc_id, version, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM changes GROUP BY ALL")
def numstat_lines(spark, sf):
    return diff.numstat(changes(spark, sf))


@query(VERSIONS + """, o AS (SELECT doc_id, version, sum((length(line) - length(replace(line, 'tion', ''))) // 4)::BIGINT AS n FROM versions GROUP BY ALL)
SELECT x.doc_id, x.version, y.n AS before, x.n AS after FROM o x JOIN o y ON y.doc_id = x.doc_id AND y.version = x.version - 1 WHERE x.n <> y.n""")
def pickaxe_count(spark, sf):
    """Versions that change how often a string occurs."""
    n = versions(spark, sf).groupBy("doc_id", "version").agg(F.sum(diff.occurrences(F.col("line"), "tion")).alias("after"))
    before = n.select("doc_id", (F.col("version") + 1).alias("version"), F.col("after").alias("before"))
    return n.join(before, ["doc_id", "version"]).filter("before <> after").select("doc_id", "version", "before", "after")


@query(VERSIONS + "SELECT DISTINCT doc_id, version FROM changes WHERE regexp_matches(line, '[0-9]{3}')")
def pickaxe_regex(spark, sf):
    """Versions with a changed line that fits an expression."""
    return changes(spark, sf).filter(F.col("line").rlike("[0-9]{3}")).select("doc_id", "version").distinct()


@query(VERSIONS + """, x AS (SELECT doc_id, version, CASE WHEN added > 0 THEN '+' ELSE '-' END || regexp_replace(line, '[ \\t\\r]', '', 'g') AS x FROM changes)
SELECT doc_id, version, sha1(string_agg(x, chr(10) ORDER BY x)) AS patch_id FROM x GROUP BY ALL""")
def patch_id_stable(spark, sf):
    return diff.patch_id(changes(spark, sf))


@query(VERSIONS + """SELECT doc_id, line_no, (coalesce(list_max(list_filter([0, 1, 2], lambda v: NOT list_contains(vs, v))), -1) + 1)::BIGINT AS origin
FROM (SELECT doc_id, line_no, line, list(DISTINCT version) AS vs FROM versions GROUP BY ALL) WHERE list_contains(vs, 3)""")
def blame_linear(spark, sf):
    """For each line of the last version the version it came with."""
    return diff.continuous_origin(versions(spark, sf), 3)


@query(GRAPH + f""", {_TREE}, d AS (
  SELECT coalesce(n.oid, o.oid) AS oid, coalesce(n.path, o.path) AS path FROM (SELECT commits.oid, p1, path, flag, content FROM commits JOIN paths ON paths.oid = commits.oid) n
  FULL JOIN (SELECT commits.oid, path, flag, content FROM commits JOIN paths ON paths.oid = p1) o ON n.oid = o.oid AND n.path = o.path
  WHERE n.path IS NULL OR o.path IS NULL OR n.flag <> o.flag OR n.content <> o.content)
SELECT tip, path, max(ts * 1000000000 + d.oid) % 1000000000 AS oid FROM heads JOIN closure ON tip = heads.oid JOIN d ON d.oid = closure.oid JOIN commits ON commits.oid = d.oid GROUP BY tip, path""")
def last_modified(spark, sf):
    """For each branch and path the newest commit that changed it against its first parent."""
    touched = first_diffs(spark, sf).select("oid", "path")
    roots = commits(spark, sf).filter("p1 is null").select("oid").join(views.paths(spark, sf), "oid").select("oid", "path")
    dated = touched.union(roots).join(commits(spark, sf).select("oid", "ts"), "oid")
    tips = heads(spark, sf).select(F.col("oid").alias("tip"))
    rows = closure(spark, sf).join(tips, "tip").join(dated, "oid")
    return rows.groupBy("tip", "path").agg(F.max(F.struct("ts", "oid"))["oid"].alias("oid"))


_GREP = "regexp_matches(line, 'th[ae]') AND regexp_matches(line, 'tion') AND NOT regexp_matches(line, '[0-9]')"


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE {_GREP}")
def grep_boolean(spark, sf):
    """Lines under a boolean expression of patterns."""
    e = patterns.parse_grep(["-e", "th[ae]", "--and", "(", "-e", "tion", "--and", "--not", "-e", "[0-9]", ")"])
    return lines(spark, sf).filter(patterns.grep_expression(F.col("line"), e)).select("doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, count(*)::BIGINT AS n FROM lines WHERE regexp_matches(line, '(?i)license|copyright') GROUP BY doc_id")
def grep_count(spark, sf):
    return lines(spark, sf).filter(patterns.grep_expression(F.col("line"), ("icase", "license|copyright"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line_no, strpos(line, 'tion')::BIGINT AS place FROM lines WHERE contains(line, 'tion')")
def grep_first_column(spark, sf):
    """Where in a line a string first stands."""
    hit = lines(spark, sf).filter(patterns.grep_expression(F.col("line"), ("fixed", "tion")))
    return hit.select("doc_id", "line_no", F.instr("line", "tion").cast("long").alias("place"))


@query("SELECT DISTINCT doc_id FROM documents WHERE NOT regexp_matches(text, 'tion')")
def grep_files_without(spark, sf):
    return views.load(spark, sf, "documents").filter(~F.col("text").rlike("tion")).select("doc_id")


_URL = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"


@query(f"SELECT page_id, path FROM (SELECT page_id, {_URL} AS path FROM pages) WHERE regexp_matches(path, '^[^/]*/[0-9][^/]*(/|$)') AND NOT regexp_matches(lower(path), '^fr(/|$)')")
def pathspec_glob_exclude(spark, sf):
    """Paths under a glob, but for one directory in any case."""
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    rows = views.load(spark, sf, "pages").select("page_id", path.alias("path"))
    return rows.filter(patterns.pathspec(F.col("path"), [":(glob)*/[0-9]*", ":(exclude,icase)FR"]))


_STEPS = f"""steps AS (SELECT page_id, list_filter(string_split({_URL}, '/'), lambda x: x <> '') AS parts, {_URL} LIKE '%/' AS slash FROM pages),
prefixes AS (SELECT page_id, list_transform(range(1, len(parts) + 1), lambda i: struct_pack(path := array_to_string(parts[1:i], '/'), is_dir := i < len(parts) OR slash)) AS p FROM steps)"""


@query(f"""WITH {_STEPS} SELECT page_id, len(list_filter(p, lambda s: CASE WHEN regexp_matches(s.path, '^(.*/)?en/1[^/]*$') THEN false WHEN regexp_matches(s.path, '(^|/)[^/]*5$') THEN true
  WHEN s.is_dir AND regexp_matches(s.path, '(^|/)en$') THEN true ELSE false END)) > 0 AS ignored FROM prefixes""")
def ignore_rules(spark, sf):
    """Whether ordered rules ignore a path: nothing in an excluded directory is taken back."""
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    rules = ["# languages", "en/", "*5", "!**/en/1*"]
    return views.load(spark, sf, "pages").select("page_id", patterns.ignore_rules(path, rules).alias("ignored"))


@query(f"""WITH {_STEPS} SELECT page_id, len(list_filter(p, lambda s: CASE WHEN regexp_matches(s.path, '^fr/1[^/]*$') THEN false WHEN regexp_matches(s.path, '^fr/[^/]*$') THEN true
  WHEN regexp_matches(s.path, '(^|/)[^/]*[.]html$') THEN true ELSE false END)) > 0 AS ignored FROM prefixes""")
def ignore_rules_reincluded(spark, sf):
    """Files that a rule excludes one by one may be taken back."""
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    return views.load(spark, sf, "pages").select("page_id", patterns.ignore_rules(path, ["*.html", "", "/fr/*", "!/fr/1*"]).alias("ignored"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)[^/]*5[^/]*$') THEN NULL WHEN regexp_matches(path, '^en/[^/]*$') THEN 'en' END AS lang,
  CASE WHEN regexp_matches(path, '^en/[^/]*$') THEN 'unset' WHEN regexp_matches(path, '(^|/)[^/]*[.]html$') THEN 'set' END AS text FROM (SELECT page_id, {_URL} AS path FROM pages)""")
def attributes_lookup(spark, sf):
    """Attributes that ordered rules give each path."""
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    found = patterns.path_attributes(path, ["*.html text", "/en/* lang=en -text", "*5* !lang", "fr/ lang=fr"], ["lang", "text"])
    return views.load(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in found.items()])


@query(f"WITH {LINES} SELECT doc_id, count(*)::BIGINT AS n FROM lines WHERE regexp_matches(line, '(^|[^0-9A-Za-z_])(the|ing)+([^0-9A-Za-z_]|$)') GROUP BY doc_id")
def grep_words_basic(spark, sf):
    """Lines in which a basic expression fits a whole word."""
    regex = patterns.word_regex(patterns.basic_regex(r"\(the\|ing\)\+"))
    return lines(spark, sf).filter(F.col("line").rlike(regex)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, count(*)::BIGINT AS n FROM lines WHERE NOT regexp_matches(line, '[0-9]') GROUP BY doc_id")
def grep_inverted(spark, sf):
    """How many lines of each file don't fit."""
    return lines(spark, sf).filter(~F.col("line").rlike("[0-9]")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[a-z]+tion')) AS match FROM lines")
def grep_only_matching(spark, sf):
    """The matching parts of lines."""
    return lines(spark, sf).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("[a-z]+tion"), F.lit(0))).alias("match"))


@query("SELECT page_id, page_id % 9 = 0 AS is_binary FROM pages")
def grep_binary(spark, sf):
    """Which files count as binary, when every ninth has a NUL early on and every seventh a late one."""
    page = F.col("page_id")
    late = F.concat(F.repeat(F.lit("x"), F.lit(9000)), F.lit("\0"))
    text = F.when(page % 9 == 0, F.concat(F.lit("a\0b"), "html")).when(page % 7 == 0, F.concat(late, "html")).otherwise(F.col("html"))
    return views.load(spark, sf, "pages").select("page_id", patterns.is_binary(text).alias("is_binary"))


@query(DIFF + """, hits AS (SELECT oid, parent, bool_or(coalesce(new_content = 3, false) OR coalesce(old_content = 3, false)) AS hit FROM diffs WHERE status IS NOT NULL GROUP BY oid, parent)
SELECT diffs.oid, diffs.parent, path, status FROM diffs JOIN hits ON hits.oid = diffs.oid AND hits.parent = diffs.parent WHERE status IS NOT NULL AND hit""")
def pickaxe_all(spark, sf):
    """Whole changesets of which one change takes a given blob in or out."""
    hit = F.coalesce(F.col("old_content") == 3, F.lit(False)) | F.coalesce(F.col("new_content") == 3, F.lit(False))
    return diff.whole_changesets(diffs(spark, sf), hit).select("oid", "parent", "path", "status")


@query(DIFF + " SELECT oid, parent, path, status FROM diffs WHERE status IN ('A', 'M') AND path NOT LIKE 'b2/%'")
def diff_filter_pathspec(spark, sf):
    """Changes of given kinds outside one directory."""
    rows = diffs(spark, sf).filter(diff.status_filter(F.col("status"), "AM") & patterns.pathspec(F.col("path"), [":!b2"]))
    return rows.select("oid", "parent", "path", "status")


@query(DIFF + """ SELECT oid, parent, split_part(path, '/', 1) AS path, count(*)::BIGINT AS n FROM diffs WHERE status IS NOT NULL GROUP BY oid, parent, split_part(path, '/', 1)""")
def diff_max_depth(spark, sf):
    """Changes shown as the directories of depth 1 that hold them."""
    return diff.at_depth(diffs(spark, sf), 1, ["oid", "parent"])


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS oid FROM documents")
def hash_objects(spark, sf):
    """Object ids of all blobs."""
    return views.load(spark, sf, "documents").select("doc_id", scalars.object_id("blob", F.col("text")).alias("oid"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size FROM documents WHERE octet_length(encode(text)) < 2048")
def object_filter_combine(spark, sf):
    """Blobs under combined object filters."""
    from ..operators.objects import object_filter

    rows = views.load(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.lit("blob").alias("type"), F.lit(1).alias("depth"))
    return rows.filter(object_filter("combine:blob:limit=2k+object:type=blob")).select("doc_id", "size")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# head' || chr(10) || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || '# tail',
 '(?m)^#[^\\n]*(\\n|$)', '', 'g'), '[ \\t\\r]+\\n', chr(10), 'g'), '[ \\t\\r]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+', '', 'g'), chr(10)) AS message FROM documents""")
def strip_comments(spark, sf):
    text = F.concat(F.lit("# head\n"), F.col("text"), F.lit("  \n\n\n\n# tail"))
    return views.load(spark, sf, "documents").select("doc_id", scalars.strip_comments(text).alias("message"))


def bloom_changed_paths(spark, sf):
    """A filter of changed paths for each commit, and whether it may hold one path."""
    from ..functions.sketches import path_filters

    return path_filters(first_diffs(spark, sf).select("oid", "path"), "b1/t1")


query()(bloom_changed_paths)


@query(f"WITH {LINES} SELECT doc_id, count(*)::BIGINT AS n_lines, count(DISTINCT line)::BIGINT AS n_distinct, max(length(line))::BIGINT AS longest FROM lines GROUP BY doc_id")
def line_statistics(spark, sf):
    return lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.countDistinct("line").alias("n_distinct"), F.max(F.length("line")).cast("long").alias("longest"))
