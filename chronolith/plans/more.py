"""Labels, summaries, questions, snapshots and further lookups as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import graph, search, stories
from ..sources.driver_tables import History
from .analyses import OWNERSHIP_CTES, STORY_SQL, _owned, called_symbols, stories_of, story_ctes
from .graphs import PATHS_SQL, _IN, _paths, keys_of, route_ctes
from .registry import register


@register("j9_vertex_labels", """
SELECT k.key, coalesce(v.label, k.key || ' (missing)') AS label FROM (SELECT DISTINCT target_type || ':' || target_id AS key FROM relations) k
LEFT JOIN (SELECT 'commit:' || id AS key, substr(sha, 1, 7) || ' ' || subject AS label FROM commits UNION ALL SELECT 'file:' || id, path FROM files UNION ALL SELECT 'symbol:' || id, kind || ' ' || qualified_name FROM symbols) v USING (key)""")
def vertex_labels(h: History) -> DataFrame:
    keys = h.relations.select(graph.key(F.col("target_type"), F.col("target_id")).alias("key")).distinct()
    return stories.labelled(keys, stories.vertices(h.commits, h.files, h.symbols)).select("key", "label")


@register("g5_traverse_impact", PATHS_SQL, route_ctes(3, _IN + "relation = 'CONTAINS' AND target_type = 'symbol' UNION ALL " + _IN + "relation = 'IMPORTS'", "SELECT 'symbol:' || id AS key FROM symbols"), recursive=True)
def traverse_impact(h: History) -> DataFrame:
    return _paths(graph.traverse(keys_of(h.symbols, "symbol"), h.relations, "impact", max_depth=3))


@register("q7_question_kinds", """
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\b(?:what|who|which)\\b.*\\b(?:depends?|uses?|imports?|breaks?|affected)\\b|\\bimpact of\\b|\\bwhat breaks\\b', 'i') THEN 'impact'
  WHEN regexp_matches(text, '\\b(?:history|timeline|evolution) of\\b|\\bwhat changed in\\b|\\bhow (?:did|has)\\b.*\\bchange|\\bwhen (?:was|were|did)\\b.*\\bchang', 'i') THEN 'timeline'
  WHEN regexp_matches(text, '\\bwhy\\b|\\bwhat is .* for\\b|\\breason for\\b|\\bpurpose of\\b', 'i') THEN 'why' END AS kind
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Why is this here? ' WHEN 1 THEN 'what depends on it: ' WHEN 2 THEN 'history of ' ELSE '' END || text AS text FROM conversations) c""")
def question_kinds(h: History) -> DataFrame:
    lead = F.when(F.col("turn") % 4 == 0, "Why is this here? ").when(F.col("turn") % 4 == 1, "what depends on it: ").when(F.col("turn") % 4 == 2, "history of ").otherwise("")
    return h.conversations.select("conv_id", "turn", stories.question_kind(F.concat(lead, "text")).alias("kind"))


@register("q13_grounding", """
SELECT id AS question_id, lower(path) AS word, 'file:' || id AS key FROM files UNION ALL SELECT f.id, m.sha, 'commit:' || m.id FROM files f JOIN commits m ON m.id = f.id""")
def grounding(h: History) -> DataFrame:
    """A question about every file, its place in a commit and a common name: path and hash tell what is meant, the name doesn't."""
    asked = h.files.join(h.commits.select("id", "sha"), "id", "left")
    text_ = F.concat(F.lit("Why does "), "path", F.lit(" call fn_"), (F.col("id") % 40).cast("string"), F.lit(" after "), F.coalesce("sha", F.lit("all")), F.lit("?"))
    entity = lambda df, kind, word: df.select(graph.key(F.lit(kind), F.col("id")).alias("key"), F.lower(word).alias("word"))
    entities = entity(h.files, "file", F.col("path")).unionByName(entity(h.commits, "commit", F.col("sha"))).unionByName(entity(h.symbols, "symbol", F.col("name")))
    return stories.grounding(asked.select(F.col("id").alias("question_id"), text_.alias("text")), entities)


@register("a20_file_lens", STORY_SQL.format(name="file_id"), story_ctes(key="s.file_id", join="JOIN symbols s ON s.id = v.symbol_id", called="s.file_id", call_join="JOIN symbols s ON s.id = r.target_id"))
def file_lens(h: History) -> DataFrame:
    """Stories of all symbols of a file together."""
    of_file = h.symbols.select(F.col("id").alias("symbol_id"), "file_id")
    by_file = lambda rows: rows.join(of_file, "symbol_id").drop("symbol_id").withColumnRenamed("file_id", "symbol_id")
    return stories_of(h, by_file(h.symbol_versions.select("symbol_id", "commit_id")), by_file(called_symbols(h))).withColumnRenamed("symbol_id", "file_id")


@register("x22_lens_titles", """
SELECT symbol_id, concat_ws(' · ', changes || CASE WHEN changes = 1 THEN ' change' ELSE ' changes' END, authors || CASE WHEN authors = 1 THEN ' author' ELSE ' authors' END, CASE WHEN fixes > 0 THEN fixes || CASE WHEN fixes = 1 THEN ' fix' ELSE ' fixes' END END, CASE WHEN callers > 0 THEN callers || CASE WHEN callers = 1 THEN ' caller' ELSE ' callers' END END) AS title
FROM (""" + STORY_SQL.format(name="symbol_id") + ") x", story_ctes())
def lens_titles(h: History) -> DataFrame:
    found = stories_of(h, h.symbol_versions, called_symbols(h))
    return found.select("symbol_id", stories.lens_title(F.col("changes"), F.col("authors"), F.col("fixes"), F.col("callers")).alias("title"))


@register("a24_owners_sentence", "SELECT file_id, CASE WHEN count(*) = 1 THEN '1 person, ' ELSE count(*) || ' people, most by ' END || min_by(person, place) AS sentence FROM owned GROUP BY file_id", OWNERSHIP_CTES, recursive=True)
def owners_sentence(h: History) -> DataFrame:
    return stories.owners_sentence(_owned(h))


@register("a26_provider_counts", "SELECT provider, type, count(*) AS n, count(*) FILTER (relation = 'RESOLVED_BY') AS resolving FROM discussions GROUP BY 1, 2")
def provider_counts(h: History) -> DataFrame:
    return h.discussions.groupBy("provider", "type").agg(F.count("*").alias("n"), F.count_if(F.col("relation") == "RESOLVED_BY").alias("resolving"))


@register("a23_call_edges", "SELECT caller_id, target, max(confidence)::DOUBLE AS confidence, arg_min(line, -confidence * 1000000 + line) AS line FROM (SELECT source_id AS caller_id, target_id AS target, confidence, id % 1000 AS line FROM relations WHERE relation = 'CALLS') c GROUP BY 1, 2")
def call_edges(h: History) -> DataFrame:
    """Calls between two symbols as one edge: the surest, and of those the first."""
    rows = h.relations.where("relation = 'CALLS'").select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("target"), F.col("confidence").cast("double").alias("confidence"), (F.col("id") % 1000).alias("line"))
    return rows.groupBy("caller_id", "target").agg(F.max("confidence").alias("confidence"), F.min_by("line", F.struct(-F.col("confidence"), F.col("line"))).alias("line"))


@register("t8_changed_snapshot", "SELECT a.id AS path FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 'new' ELSE path END AS digest FROM files) a WHERE (a.id, a.digest) NOT IN (SELECT (id, path) FROM files WHERE id % 50 <> 1)")
def changed_snapshot(h: History) -> DataFrame:
    before = h.files.where("id % 50 <> 1").select(F.col("id").alias("path"), F.col("path").alias("digest"))
    after = h.files.select(F.col("id").alias("path"), F.when(F.col("id") % 9 == 0, "new").otherwise(F.col("path")).alias("digest"))
    return stories.changed_snapshot(before, after).select("path")


@register("t9_parse_once", "SELECT sha256(text) AS digest, min(doc_id) AS path FROM documents GROUP BY 1")
def parse_once(h: History) -> DataFrame:
    return stories.parse_once(h.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@register("x7_merge_request_references", "SELECT id, CASE WHEN id % 7 = 1 THEN 1 ELSE 0 END::BIGINT AS requests, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS issues FROM commits")
def merge_request_references(h: History) -> DataFrame:
    """Messages as a host writes them that marks merge requests with !; a number of another project isn't one of this."""
    issues, requests = stories.gitlab_references(F.replace("body", F.lit("GH-"), F.lit("!")))
    return h.commits.select("id", F.size(requests).cast("bigint").alias("requests"), F.size(issues).cast("bigint").alias("issues"))


@register("x11_signatures", "SELECT doc_id, CASE WHEN length(s) > 200 THEN s[1:200] || '…' ELSE s END AS signature FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents) d")
def signatures(h: History) -> DataFrame:
    return h.documents.select("doc_id", text.signature(F.col("text")).alias("signature"))


@register("x15_ancestors", "SELECT id, len(string_split(path, '/')) AS depth FROM files")
def ancestors(h: History) -> DataFrame:
    return h.files.select("id", F.size(paths.ancestors(F.col("path"))).cast("bigint").alias("depth"))


@register("x16_python_names", "SELECT p_partkey AS id, regexp_replace(lower(p_name || '-' || p_type || '.X'), '[-_.]+', '_', 'g') AS name FROM part")
def python_names(h: History) -> DataFrame:
    return h.part.select(F.col("p_partkey").alias("id"), stories.python_name(F.concat("p_name", F.lit("-"), "p_type", F.lit(".X"))).alias("name"))


@register("w1_hotspot_places", "SELECT commit_id, n, row_number() OVER (ORDER BY n DESC, commit_id) AS place FROM (SELECT commit_id, count(*) AS n FROM changes GROUP BY commit_id) c ORDER BY place LIMIT 100")
def places(h: History) -> DataFrame:
    """The first hundred by breadth; the limit comes before the numbering, so few rows are numbered."""
    top = h.changes.groupBy("commit_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "commit_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "commit_id")))


@register("w4_reworked_since", "SELECT f.file_id, count(*) FILTER (c.commit_id > f.latest) AS later FROM (SELECT file_id, max(commit_id) AS latest FROM changes WHERE commit_id IN (SELECT id FROM commits WHERE subject LIKE 'Add %') GROUP BY file_id) f JOIN changes c USING (file_id) GROUP BY f.file_id HAVING count(*) FILTER (c.commit_id > f.latest) < 3")
def reworked(h: History) -> DataFrame:
    flagged = h.changes.join(h.commits.where("subject LIKE 'Add %'").select(F.col("id").alias("commit_id")), "commit_id", "left_semi").groupBy("file_id").agg(F.max("commit_id").alias("latest"))
    return h.changes.select("file_id", "commit_id").join(flagged, "file_id").groupBy("file_id").agg(F.count_if(F.col("commit_id") > F.col("latest")).alias("later")).where("later < 3")


@register("w7_active_window", "SELECT c_custkey AS customer, max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AS active FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def active_window(h: History) -> DataFrame:
    last = h.orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.max("o_orderdate").alias("last"))
    as_of = h.orders.agg(F.max("o_orderdate").alias("as_of"))
    return last.crossJoin(F.broadcast(as_of)).select("customer", (F.col("last") >= F.col("as_of") - F.make_dt_interval(F.lit(365))).alias("active"))


@register("e5_copy_eligible", "SELECT id FROM symbols WHERE kind IN ('class', 'method', 'function') AND end_line - start_line + 1 >= 3")
def copy_eligible(h: History) -> DataFrame:
    return h.symbols.where(F.col("kind").isin("class", "method", "function") & (F.col("end_line") - F.col("start_line") + 1 >= 3)).select("id")


@register("m7_symbol_change_commits", "SELECT symbol_id, array_to_string(list(commit_id ORDER BY commit_id), ',') AS commits FROM symbol_versions GROUP BY symbol_id")
def symbol_change_commits(h: History) -> DataFrame:
    rows = h.symbol_versions.groupBy("symbol_id").agg(F.array_sort(F.collect_list("commit_id")).alias("c"))
    return rows.select("symbol_id", F.array_join(F.col("c").cast("array<string>"), ",").alias("commits"))


@register("q10_importers", "SELECT f.id, count(DISTINCT i.target) AS imports, count(DISTINCT k.source) AS importers FROM files f LEFT JOIN imports i ON i.source = f.id LEFT JOIN imports k ON k.target = f.id GROUP BY f.id")
def importers(h: History) -> DataFrame:
    out = h.imports.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("imports"))
    back = h.imports.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("importers"))
    return h.files.select("id").join(out, "id", "left").join(back, "id", "left").fillna(0, ["imports", "importers"])


@register("m5_upsert", "SELECT number, max(commit_id) AS commit_id FROM discussions WHERE type = 'issue' GROUP BY number")
def upserted(h: History) -> DataFrame:
    """Stored issues and a fresh sync of the same numbers: the later stamp stays."""
    from ..sources.landed import upsert

    issues = h.discussions.where("type = 'issue'").select("number", "commit_id", F.col("commit_id").alias("updated_at"))
    half = search.one_per(issues.where("commit_id % 2 = 0"), ["number"], [F.desc("commit_id")])
    other = search.one_per(issues.where("commit_id % 2 = 1"), ["number"], [F.desc("commit_id")])
    return upsert(half, other, ["number"]).select("number", "commit_id")
