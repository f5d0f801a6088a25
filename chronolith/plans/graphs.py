"""Traversals, impact, copy chains, export, reachability, linking and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels, text
from ..operators import commit_graph, graph, linking
from ..sources.driver_tables import History
from ..streaming import ingest
from .registry import register


def route_ctes(depth: int, links: str, starts: str) -> str:
    """Maximal cycle-free paths over a link query (from_key, to_key, id, confidence, rank), without caps."""
    return f"""links AS ({links}),
paths AS (SELECT key AS start, [key] AS nodes, key AS at, 1.0::DOUBLE AS confidence, 0 AS rank, 0 AS depth FROM ({starts}) s
  UNION ALL SELECT p.start, list_append(p.nodes, l.to_key), l.to_key, p.confidence * l.confidence, greatest(p.rank, l.rank), p.depth + 1 FROM paths p JOIN links l ON l.from_key = p.at AND NOT list_contains(p.nodes, l.to_key) WHERE p.depth < {depth}),
maximal AS (SELECT * FROM paths p WHERE depth > 0 AND (depth = {depth} OR NOT EXISTS (SELECT 1 FROM links l WHERE l.from_key = p.at AND NOT list_contains(p.nodes, l.to_key))))"""


_RANK = "CASE level WHEN 'INFERRED' THEN 2 WHEN 'DERIVED' THEN 1 ELSE 0 END AS rank"
_OUT = "SELECT source_type || ':' || source_id AS from_key, target_type || ':' || target_id AS to_key, id, confidence::DOUBLE AS confidence, " + _RANK + " FROM relations WHERE "
_IN = "SELECT target_type || ':' || target_id AS from_key, source_type || ':' || source_id AS to_key, id, confidence::DOUBLE AS confidence, " + _RANK + " FROM relations WHERE "
ORIGIN_LINKS = _OUT + "relation = 'INTRODUCED_BY' UNION ALL " + _IN + "relation IN ('IMPLEMENTED_BY', 'RESOLVED_BY') UNION ALL " + _OUT + "relation = 'REFERENCES'"
PATHS_SQL = "SELECT start, array_to_string(nodes, '>') AS path, depth::INT AS depth, floor(confidence * 1000000 + 0.5) / 1000000 AS confidence, CASE rank WHEN 2 THEN 'INFERRED' WHEN 1 THEN 'DERIVED' ELSE 'FACT' END AS level FROM maximal"


def _paths(table: DataFrame) -> DataFrame:
    return table.select("start", F.array_join("nodes", ">").alias("path"), "depth", (F.floor(F.col("confidence") * 1000000 + 0.5) / 1000000).alias("confidence"), "level", *(c for c in table.columns if c == "cut"))


def keys_of(table: DataFrame, kind: str) -> DataFrame:
    return table.select(graph.key(F.lit(kind), F.col("id")).alias("key"))


@register("g1_traverse_origin", PATHS_SQL, route_ctes(4, ORIGIN_LINKS, "SELECT 'symbol:' || id AS key FROM symbols"), recursive=True)
def traverse_origin(h: History) -> DataFrame:
    return _paths(graph.traverse(keys_of(h.symbols, "symbol"), h.relations, "origin"))


HISTORY_LINKS = _IN + "relation = 'MODIFIES' UNION ALL " + _IN + "relation IN ('IMPLEMENTED_BY', 'RESOLVED_BY') UNION ALL " + _OUT + "relation = 'REFERENCES'"


@register("g3_traverse_history", PATHS_SQL, route_ctes(4, HISTORY_LINKS, "SELECT 'file:' || id AS key FROM files"), recursive=True)
def traverse_history(h: History) -> DataFrame:
    return _paths(graph.traverse(keys_of(h.files, "file"), h.relations, "history"))


@register("g4_traverse_callers", PATHS_SQL, route_ctes(4, _IN + "relation = 'CALLS'", "SELECT 'symbol:' || id AS key FROM symbols"), recursive=True)
def traverse_callers(h: History) -> DataFrame:
    return _paths(graph.traverse(keys_of(h.symbols, "symbol"), h.relations, "callers"))


def beam_ctes(depth: int, paths: int, fan_out: int, starts: str) -> str:
    """Bounded paths, a level after the other, and what was cut."""
    told = f"'more than {paths} paths; kept the strongest'"
    parts = [
        f"links AS MATERIALIZED (SELECT l.*, r.relation, CASE WHEN r.source_type || ':' || r.source_id = l.from_key THEN 'out' ELSE 'in' END AS direction FROM ({HISTORY_LINKS}) l JOIN relations r ON r.id = l.id)",
        f"p0 AS (SELECT key AS start, [key] AS nodes, 1.0::DOUBLE AS confidence, 0 AS rank FROM ({starts}) s)",
    ]
    for d in range(depth):
        ended = " UNION ALL ".join(f"SELECT start FROM f{k}" for k in range(d + 1))
        parts += [
            f"e{d} AS MATERIALIZED (SELECT p.*, l.to_key, l.relation, l.direction, l.confidence AS c, l.rank AS r, row_number() OVER (PARTITION BY p.start, p.nodes, l.relation, l.direction ORDER BY l.confidence DESC, l.id DESC) AS n, count(*) OVER (PARTITION BY p.start, p.nodes, l.relation, l.direction) AS total FROM p{d} p JOIN links l ON l.from_key = p.nodes[-1] AND NOT list_contains(p.nodes, l.to_key))",
            f"f{d} AS MATERIALIZED (SELECT * FROM p{d} p WHERE len(nodes) > 1 AND NOT EXISTS (SELECT 1 FROM e{d} e WHERE e.start = p.start AND e.nodes = p.nodes))",
            f"x{d} AS MATERIALIZED (SELECT start, list_append(nodes, to_key) AS nodes, confidence * c AS confidence, greatest(rank, r) AS rank FROM e{d} WHERE n <= {fan_out})",
            f"w{d} AS (SELECT start, {told} AS cut FROM (SELECT start FROM x{d} UNION ALL {ended}) o GROUP BY start HAVING count(*) > {4 * paths})",
            f"p{d + 1} AS MATERIALIZED (SELECT start, nodes, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY confidence DESC, nodes) AS n FROM x{d}) y WHERE n <= {4 * paths})",
        ]
    parts += [
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY confidence DESC, len(nodes) DESC, nodes) AS n FROM ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(depth))} UNION ALL SELECT * FROM p{depth}) z)",
        f"cuts AS (SELECT DISTINCT p.start, 'stopped at depth {depth}' AS cut FROM p{depth} p JOIN links l ON l.from_key = p.nodes[-1] AND NOT list_contains(p.nodes, l.to_key) UNION SELECT start, {told} FROM ranked WHERE n > {paths}"
        + "".join(f" UNION SELECT * FROM w{k} UNION SELECT start, relation || ' (' || direction || ') from ' || nodes[-1] || ': followed {fan_out} of ' || total FROM e{k} WHERE total > {fan_out}" for k in range(depth)) + ")",
        "told AS (SELECT start, string_agg(cut, '; ' ORDER BY cut) AS cut FROM cuts GROUP BY start)",
    ]
    return ",\n".join(parts)


@register("g1_traverse_capped", "SELECT start, array_to_string(nodes, '>') AS path, (len(nodes) - 1)::INT AS depth, floor(confidence * 1000000 + 0.5) / 1000000 AS confidence, CASE rank WHEN 2 THEN 'INFERRED' WHEN 1 THEN 'DERIVED' ELSE 'FACT' END AS level, coalesce(cut, '') AS cut FROM ranked LEFT JOIN told USING (start) WHERE n <= 50", beam_ctes(4, 50, 25, "SELECT 'file:' || id AS key FROM files"))
def traverse_capped(h: History) -> DataFrame:
    """With the bounds that users get, from every file; what was cut is told with each path of its start."""
    paths, cuts = graph.beam(keys_of(h.files, "file"), h.relations, "history")
    told = cuts.groupBy("start").agg(F.array_join(F.array_sort(F.collect_list("cut")), "; ").alias("cut"))
    return _paths(paths.join(told, "start", "left")).withColumn("cut", F.coalesce("cut", F.lit("")))


IMPACT_CTES = """hop AS (SELECT target AS root, source AS node, 1 AS distance, 0.95::DOUBLE AS confidence FROM (SELECT DISTINCT source, target FROM imports) i WHERE source <> target
  UNION SELECT h.root, i.source, h.distance + 1, h.confidence * 0.95 FROM hop h JOIN (SELECT DISTINCT source, target FROM imports WHERE source <> target) i ON i.target = h.node WHERE h.distance < 4 AND i.source <> h.root)"""


@register("q2_impact", "SELECT root, node, min(distance)::INT AS distance, floor(max_by(confidence, -distance) * 1000000 + 0.5) / 1000000 AS confidence FROM hop GROUP BY root, node", IMPACT_CTES, recursive=True)
def impact(h: History) -> DataFrame:
    """What depends on each file, by the shortest route; shorter is never less sure here."""
    edges = h.imports.select("source", "target").distinct().withColumn("confidence", F.lit(0.95))
    return graph.dependents(edges, 4).select("root", "node", "distance", (F.floor(F.col("confidence") * 1000000 + 0.5) / 1000000).alias("confidence"))


@register("g8_copy_chain", "SELECT id, arg_max(origin, hops) AS origin, max(hops)::INT AS hops, min(confidence) AS confidence, bool_or(inferred) AS inferred FROM chain GROUP BY id", """chain AS (
SELECT source_id AS id, target_id AS origin, confidence::DOUBLE AS confidence, level = 'INFERRED' AS inferred, 1 AS hops FROM relations WHERE relation = 'COPIED_FROM'
UNION ALL SELECT c.id, r.target_id, least(c.confidence, r.confidence::DOUBLE), c.inferred OR r.level = 'INFERRED', c.hops + 1 FROM chain c JOIN relations r ON r.relation = 'COPIED_FROM' AND r.source_id = c.origin WHERE c.hops < 10)""", recursive=True)
def copy_chain(h: History) -> DataFrame:
    copies = h.relations.where("relation = 'COPIED_FROM'").select(F.col("source_id").alias("id"), F.col("target_id").alias("origin"), "confidence", "level")
    return graph.copy_chain(copies)


#: Nodes that a neighbourhood shows.
SHOWN = 120


@register("g6_neighbourhood", "SELECT n.start, n.nodes, coalesce(l.links, 0) AS links, l.checksum, CASE WHEN n.start IN (SELECT start FROM over) THEN 'stopped at " + str(SHOWN) + " nodes' ELSE '' END AS cut FROM (SELECT start, count(*) AS nodes FROM seen GROUP BY start) n LEFT JOIN (SELECT start, count(*) AS links, sum(id % 1000003)::BIGINT AS checksum FROM inside GROUP BY start) l USING (start)", f"""steps AS MATERIALIZED (
SELECT source_type AS t, source_id AS i, target_type AS t2, target_id AS i2, id FROM relations UNION ALL SELECT target_type, target_id, source_type, source_id, id FROM relations),
h0 AS (SELECT id AS start, 'file' AS t, id AS i FROM files),
f1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY start ORDER BY t || ':' || i) AS n FROM (SELECT DISTINCT h.start, s.t2 AS t, s.i2 AS i FROM h0 h JOIN steps s ON s.t = h.t AND s.i = h.i WHERE NOT (s.t2 = 'file' AND s.i2 = h.start)) d),
h1 AS (SELECT start, t, i FROM f1 WHERE n + 1 <= {SHOWN}),
near AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
had AS (SELECT start, count(*) AS k FROM near GROUP BY start),
f2 AS MATERIALIZED (SELECT d.*, row_number() OVER (PARTITION BY d.start ORDER BY d.t || ':' || d.i) AS n FROM (SELECT DISTINCT h.start, s.t2 AS t, s.i2 AS i FROM h1 h JOIN steps s ON s.t = h.t AND s.i = h.i) d LEFT JOIN near k ON k.start = d.start AND k.t = d.t AND k.i = d.i WHERE k.start IS NULL),
h2 AS (SELECT f.start, t, i FROM f2 f JOIN had USING (start) WHERE n + k <= {SHOWN}),
seen AS MATERIALIZED (SELECT * FROM near UNION ALL SELECT * FROM h2),
over AS (SELECT start FROM f1 WHERE n + 1 > {SHOWN} UNION SELECT f.start FROM f2 f JOIN had USING (start) WHERE n + k > {SHOWN}),
inside AS (SELECT DISTINCT a.start, s.id FROM near a JOIN steps s ON s.t = a.t AND s.i = a.i JOIN seen b ON b.start = a.start AND b.t = s.t2 AND b.i = s.i2)""")
def neighbourhood(h: History) -> DataFrame:
    """Size of the shown neighbourhood of every file, and whether it goes on."""
    checksum = F.when(F.size("links") > 0, F.aggregate("links", F.lit(0).cast("bigint"), lambda total, id_: total + id_ % 1000003))
    cut = F.when(F.col("over"), F.lit(f"stopped at {SHOWN} nodes")).otherwise(F.lit(""))
    kept = [F.size("nodes").cast("bigint").alias("nodes"), F.size("links").cast("bigint").alias("links"), checksum.alias("checksum"), cut.alias("cut")]
    found = graph.neighbourhoods(keys_of(h.files, "file"), h.relations, 2, SHOWN, *kept)
    return found.withColumn("start", F.substring_index("start", ":", -1).cast("bigint"))


@register("g10_unreachable_commits", "SELECT id FROM commits WHERE id NOT IN (SELECT id FROM back)", """tip AS (SELECT max(id) AS id FROM commits),
back AS (SELECT id FROM tip UNION SELECT p.parent_id FROM back b JOIN (SELECT id AS commit_id, id - 32 AS parent_id FROM commits UNION ALL SELECT id, id - 1 FROM commits WHERE id % 4 = 0) p ON p.commit_id = b.id)""", recursive=True)
def unreachable(h: History) -> DataFrame:
    parents = h.commits.select(F.col("id").alias("commit_id"), (F.col("id") - 32).alias("parent_id"), F.lit(0).alias("ordinal")).unionByName(h.commits.where("id % 4 = 0").select(F.col("id").alias("commit_id"), (F.col("id") - 1).alias("parent_id"), F.lit(1).alias("ordinal")))
    places, cross = commit_graph.commit_graph(h.commits.select(F.col("id").alias("commit_id"), F.col("id").alias("number")), parents)
    return commit_graph.unreachable(h.commits.agg(F.max("id").alias("commit_id")), places, cross).select(F.col("commit_id").alias("id"))


@register("j8_neighbours", "SELECT 'out' AS direction, relation, count(*) AS n FROM relations WHERE source_type = 'file' GROUP BY relation UNION ALL SELECT 'in', relation, count(*) FROM relations WHERE target_type = 'file' GROUP BY relation")
def neighbours(h: History) -> DataFrame:
    ends = graph.oriented(h.relations).where("from_type = 'file'")
    return ends.groupBy("direction", "relation").agg(F.count("*").alias("n"))


@register("x24_weakest_level", "SELECT source_type, relation, CASE max(CASE level WHEN 'INFERRED' THEN 2 WHEN 'DERIVED' THEN 1 ELSE 0 END) WHEN 2 THEN 'INFERRED' WHEN 1 THEN 'DERIVED' ELSE 'FACT' END AS level, min(confidence)::DOUBLE AS confidence FROM relations GROUP BY 1, 2")
def weakest_level(h: History) -> DataFrame:
    return h.relations.groupBy("source_type", "relation").agg(levels.weakest(F.col("level")).alias("level"), F.min("confidence").cast("double").alias("confidence"))


@register("q5_conclude", "SELECT commit_id, string_agg(text, ' ' ORDER BY number, text) AS answer, min(confidence)::DOUBLE AS confidence, CASE max(CASE level WHEN 'INFERRED' THEN 2 WHEN 'DERIVED' THEN 1 ELSE 0 END) WHEN 2 THEN 'INFERRED' WHEN 1 THEN 'DERIVED' ELSE 'FACT' END AS level FROM (SELECT commit_id % 1000 AS commit_id, number, confidence, level, relation || ' ' || type || ' ' || number AS text FROM discussions) s GROUP BY commit_id")
def conclude(h: History) -> DataFrame:
    """One answer from all statements about a commit: texts in order, least confidence, weakest level."""
    statements = h.discussions.select((F.col("commit_id") % 1000).alias("commit_id"), "number", F.concat_ws(" ", "relation", "type", "number").alias("text"), "confidence", "level")
    return linking.conclude(statements, ["commit_id"], ["number", "text"])


@register("q4_commit_context", "SELECT m.id, CASE WHEN length(m.body) = 0 THEN '' ELSE m.body END AS paragraph, count(d.number) FILTER (d.relation = 'RESOLVED_BY') AS resolves, count(d.number) FILTER (d.relation = 'REFERENCES') AS mentions FROM commits m LEFT JOIN discussions d ON d.commit_id = m.id GROUP BY m.id, m.body")
def commit_context(h: History) -> DataFrame:
    d = h.discussions.groupBy(F.col("commit_id").alias("id")).agg(F.count_if(F.col("relation") == "RESOLVED_BY").alias("resolves"), F.count_if(F.col("relation") == "REFERENCES").alias("mentions"))
    return h.commits.select("id", text.first_paragraph(F.col("body")).alias("paragraph")).join(d, "id", "left").fillna(0, ["resolves", "mentions"])


@register("q3_timeline", "SELECT c.file_id, strftime(c.committed_at, '%Y-%m-%d') AS day, count(DISTINCT c.commit_id) AS commits, count(DISTINCT d.type || d.number) AS discussions FROM dated_changes c LEFT JOIN discussions d ON d.commit_id = c.commit_id GROUP BY 1, 2")
def timeline(h: History) -> DataFrame:
    rows = h.dated_changes.join(h.discussions.select("commit_id", F.concat("type", "number").alias("talk")), "commit_id", "left")
    return rows.groupBy("file_id", text.day(F.col("committed_at")).alias("day")).agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("talk").alias("discussions"))


@register("j19_call_resolution", """
SELECT file_id, line, callee, target, rule FROM (SELECT *, min(rule) OVER (PARTITION BY file_id, line, callee) AS best, count(*) OVER (PARTITION BY file_id, line, callee, rule) AS n FROM (
  SELECT c.file_id, c.line, c.callee, s.id AS target, 1 AS rule FROM calls c JOIN symbols s ON s.current AND s.file_id = c.file_id AND s.name = c.callee
  UNION ALL SELECT c.file_id, c.line, c.callee, s.id, 2 FROM calls c JOIN (SELECT DISTINCT source, target FROM imports) i ON i.source = c.file_id JOIN symbols s ON s.current AND s.file_id = i.target AND s.name = c.callee) x) y WHERE rule = best AND n = 1""")
def call_resolution(h: History) -> DataFrame:
    """A call names a definition of its own file, else of an imported one; two candidates are no answer."""
    return linking.resolve_calls(h.calls, h.symbols.where("current"), h.imports.select("source", "target").distinct())


@register("e2_touch_state", "SELECT file_id, min(commit_id) AS first_commit, max(commit_id) AS last_commit, arg_max(status, commit_id) = 'deleted' AS deleted FROM changes GROUP BY file_id")
def touch_state(h: History) -> DataFrame:
    return ingest.touch_state(h.changes)


@register("u5_affected_closure", "SELECT id FROM grown", """grown AS (SELECT file_id AS id FROM (SELECT DISTINCT file_id FROM changes WHERE commit_id % 500 = 0) s
UNION SELECT CASE WHEN c.file_id = g.id THEN c.previous_file_id ELSE c.file_id END FROM grown g JOIN (SELECT DISTINCT file_id, previous_file_id FROM changes WHERE status = 'renamed') c ON c.file_id = g.id OR c.previous_file_id = g.id)""", recursive=True)
def affected(h: History) -> DataFrame:
    """Files that pruned commits touched, and all that renames tie to them, either way."""
    seeds = h.changes.where("commit_id % 500 = 0").select(F.col("file_id").alias("id"))
    ties = h.changes.where("status = 'renamed'").select(F.col("file_id").alias("a"), F.col("previous_file_id").alias("b"))
    return linking.closure(seeds, ties)


@register("t1_stream_ingest", "SELECT event_type, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_ingest(h: History) -> DataFrame:
    """All files of the table taken as a stream, what is there now, each event once."""
    return ingest.event_totals(h.spark, f"{h.sf_dir}/events.parquet")


@register("t2_order_independent", "SELECT user_id, arg_min(event_id, (epoch_us(ts)::HUGEINT) * 1000000000 + event_id) AS first_event, arg_max(event_id, (epoch_us(ts)::HUGEINT) * 1000000000 + event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id")
def order_independent(h: History) -> DataFrame:
    """First and last by event time, whatever the order of arrival."""
    return h.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("n"))


@register("t7_negative_cache", "SELECT DISTINCT number FROM discussions WHERE provider = 'jira' AND number NOT IN (SELECT number FROM discussions WHERE commit_id % 3 = 0)")
def negative_cache(h: History) -> DataFrame:
    """Tracker keys to look up: named, and not looked up within the time to live."""
    asked = h.discussions.where("commit_id % 3 = 0").select("number")
    return h.discussions.where("provider = 'jira'").select("number").distinct().join(asked, "number", "left_anti")


@register("q14_answer_gate", "SELECT commit_id AS claim_id, floor(least(0.6, confidence) * 100 + 0.5) / 100 AS confidence FROM discussions WHERE commit_id % 5 <> 0 AND commit_id IN (SELECT id FROM commits WHERE subject LIKE '%e%')")
def answer_gate(h: History) -> DataFrame:
    """Claims that cite nothing, or anything unknown, are dropped; the rest are clamped."""
    cited = F.when(F.col("commit_id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array("commit_id"))
    claims = h.discussions.select(F.col("commit_id").alias("claim_id"), F.col("confidence").cast("double").alias("confidence"), cited.alias("cited"))
    return linking.gate(claims, h.commits.where(F.col("subject").contains("e")).select("id"), 0.6)
