"""Why answers for all symbols, files, commits, issues and pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import people, why
from ..sources.driver_tables import History
from .analyses import LINEAGE_CTES, PEOPLE_CTES
from .registry import register


def shown(answers: DataFrame) -> DataFrame:
    """Answers with evidence and related entities as text."""
    cited = F.array_join(F.transform("evidence", lambda e: F.concat(e["name"], F.lit(" ("), e["reasons"], F.lit(")"))), ", ")
    return answers.select(F.col("key").cast("string").alias("key"), "answer", (F.floor(F.col("confidence") * 1000000 + 0.5) / 1000000).alias("confidence"), "level", "statements", F.coalesce(cited, F.lit("")).alias("evidence"), F.coalesce(F.array_join("related", ", "), F.lit("")).alias("related"))


BASIS = "CASE WHEN confidence >= 1 THEN 'recorded' WHEN confidence >= 0.9 THEN 'closing reference' ELSE 'mentioned' END"
CONTEXT_CTES = f"""told AS (SELECT id, committed_at, body, 'commit ' || substr(sha, 1, 7) || ' "' || subject || '" by ' || author_name || ' on ' || strftime(committed_at, '%Y-%m-%d') AS words, 'commit:' || sha AS ev FROM commits),
rel AS (SELECT *, confidence::DOUBLE AS c, 'relation:' || id AS ev FROM relations),
context AS (SELECT id AS commit_id, 1 AS s, '' AS o, 'Its commit message explains: "' || body || '"' AS text, 'commit message' AS role, 'FACT' AS level, 1.0::DOUBLE AS c, [ev] AS evs FROM told WHERE body <> ''
  UNION ALL SELECT target_id, 2, ev, 'It is part of pull request #' || source_id || '.', 'pull request carrying the change', level, c, [ev] FROM rel WHERE relation = 'IMPLEMENTED_BY' AND source_type = 'pull_request'
  UNION ALL SELECT target_id, 3, ev, 'The commit itself resolves issue #' || source_id || ' (' || {BASIS} || ').', 'resolved issue', level, c, [ev] FROM rel WHERE relation = 'RESOLVED_BY' AND source_type = 'issue'),
mention AS (SELECT DISTINCT source_id AS commit_id, target_type || ':' || target_id AS related FROM relations WHERE relation = 'REFERENCES' AND source_type = 'commit')"""

CONCLUDE = """SELECT a.key::VARCHAR AS key, answer, floor(confidence * 1000000 + 0.5) / 1000000 AS confidence, CASE rank WHEN 2 THEN 'INFERRED' WHEN 1 THEN 'DERIVED' ELSE 'FACT' END AS level, statements, coalesce(evidence, '') AS evidence, coalesce(related, '') AS related
FROM (SELECT key, string_agg(text, ' ' ORDER BY s, o, text) AS answer, min(c) AS confidence, max(CASE level WHEN 'INFERRED' THEN 2 WHEN 'DERIVED' THEN 1 ELSE 0 END) AS rank, count(*) AS statements FROM st GROUP BY key) a
LEFT JOIN (SELECT key, string_agg(ev || ' (' || roles || ')', ', ' ORDER BY ev) AS evidence FROM (SELECT key, ev, string_agg(role, '; ' ORDER BY role) AS roles FROM (SELECT DISTINCT key, unnest(evs) AS ev, role FROM st) u GROUP BY key, ev) v GROUP BY key) e ON e.key = a.key
LEFT JOIN (SELECT key, string_agg(DISTINCT related, ', ' ORDER BY related) AS related FROM (SELECT born.key, mention.related FROM born JOIN mention USING (commit_id)) m GROUP BY key) m ON m.key = a.key"""
NO_ORIGIN = "'The indexed history does not show where it was introduced: it predates the indexed history or was added in a merge commit.'"
LATER = "SELECT t.key, {step}, '', CASE WHEN n IS NULL THEN 'It has not changed since.' ELSE 'It changed ' || n || CASE WHEN n = 1 THEN ' time' ELSE ' times' END || ' since, most recently in ' || m.words || '.' END, 'later changes', '{level}', 1.0, CASE WHEN n IS NULL THEN [] ELSE [m.ev] END FROM {targets} t LEFT JOIN (SELECT key, count(*) AS n, arg_max(commit_id, (committed_at, commit_id)) AS last FROM {rows} x GROUP BY key) l ON l.key = t.key LEFT JOIN told m ON m.id = l.last"

SYMBOL_CTES = f"""{PEOPLE_CTES}, {CONTEXT_CTES},
placed AS (SELECT s.id AS key, s.kind || ' ' || s.qualified_name AS named, f.path, s.start_line, s.end_line, s.current, s.file_id FROM symbols s JOIN files f ON f.id = s.file_id),
touched AS (SELECT DISTINCT v.symbol_id AS key, v.commit_id, m.committed_at FROM symbol_versions v JOIN commits m ON m.id = v.commit_id),
firsts AS (SELECT key, arg_min(commit_id, (committed_at, commit_id)) AS commit_id FROM touched GROUP BY key),
copied AS (SELECT r.source_id AS key, r.target_id AS origin, r.ev, r.level, r.c FROM rel r JOIN placed p ON p.key = r.target_id WHERE r.relation = 'COPIED_FROM'),
traced AS (SELECT p.key, c.origin, coalesce(c.origin, p.key) AS oldest FROM placed p LEFT JOIN copied c USING (key)),
born AS (SELECT t.key, t.origin, r.target_id AS commit_id, r.ev, r.level, r.c FROM traced t JOIN rel r ON r.relation = 'INTRODUCED_BY' AND r.source_id = t.oldest),
made AS (SELECT key, commit_id FROM firsts WHERE key IN (SELECT key FROM copied) UNION ALL SELECT key, commit_id FROM born WHERE origin IS NULL),
since AS (SELECT t.* FROM touched t LEFT JOIN made m ON m.key = t.key AND m.commit_id = t.commit_id WHERE m.key IS NULL),
by_person AS (SELECT t.key, n.person_key, count(*) AS n, arg_max(t.commit_id, (t.committed_at, t.commit_id)) AS last FROM touched t JOIN authored a ON a.id = t.commit_id JOIN names n USING (name_key) GROUP BY 1, 2),
top_people AS (SELECT b.key, b.n, b.last, p.person, p.active, p.last_commit_at, sum(b.n) OVER w AS total, count(*) OVER w AS people, row_number() OVER (PARTITION BY b.key ORDER BY b.n DESC, p.person, b.person_key) AS place FROM by_person b JOIN persons p USING (person_key) WINDOW w AS (PARTITION BY b.key)),
lines AS (SELECT p.key, len(list_filter(range(1, v.n_found * 3, 3), lambda x: x BETWEEN p.start_line AND p.end_line)) AS found, len(list_filter(range(1, v.n_found * 3, 3), lambda x: x BETWEEN p.start_line AND p.end_line AND x % v.step <> 0)) AS hit FROM placed p JOIN line_coverage v USING (file_id) WHERE p.current AND v.fresh),
st AS (SELECT p.key, 0 AS s, '' AS o, CASE WHEN current THEN named || ' is defined in ' || path || ' at lines ' || start_line || '–' || end_line || '.' ELSE named || ' no longer exists at HEAD; it was last seen in ' || path || '.' END AS text, 'definition' AS role, 'FACT' AS level, 1.0::DOUBLE AS c, [r.ev] AS evs FROM placed p JOIN rel r ON r.relation = 'CONTAINS' AND r.target_id = p.key
  UNION ALL SELECT key, 1, '', hit || ' of its ' || found || ' instrumented lines ran in the tests.', 'line coverage', 'DERIVED', 1.0, [] FROM lines WHERE found > 0
  UNION ALL SELECT c.key, 2, '00', 'It was copied, with identical content, from ' || p.named || ' in ' || p.path || ' in ' || m.words || '.', 'copied from', c.level, c.c, [c.ev, m.ev] FROM copied c JOIN placed p ON p.key = c.origin JOIN firsts f ON f.key = c.key JOIN told m ON m.id = f.commit_id
  UNION ALL SELECT b.key, 3, '', CASE WHEN b.origin IS NULL THEN 'It' ELSE 'That code' END || ' was introduced in ' || m.words || '.', 'introducing commit', b.level, b.c, [b.ev, m.ev] FROM born b JOIN told m ON m.id = b.commit_id
  UNION ALL SELECT key, 3, '', {NO_ORIGIN}, 'absence of origin evidence', 'FACT', 1.0, [] FROM placed WHERE key NOT IN (SELECT key FROM born)
  UNION ALL SELECT b.key, x.s + 3, x.o, x.text, x.role, x.level, b.c * x.c, x.evs FROM born b JOIN context x USING (commit_id)
  UNION ALL {LATER.format(step=7, level="DERIVED", targets="placed", rows="since")}
  UNION ALL SELECT key, 8, '', 'Its ' || total || CASE WHEN total = 1 THEN ' commit was' ELSE ' commits were' END || ' made by ' || people || CASE WHEN people = 1 THEN ' person' ELSE ' people' END || ', most by ' || person || ' (' || n || '). ' || person || CASE WHEN active THEN ' still commits to the repository' ELSE ' has not committed in the year before the latest commit' END || ' (last on ' || strftime(last_commit_at, '%Y-%m-%d') || ').', 'authors', 'DERIVED', 1.0, [m.ev] FROM top_people JOIN told m ON m.id = last WHERE place = 1)"""


@register("q1_why_symbols", CONCLUDE, SYMBOL_CTES)
def why_symbols(h: History) -> DataFrame:
    spread = F.sequence(F.lit(1), F.col("n_found") * 3 - 1, F.lit(3))
    lines = h.line_coverage.where("fresh").select("file_id", "step", spread.alias("lines"))
    rows = h.symbols.where("current").join(lines, "file_id").withColumn("inside", F.expr("filter(lines, x -> x BETWEEN start_line AND end_line)"))
    covered = rows.select(F.col("id").alias("key"), F.size("inside").alias("found"), F.expr("size(filter(inside, x -> x % step <> 0))").alias("hit"))
    names = people.identities(h.commits)
    return shown(why.symbols_why(h.symbols, h.files, h.symbol_versions, h.relations, h.commits, covered, (names, people.people(h.commits, names))))


# The shared lineages start from live files; the answers are for all files.
FILE_CTES = f"""{LINEAGE_CTES.replace("FROM files WHERE NOT deleted UNION ALL", "FROM files UNION ALL")}, {CONTEXT_CTES},
entries AS (SELECT l.root AS key, f.path AS at_path, c.id AS change_id, c.commit_id, c.status, c.previous_file_id, c.additions, c.deletions, c.committed_at, row_number() OVER (PARTITION BY l.root ORDER BY c.committed_at, c.commit_id, c.id) AS n FROM lineage l JOIN files f ON f.id = l.file_id JOIN dated_changes c ON c.file_id = l.file_id AND (l.until IS NULL OR c.committed_at <= l.until)),
born AS (SELECT e.*, f.path FROM entries e JOIN files f ON f.id = e.key WHERE n = 1 AND status = 'added'),
since AS (SELECT key, commit_id, committed_at FROM entries WHERE n > 1 AND NOT (status = 'renamed' AND coalesce(additions, 1) + coalesce(deletions, 1) = 0)),
st AS (SELECT id AS key, 0 AS s, '' AS o, path || CASE WHEN deleted THEN ' was deleted.' ELSE ' exists at HEAD.' END AS text, 'current state' AS role, 'FACT' AS level, 1.0::DOUBLE AS c, []::VARCHAR[] AS evs FROM files
  UNION ALL SELECT b.key, 1, '', 'It was created' || CASE WHEN b.at_path = b.path THEN '' ELSE ' as ' || b.at_path END || ' in ' || m.words || '.', 'creating commit', 'FACT', 1.0, [m.ev] FROM born b JOIN told m ON m.id = b.commit_id
  UNION ALL SELECT id, 1, '', {NO_ORIGIN}, 'absence of origin evidence', 'FACT', 1.0, [] FROM files WHERE id NOT IN (SELECT key FROM born)
  UNION ALL SELECT b.key, x.s + 1, x.o, x.text, x.role, x.level, x.c, x.evs FROM born b JOIN context x USING (commit_id)
  UNION ALL SELECT e.key, 5, strftime(e.committed_at, '%Y%m%d%H%M%S') || lpad(e.change_id::VARCHAR, 20, '0'), 'It was renamed from ' || coalesce(f.path, '?') || ' to ' || e.at_path || ' in ' || m.words || '.', 'rename', 'FACT', 1.0, [m.ev] FROM entries e LEFT JOIN files f ON f.id = e.previous_file_id JOIN told m ON m.id = e.commit_id WHERE e.n > 1 AND e.status = 'renamed'
  UNION ALL {LATER.format(step=6, level="FACT", targets="(SELECT id AS key FROM files)", rows="since")})"""


@register("q1_why_files", CONCLUDE, FILE_CTES, recursive=True)
def why_files(h: History) -> DataFrame:
    return shown(why.files_why(h.files, h.dated_changes, h.relations, h.commits))


@register("q1_why_commits", CONCLUDE, f"""{CONTEXT_CTES}, born AS (SELECT id AS key, id AS commit_id FROM commits),
st AS (SELECT id AS key, 0 AS s, '' AS o, 'This is ' || words || '.' AS text, 'the commit' AS role, 'FACT' AS level, 1.0::DOUBLE AS c, [ev] AS evs FROM told
  UNION ALL SELECT b.key, x.s + 1, x.o, x.text, x.role, x.level, x.c, x.evs FROM born b JOIN context x USING (commit_id))""")
def why_commits(h: History) -> DataFrame:
    return shown(why.commits_why(h.relations, h.commits))


# What mentions a piece of work is a commit.
@register("q1_why_work", CONCLUDE.replace("mention.related FROM born JOIN mention USING (commit_id)", "'commit:' || born.commit_id AS related FROM born"), f"""{CONTEXT_CTES}, ends AS (SELECT source_type AS type, source_id AS id FROM relations UNION SELECT target_type, target_id FROM relations),
born AS (SELECT target_type || ':' || target_id AS key, source_id AS commit_id FROM relations WHERE relation = 'REFERENCES' AND target_type IN ('issue', 'pull_request')),
st AS (SELECT type || ':' || id AS key, 0 AS s, '' AS o, CASE type WHEN 'issue' THEN 'Issue #' ELSE 'Pull request #' END || id || ' is known.' AS text, CASE type WHEN 'issue' THEN 'the issue' ELSE 'the pull request' END AS role, 'FACT' AS level, 1.0::DOUBLE AS c, []::VARCHAR[] AS evs FROM ends WHERE type IN ('issue', 'pull_request')
  UNION ALL SELECT 'issue:' || r.source_id, 1, r.ev, 'It is resolved by ' || m.words || ' (' || {BASIS} || ').', 'resolution', r.level, r.c, [r.ev] FROM rel r JOIN told m ON m.id = r.target_id WHERE r.relation = 'RESOLVED_BY' AND r.source_type = 'issue'
  UNION ALL SELECT 'pull_request:' || r.source_id, 2, '', 'It is implemented by ' || count(*) || CASE WHEN count(*) = 1 THEN ' indexed commit: ' ELSE ' indexed commits: ' END || string_agg(m.words, '; ' ORDER BY r.ev, m.words) || '.', 'implementing commits', max(CASE r.level WHEN 'INFERRED' THEN 'INFERRED' WHEN 'DERIVED' THEN 'DERIVED' ELSE 'A' END), min(r.c), list(r.ev ORDER BY r.ev) FROM rel r JOIN told m ON m.id = r.target_id WHERE r.relation = 'IMPLEMENTED_BY' AND r.source_type = 'pull_request' GROUP BY r.source_id)""")
def why_work(h: History) -> DataFrame:
    return shown(why.work_why(h.relations, h.commits))
