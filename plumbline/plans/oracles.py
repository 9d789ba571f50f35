"""SQL for the queries of catalogue.py, for DuckDB over the same tables."""

from __future__ import annotations

from .catalogue import MARKERS, WIDTH

FILES = "files AS (SELECT concat_ws('/', source, lang, lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt') AS path, lang AS language, text AS content, doc_id FROM documents)"
PAGES = "pagefiles AS (SELECT 'pages/' || CAST(page_id AS VARCHAR) || '.html' AS path, 'HTML' AS language, html AS content, page_id AS doc_id FROM pages)"
BOTH = f"{FILES}, {PAGES}, allfiles AS (SELECT * FROM files UNION ALL SELECT * FROM pagefiles)"
LINES = r"CASE WHEN length(content) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(regexp_replace(content, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) END"
TOKENS = r"CAST(len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')) AS BIGINT)"
BLANK = r"CAST(len(list_filter(ls, lambda x: NOT regexp_matches(x, '\S'))) AS BIGINT)"


def slim(source: str = "files") -> str:
    return f"lined AS (SELECT *, {LINES} AS ls FROM {source}), slim AS (SELECT path, language, doc_id, content, CAST(strlen(content) AS BIGINT) AS bytes, {TOKENS} AS tokens, CAST(len(ls) AS BIGINT) AS loc, CAST(len(ls) AS BIGINT) - {BLANK} AS sloc, {BLANK} AS blank_lines FROM lined)"


CYCLOMATIC = r"CAST(1 + len(regexp_extract_all(content, '\b(?:if|for|while|case|catch|elif|when|and|or)\b')) + len(regexp_extract_all(content, '&&')) + len(regexp_extract_all(content, '\|\|')) + len(regexp_extract_all(content, '\?')) AS BIGINT)"
OPERANDS = "regexp_extract_all(content, '[A-Za-z0-9_]+')"
OPERATORS = r"regexp_extract_all(regexp_replace(content, '[A-Za-z0-9_]+', ' ', 'g'), '&&|\|\||[=!<>+\-*/%:]=|[-=]>|::|[^\sA-Za-z0-9_]')"
COUNTS = f"CAST(len(list_distinct({OPERATORS})) AS BIGINT) AS distinct_operators, CAST(len(list_distinct({OPERANDS})) AS BIGINT) AS distinct_operands, CAST(len({OPERATORS}) AS BIGINT) AS total_operators, CAST(len({OPERANDS}) AS BIGINT) AS total_operands"
HALSTEAD = "distinct_operators + distinct_operands AS vocabulary, total_operators + total_operands AS length, CASE WHEN distinct_operators + distinct_operands <= 1 OR total_operators + total_operands = 0 THEN 0.0 ELSE (total_operators + total_operands) * log2(distinct_operators + distinct_operands) END AS volume, (distinct_operators / 2.0) * (total_operands / greatest(distinct_operands, 1)) AS difficulty"
MEASURED = f"{FILES}, {slim()}, counted AS (SELECT *, {CYCLOMATIC} AS cyclomatic, {COUNTS} FROM slim), hal AS (SELECT *, {HALSTEAD} FROM counted), measured AS (SELECT *, least(100.0, greatest(0.0, 171 - 5.2 * ln(greatest(volume, 1.0)) - 0.23 * cyclomatic - 16.2 * ln(greatest(sloc, 1))) * 100.0 / 171.0) AS maintainability FROM hal)"
DELTAS = "deltas AS (SELECT event_id AS oid, event_type AS author, ts, path FROM events JOIN files ON user_id = doc_id)"
CHURN = "SELECT path, count(DISTINCT oid) AS commits, count(DISTINCT author) AS authors, min(ts) AS first_commit, max(ts) AS last_commit FROM {} GROUP BY path"
HISTORY = f"{MEASURED}, {DELTAS}, hist AS ({CHURN.format('deltas')}), withhist AS (SELECT m.*, coalesce(commits, 0) AS commits FROM measured m LEFT JOIN hist USING (path))"
SCORE = "0.4 * (sloc / (sloc + 1000.0)) + 0.4 * (cyclomatic / (cyclomatic + 100.0)) + 0.2 * (commits / (commits + 20.0))"
RISKS = f"{HISTORY}, risks AS (SELECT path, {SCORE} AS score, sloc, cyclomatic, commits, array_to_string(list_filter([CASE WHEN sloc >= 660 THEN 'size' END, CASE WHEN cyclomatic >= 66 THEN 'complexity' END, CASE WHEN commits >= 13.2 THEN 'churn' END], lambda x: x IS NOT NULL), ',') AS reasons FROM withhist WHERE {SCORE} > 0)"
MINIFIED = f"(len(list_filter({LINES}, lambda x: strlen(x) > 2000)) > 0 OR (len({LINES}) > 1 AND coalesce(list_sum(list_transform({LINES}, lambda x: strlen(x))), 0) > 250 * len({LINES})))"
BANNER = f"len(list_filter(list_filter({LINES}, lambda x: regexp_matches(x, '\\S'))[1:5], lambda x: regexp_matches(lower(x), '^\\s*(?://|#|/\\*)\\s*(?:@generated|code generated by|this file was generated|this file is generated|automatically generated|auto-generated|generated.*do not edit)'))) > 0"
HINT = f"CASE WHEN {MINIFIED} THEN 'minified' WHEN {BANNER} THEN 'generated' END"


def markers(names: list[str], source: str, column: str) -> str:
    parts = [rf"SELECT *, '{m}' AS marker, CAST(len(regexp_extract_all({column}, '\b{m}\b')) AS BIGINT) AS n FROM {source}" for m in names]
    return " UNION ALL ".join(parts)


def occurrences(names: list[str]) -> str:
    return f"lines0 AS (SELECT path, {LINES} AS ls FROM files), lines1 AS (SELECT path, unnest(ls) AS s, unnest(range(1, len(ls) + 1)) AS line FROM lines0), occ0 AS ({markers(names, 'lines1', 's')}), occ AS (SELECT path, marker, CAST(line AS BIGINT) AS line, md5(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS context_hash, n AS hits FROM occ0 WHERE n > 0), occurrences AS (SELECT *, row_number() OVER (PARTITION BY path, marker, context_hash ORDER BY line) AS ordinal FROM occ)"


TOKEN = "[A-Za-z0-9_À-ÿ]+|[^\\sA-Za-z0-9_À-ÿ]"
WINDOWS = f"tok AS (SELECT path, language, regexp_extract_all(content, '{TOKEN}') AS t FROM files), pos AS (SELECT path, language, t, unnest(range(0, len(t) - {WIDTH} + 1)) AS start FROM tok WHERE len(t) >= {WIDTH}), windows AS (SELECT path, language, start, md5(array_to_string(t[start + 1:start + {WIDTH}], ' ')) AS hash FROM pos)"
FAMILIES = f"{FILES}, {WINDOWS}, fams AS (SELECT hash, count(*) AS copies, min({{'path': path, 'start': start}}) AS first FROM windows GROUP BY hash HAVING count(*) > 1), repeated AS (SELECT w.*, copies, first FROM windows w JOIN fams USING (hash))"
REGIONS = f"{FAMILIES}, later AS (SELECT path, language, start, first.path AS first_path, first.start AS first_start FROM repeated WHERE NOT (path = first.path AND start = first.start)), isl AS (SELECT *, start - row_number() OVER (PARTITION BY path, first_path, start - first_start ORDER BY start) AS island, start - first_start AS diagonal FROM later), regions AS (SELECT path, language, first_path, min(start) AS start, max(start) + {WIDTH} AS \"end\", min(first_start) AS first_start FROM isl GROUP BY path, language, first_path, diagonal, island)"
COVER = f"{FAMILIES}, covered AS (SELECT path, language, count(DISTINCT start + k) AS n FROM repeated, range(0, {WIDTH}) r(k) GROUP BY path, language)"
DUPLICATED = f"{COVER.removeprefix(FILES + ', ')}, shares AS (SELECT coalesce(sum(n) * 100.0 / sum(len(t)), 0) AS all_pct, coalesce(sum(n) FILTER (WHERE language = 'en') * 100.0 / sum(len(t)) FILTER (WHERE language = 'en'), 0) AS en_pct FROM tok LEFT JOIN covered USING (path, language))"
SUMMARY = f"{HISTORY}, {DUPLICATED}, summary AS (SELECT count(*) AS files, sum(tokens) AS tokens, sum(sloc) AS sloc, avg(cyclomatic) AS avg_cyclomatic, max(cyclomatic) AS max_cyclomatic, avg(maintainability) AS avg_maintainability, min(maintainability) AS min_maintainability, count(*) FILTER (WHERE {SCORE} >= 0.1) AS high_risks, any_value(all_pct) AS duplicated_pct FROM withhist, shares)"
EDGES = "nxt AS (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem), edges AS (SELECT DISTINCT source, target FROM nxt WHERE source <> target)"
FANS = f"{EDGES}, fans AS (SELECT node, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT source AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges {{}}) GROUP BY node)"
CATALOG = f"{RISKS}, {occurrences(['stupid', 'idiot'])}, {REGIONS.removeprefix(FILES + ', ')}, cat0 AS (SELECT 'complexity' AS kind, path, 'file' AS identity, 'warning' AS severity, 1 AS start_line, greatest(loc, 1) AS end_line, CAST(cyclomatic AS DOUBLE) AS score FROM withhist WHERE cyclomatic > 2 UNION ALL SELECT 'marker', path, concat_ws('|', marker, context_hash, CAST(ordinal AS VARCHAR)), 'note', line, line, NULL FROM occurrences UNION ALL SELECT 'risk', path, 'file', 'warning', 1, 1, score FROM risks WHERE score >= 0.05 UNION ALL SELECT DISTINCT 'duplication', path, start || '|' || \"end\", 'warning', start, \"end\", CAST(\"end\" - start AS DOUBLE) FROM regions)"
CHANGED = "lines_c AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_returnflag = 'R'), isl_c AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM lines_c), merged AS (SELECT path, min(line) AS start, max(line) AS \"end\" FROM isl_c GROUP BY path, island)"
CANDIDATES = f"{HISTORY}, changed AS (SELECT DISTINCT path FROM deltas WHERE author = 'purchase'), candidates AS (SELECT path, tokens, round(least(coalesce(0, 0), 20) + ({SCORE}) * 200 + CASE WHEN commits >= 5 THEN least(commits, 20) * 4 ELSE 0 END + CASE WHEN cyclomatic >= 10 THEN least(cyclomatic, 100) * 1.5 ELSE 0 END + CASE WHEN path IN (SELECT path FROM changed) THEN 1100 ELSE 0 END, 2) AS score FROM withhist)"
CANDIDATES = CANDIDATES.replace("least(coalesce(0, 0), 20) + ", "")


def by_directory(depth: int) -> str:
    key = f"array_to_string(string_split(path, '/')[1:least({depth}, len(string_split(path, '/')) - 1)], '/')"
    return f"WITH {MEASURED} SELECT {key} AS directory, count(*) AS files, sum(tokens) AS tokens, sum(sloc) AS sloc, round(avg(cyclomatic), 6) AS avg_cyclomatic, round(avg(maintainability), 6) AS avg_maintainability FROM measured GROUP BY 1"


LANGUAGES = "SELECT language, count(*) AS files, sum(bytes) AS bytes, sum(tokens) AS tokens, sum(loc) AS loc, sum(sloc) AS sloc FROM slim GROUP BY language"
COMMENT = "CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(?:#|//|--)'))) AS BIGINT)"

ORACLES = {
    "inventory_totals": f"WITH {FILES}, {slim()} SELECT count(*) AS files, sum(bytes) AS bytes, sum(loc) AS loc, sum(sloc) AS sloc, sum(blank_lines) AS blank_lines FROM slim",
    "language_stats": f"WITH {FILES}, {slim()} {LANGUAGES}",
    "source_rollup_other": f"WITH {FILES}, {slim()}, langs AS ({LANGUAGES}) SELECT CASE WHEN language IN ('en', 'de') THEN language ELSE 'Other content' END AS language, count(*) AS formats, sum(files) AS files, sum(bytes) AS bytes, sum(tokens) AS tokens, sum(loc) AS loc, sum(sloc) AS sloc FROM langs GROUP BY 1",
    "line_metrics_plain": f"WITH {FILES}, {slim()} SELECT path, loc, sloc, blank_lines FROM slim",
    "comment_ratio": f"WITH {PAGES}, l AS (SELECT path, {LINES} AS ls FROM pagefiles), c AS (SELECT path, CAST(len(ls) AS BIGINT) AS loc, {COMMENT} AS comment_lines, {BLANK} AS blank FROM l) SELECT path, loc, loc - comment_lines - blank AS sloc, comment_lines, round(CASE WHEN loc - blank = 0 THEN 0.0 ELSE comment_lines / (loc - blank) END, 6) AS comment_ratio FROM c",
    "skip_hints": f"WITH {BOTH} SELECT language, coalesce({HINT}, 'none') AS skip_hint, count(*) AS files FROM allfiles GROUP BY 1, 2",
    "skip_candidates_top": f"WITH {BOTH}, h AS (SELECT path, {HINT} AS skip_hint, {TOKENS} AS tokens FROM allfiles) SELECT path, tokens, skip_hint FROM h WHERE skip_hint IS NOT NULL ORDER BY tokens DESC, path LIMIT 10",
    "minified_predicate": f"WITH {PAGES} SELECT path, {MINIFIED} AS minified FROM pagefiles",
    "marker_counts": f"WITH {FILES}, m AS ({markers(MARKERS, 'files', 'content')}) SELECT path, marker, n FROM m WHERE n > 0",
    "marker_occurrence_ordinals": f"WITH {FILES}, {occurrences(MARKERS)} SELECT path, line, context_hash, marker, hits, ordinal FROM occurrences",
    "exact_dup_documents": f"WITH {FILES}, g AS (SELECT sha256(content) AS content_hash, count(*) AS copies, min(path) AS first_path, CAST(max(strlen(content)) AS BIGINT) AS bytes FROM files GROUP BY 1) SELECT *, bytes * (copies - 1) AS wasted_bytes FROM g WHERE copies > 1",
    "top_token_files": f"WITH {FILES}, {slim()} SELECT path, tokens, language FROM slim ORDER BY tokens DESC, path LIMIT 10",
    "dir_rollup_depth1": by_directory(1),
    "dir_rollup_depth2": by_directory(2),
    "heuristic_cyclomatic": f"WITH {PAGES} SELECT path, {CYCLOMATIC} AS cyclomatic FROM pagefiles",
    "brace_nesting": f"WITH {BOTH}, b AS (SELECT path, string_split(regexp_replace(content, '[^{{}}]', '', 'g'), '') AS cs FROM allfiles), e AS (SELECT path, unnest(cs) AS c, unnest(range(0, len(cs))) AS k FROM b), s AS (SELECT path, k, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY k) AS d FROM e), m AS (SELECT path, d - least(0, min(d) OVER (PARTITION BY path ORDER BY k)) AS depth FROM s) SELECT b.path, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth FROM b LEFT JOIN m ON b.path = m.path GROUP BY b.path",
    "halstead_heuristic": f"WITH {PAGES}, c AS (SELECT path, {COUNTS} FROM pagefiles), h AS (SELECT *, {HALSTEAD} FROM c) SELECT path, distinct_operators, distinct_operands, total_operators, total_operands, vocabulary, length, round(volume, 6) AS volume, round(difficulty, 6) AS difficulty, round(difficulty * volume, 6) AS effort FROM h",
    "maintainability_index": f"WITH {MEASURED} SELECT path, sloc, cyclomatic, round(volume, 6) AS volume, round(maintainability, 6) AS maintainability FROM measured",
    "complexity_summary": f"WITH {MEASURED} SELECT round(coalesce(avg(cyclomatic), 0), 6) AS avg_cyclomatic, coalesce(max(cyclomatic), 0) AS max_cyclomatic, count(*) FILTER (WHERE cyclomatic > 20) AS over_threshold, round(coalesce(avg(maintainability), 0), 6) AS avg_maintainability, round(coalesce(min(maintainability), 0), 6) AS min_maintainability FROM measured",
    "complexity_violations": f"WITH {MEASURED} SELECT path, cyclomatic FROM measured WHERE cyclomatic > 2",
    "churn_by_path": f"WITH {FILES}, {DELTAS} {CHURN.format('deltas')}",
    "churn_capped_recent": f"WITH {FILES}, {DELTAS}, latest AS (SELECT DISTINCT oid, ts FROM deltas ORDER BY ts DESC, oid DESC LIMIT 500), d AS (SELECT * FROM deltas WHERE oid IN (SELECT oid FROM latest)) {CHURN.format('d')}",
    "churn_delta_budget": f"WITH {FILES}, {DELTAS}, s AS (SELECT oid, ts, count(*) AS n FROM deltas GROUP BY oid, ts HAVING count(*) <= 10), r AS (SELECT oid, sum(n) OVER (ORDER BY ts DESC, oid DESC) AS upto FROM s) SELECT author, count(*) AS deltas, count(DISTINCT oid) AS commits FROM deltas WHERE oid IN (SELECT oid FROM r WHERE upto <= 300) GROUP BY author",
    "hotspots": f"WITH {HISTORY} SELECT path, commits, cyclomatic, commits * (cyclomatic + 1) AS score FROM withhist WHERE commits > 0 ORDER BY score DESC, path LIMIT 10",
    "risk_scores": f"WITH {RISKS} SELECT path, round(score, 6) AS score, sloc, cyclomatic, commits, reasons FROM risks",
    "top_risks": f"WITH {RISKS} SELECT path, round(score, 6) AS score, sloc, cyclomatic, commits, reasons FROM risks ORDER BY risks.score DESC, sloc DESC, cyclomatic DESC, commits DESC, path LIMIT 10",
    "assessment": f"WITH {SUMMARY}, a AS (SELECT *, list_filter([CASE WHEN duplicated_pct > 15 THEN 'duplication' END, CASE WHEN avg_maintainability < 20 THEN 'maintainability' END, CASE WHEN high_risks >= 3 THEN 'risk' END], lambda x: x IS NOT NULL) AS r FROM summary) SELECT tokens <= 128000 AS fits_context, CASE WHEN len(r) >= 3 THEN 'high' WHEN len(r) >= 1 THEN 'medium' ELSE 'low' END AS cleanup_worth, array_to_string(r, ',') AS reasons FROM a",
    "fail_gate_eval": f"WITH {SUMMARY} SELECT 'size' AS gate, sloc > 100 OR files < 5 AS failed FROM summary UNION ALL SELECT 'upkeep', min_maintainability < 20 OR avg_cyclomatic >= 30 FROM summary UNION ALL SELECT 'none', tokens = 1 FROM summary",
    "exact_clone_windows": f"WITH {FILES}, {WINDOWS}, s AS (SELECT hash, count(*) AS copies FROM windows GROUP BY hash) SELECT copies, count(*) AS windows FROM s WHERE copies > 1 GROUP BY copies",
    "maximal_clone_regions": f"WITH {REGIONS} SELECT path, language, first_path, start, \"end\", first_start FROM regions",
    "clone_groups_ranked": f"WITH {REGIONS}, g AS (SELECT first_path, first_start, \"end\" - start AS tokens, count(*) + 1 AS copies FROM regions GROUP BY 1, 2, 3) SELECT *, tokens * (copies - 1) AS impact FROM g ORDER BY impact DESC, tokens DESC, first_path, first_start LIMIT 20",
    "dup_token_coverage": f"WITH {COVER} SELECT path, language, n AS duplicated_tokens FROM covered",
    "dup_by_language": f"WITH {COVER}, t AS (SELECT path, language, CAST(len(t) AS BIGINT) AS tokens FROM tok), s AS (SELECT t.language, sum(tokens) AS tokens, coalesce(sum(n), 0) AS duplicated_tokens, count(n) AS files_with_clones FROM t LEFT JOIN covered USING (path, language) GROUP BY 1) SELECT *, round(CASE WHEN tokens = 0 THEN 0.0 ELSE duplicated_tokens * 100.0 / tokens END, 6) AS duplicated_pct FROM s",
    "production_dup": f"WITH {FAMILIES} SELECT path, count(DISTINCT start + k) FILTER (WHERE start + k >= 100) AS production_tokens FROM repeated, range(0, {WIDTH}) r(k) GROUP BY path",
    "rare_first_admission": f"WITH {FILES}, {WINDOWS}, s AS (SELECT hash, count(*) AS copies FROM windows GROUP BY hash HAVING count(*) > 1), p AS (SELECT *, CAST(CASE WHEN copies <= 65 THEN copies * (copies - 1) / 2 ELSE 2080 + (copies - 65) * 64 END AS BIGINT) AS pairs FROM s), r AS (SELECT *, coalesce(sum(pairs) OVER (ORDER BY copies, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT hash, copies, CAST(least(pairs, 20000 - before) AS BIGINT) AS pairs FROM r WHERE before < 20000",
    "bucket_predecessor_cap": f"WITH {FILES}, {WINDOWS}, s AS (SELECT hash, count(*) AS copies FROM windows GROUP BY hash HAVING count(*) > 1) SELECT copies, count(*) AS buckets, sum(CAST(CASE WHEN copies <= 65 THEN copies * (copies - 1) / 2 ELSE 2080 + (copies - 65) * 64 END AS BIGINT)) AS pairs FROM s GROUP BY copies",
    "fan_counts": f"WITH {FANS.format('')} SELECT * FROM fans",
    "top_depended": f"WITH {FANS.format('')} SELECT node, fan_in FROM fans WHERE fan_in > 0 ORDER BY fan_in DESC, node LIMIT 10",
    "graph_orphans": f"WITH {FANS.format('UNION ALL SELECT p_partkey, 0, 0 FROM part')} SELECT node FROM fans WHERE fan_in = 0",
    "graph_focus_depth2": f"WITH {EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS distance UNION ALL SELECT target, 1 FROM edges WHERE source = 1 UNION ALL SELECT b.target, 2 FROM edges a JOIN edges b ON a.target = b.source WHERE a.source = 1) SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM r GROUP BY node",
    "impact_reverse_bfs": f"WITH RECURSIVE {EDGES}, r(node, distance) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT source, distance + 1 FROM r JOIN edges ON target = node WHERE distance < 8), m AS (SELECT node, min(distance) AS distance FROM r GROUP BY node) SELECT node, CAST(distance AS BIGINT) AS distance, CASE WHEN distance = 1 THEN 'direct' ELSE 'transitive' END AS kind FROM m WHERE distance > 0",
    "components": f"WITH RECURSIVE {EDGES}, both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), root AS (SELECT min(a) AS node FROM both_ways), r(node) AS (SELECT node FROM root UNION SELECT b FROM r JOIN both_ways ON a = node) SELECT node, (SELECT node FROM root) AS component FROM r UNION ALL SELECT DISTINCT a, NULL FROM both_ways WHERE a NOT IN (SELECT node FROM r)",
    "scc_cycles": "WITH RECURSIVE nxt AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events), edges AS (SELECT DISTINCT source, target FROM nxt WHERE source <> target), r(a, b) AS (SELECT source, target FROM edges UNION SELECT a, target FROM r JOIN edges ON b = source), m AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT component, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM m GROUP BY component HAVING count(*) > 1",
    "graph_projection": f"WITH {EDGES}, n AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT target FROM edges WHERE source = 1) SELECT source, target FROM edges WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)",
    "symbol_edges_resolved": "WITH x AS (SELECT c_nationkey AS source, s_nationkey AS target, o_orderstatus AS resolver, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) SELECT source, target, 'orders' AS relation, arg_min(resolver, rank) AS resolver, count(*) AS \"references\" FROM x GROUP BY source, target",
    "import_roots_distinct": "WITH h AS (SELECT page_id, regexp_extract_all(html, 'href=\"/([A-Za-z]+)', 1) AS hs FROM pages), e AS (SELECT page_id, unnest(hs) AS root, unnest(range(0, len(hs))) AS k FROM h), f AS (SELECT page_id, root, min(k) AS k FROM e GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS ord, root FROM f",
    "findings_catalog": f"WITH {CATALOG} SELECT kind || ':v1:' || md5(concat_ws('|', kind, path, identity)) AS fingerprint, kind, path, severity, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, round(score, 6) AS score FROM cat0",
    "findings_compare": f"WITH {HISTORY}, cut AS (SELECT quantile_cont(oid, 0.5) AS m FROM deltas), ho AS (SELECT path, count(DISTINCT oid) AS c FROM deltas, cut WHERE oid <= m GROUP BY path), s AS (SELECT path, {SCORE} AS now, {SCORE.replace('commits', 'coalesce(c, 0)')} AS was FROM withhist LEFT JOIN ho USING (path)) SELECT path, CASE WHEN was < 0.05 THEN 'new' WHEN now < 0.05 THEN 'resolved' WHEN now > was THEN 'worsened' ELSE 'improved' END AS state FROM s WHERE (was >= 0.05 OR now >= 0.05) AND ((was >= 0.05) <> (now >= 0.05) OR abs(now - was) >= 0.01)",
    "rename_remap": f"WITH {MEASURED}, r AS (SELECT regexp_replace(path, '^src0/', 'core/') AS path FROM measured WHERE cyclomatic > 2) SELECT 'complexity:v1:' || md5(concat_ws('|', 'complexity', path, 'file')) AS fingerprint, path, 'complexity' AS kind FROM r",
    "merge_changed_lines": f"WITH {CHANGED} SELECT path, start, \"end\" FROM merged",
    "review_changed_ranges": f"WITH {CHANGED}, f AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_partkey AS part, CAST(l_linenumber - 1 AS BIGINT) AS start_line, CAST(l_linenumber + 1 AS BIGINT) AS end_line FROM lineitem WHERE l_quantity >= 45) SELECT * FROM f WHERE EXISTS (SELECT 1 FROM merged m WHERE m.path = f.path AND start_line <= m.\"end\" AND m.start <= end_line)",
    "interval_union": "WITH i AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS b, CAST(l_linenumber + l_quantity AS BIGINT) AS e FROM lineitem), f AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i), g AS (SELECT *, sum(CASE WHEN far IS NULL OR b > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f) SELECT l_orderkey, min(b) AS b, max(e) AS e FROM g GROUP BY l_orderkey, k",
    "baseline_delta": f"WITH {SUMMARY}, en AS (SELECT avg(maintainability) AS a, min(maintainability) AS i, max(cyclomatic) AS c FROM withhist WHERE language = 'en') SELECT 'duplicated_pct' AS metric, round(en_pct, 6) AS before, round(all_pct, 6) AS after, all_pct - en_pct > 0.01 AS regressed FROM shares UNION ALL SELECT 'avg_maintainability', round(a, 6), round(avg_maintainability, 6), a - avg_maintainability > 0.01 FROM en, summary UNION ALL SELECT 'min_maintainability', round(i, 6), round(min_maintainability, 6), i - min_maintainability > 0.01 FROM en, summary UNION ALL SELECT 'max_cyclomatic', c, max_cyclomatic, max_cyclomatic > c FROM en, summary",
    "symbol_locate_ranked": "WITH p AS (SELECT p_name AS name, p_brand AS kind, CAST(p_partkey AS VARCHAR) AS path, regexp_extract(p_name, '([^.:\\\\]+)[.:\\\\]*$', 1) AS simple FROM part), r AS (SELECT name, kind, path, CASE WHEN name = 'widget' THEN 0 WHEN lower(name) = 'widget' THEN 1 WHEN simple = 'widget' THEN 2 WHEN lower(simple) = 'widget' THEN 3 WHEN starts_with(lower(name), 'widget') OR starts_with(lower(simple), 'widget') THEN 4 WHEN contains(lower(name), 'widget') THEN 5 END AS rank FROM p) SELECT name, kind, path, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, name, path LIMIT 20",
    "explain_one": f"WITH {HISTORY} SELECT path, language, tokens, sloc, commits, coalesce({HINT}, 'none') AS skip_hint, false AS test, false AS entrypoint, round({SCORE}, 6) AS score FROM withhist WHERE doc_id = 1",
    "matching_tests": "SELECT source || '/src/m' || CAST(doc_id AS VARCHAR) || '.py' AS path, source || '/tests/test_m' || CAST(doc_id AS VARCHAR) || '.py' AS test FROM documents WHERE lang = 'en'",
    "gap_classification": f"WITH {FILES}, {DELTAS} SELECT CASE WHEN path IN (SELECT path FROM deltas) THEN 'changed' WHEN language = 'de' THEN 'impacted' WHEN language = 'fr' THEN 'selected' ELSE 'outside' END AS class, count(*) AS files FROM files GROUP BY 1",
    "reading_relations": "WITH s AS (SELECT DISTINCT source FROM documents WHERE lang = 'en') SELECT source || '/tests/test_m' || CAST(doc_id AS VARCHAR) || '.py' AS path, 500.0 AS score FROM documents WHERE lang = 'en' UNION ALL SELECT source || '/src/m' || CAST(doc_id AS VARCHAR) || '.py', 75.0 FROM documents JOIN s USING (source) WHERE lang <> 'en'",
    "governing_configs": f"WITH {FILES}, p AS (SELECT string_split(path, '/') AS p FROM files) SELECT p[1] || '/package.json' AS config, count(*) AS files FROM p GROUP BY 1 UNION ALL SELECT p[1] || '/' || p[2] || '/tsconfig.json', count(*) FROM p GROUP BY 1",
    "bucket_predecessors": f"WITH {FILES}, r AS (SELECT md5(content) AS h, path, row_number() OVER (PARTITION BY md5(content) ORDER BY path) AS r FROM files WHERE content IS NOT NULL) SELECT l.path AS left_path, x.path AS right_path FROM r l JOIN r x ON l.h = x.h AND l.r < x.r AND (l.r <= 2 OR l.r >= x.r - 3)",
    "languages_with_clones": f"WITH {COVER} SELECT language, sum(n) AS duplicated_tokens FROM covered GROUP BY language",
    "context_selection": f"WITH RECURSIVE {CANDIDATES}, ranked AS (SELECT path, CAST(tokens AS BIGINT) AS tokens, CAST(score AS DOUBLE) AS score, row_number() OVER (ORDER BY score DESC, tokens, path) AS rank FROM candidates), walk AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS reason UNION ALL SELECT r.rank, CASE WHEN n < 25 AND tokens <= 32000 AND used + tokens <= 32000 THEN used + tokens ELSE used END, CASE WHEN n < 25 AND tokens <= 32000 AND used + tokens <= 32000 THEN n + 1 ELSE n END, CASE WHEN n >= 25 THEN 'file limit' WHEN tokens > 32000 THEN 'over the budget' WHEN used + tokens > 32000 THEN 'does not fit' END FROM walk w JOIN ranked r ON r.rank = w.rank + 1) SELECT path, tokens, score, rank, reason FROM ranked JOIN walk USING (rank)",
    "type2_clone_families": f"WITH {FILES}, tok AS (SELECT path, regexp_extract_all(content, '{TOKEN}') AS t FROM files), one AS (SELECT path, unnest(t) AS x, unnest(range(0, len(t))) AS k FROM tok), coded AS (SELECT path, k, x, CASE WHEN regexp_matches(x, '^[A-Za-z_À-ÿ]') THEN 'w' WHEN regexp_matches(x, '^[0-9]') THEN 'n' ELSE x END AS kind, CASE WHEN regexp_matches(x, '^[A-Za-z_À-ÿ]') THEN coalesce(k - lag(k) OVER (PARTITION BY path, x ORDER BY k), 0) ELSE 0 END AS back FROM one), lists AS (SELECT path, list(kind ORDER BY k) AS kinds, list(back ORDER BY k) AS backs, list(x ORDER BY k) AS xs FROM coded GROUP BY path HAVING count(*) >= {WIDTH}), pos AS (SELECT *, unnest(range(0, len(xs) - {WIDTH} + 1)) AS start FROM lists), coded2 AS (SELECT path, start, md5(array_to_string(list_transform(backs[start + 1:start + {WIDTH}], lambda d, i: CASE WHEN d < i THEN d ELSE 0 END), ' ') || '|' || array_to_string(kinds[start + 1:start + {WIDTH}], ' ')) AS shape, md5(array_to_string(xs[start + 1:start + {WIDTH}], ' ')) AS exact FROM pos), g AS (SELECT shape, exact, count(*) AS n, min({{'path': path, 'start': start}}) AS first FROM coded2 GROUP BY ALL), f AS (SELECT shape, sum(n) AS copies, count(*) AS variants, min(first) AS first FROM g GROUP BY shape HAVING count(*) > 1) SELECT copies, variants, first.path AS first_path, first.start AS first_start FROM f",
    "context_scores": f"WITH {CANDIDATES} SELECT path, score FROM candidates",
    "work_scope_budget": f"WITH {FILES}, {DELTAS}, s AS (SELECT 1 AS section, min(oid) AS ord, path FROM deltas GROUP BY path UNION ALL SELECT 2, doc_id, path FROM files WHERE language = 'de' UNION ALL SELECT 3, doc_id, path FROM files), f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY section, ord) AS k FROM s) SELECT path, section, ord FROM f WHERE k = 1 ORDER BY section, ord, path LIMIT 25",
    "change_summary_budget": f"WITH {FILES}, s AS (SELECT CASE language WHEN 'fr' THEN 1 WHEN 'es' THEN 2 WHEN 'de' THEN 3 WHEN 'en' THEN 4 ELSE 5 END AS section, doc_id, path FROM files), t AS (SELECT * FROM s ORDER BY section, doc_id, path LIMIT 100) SELECT section, count(*) AS files FROM t GROUP BY section",
    "event_sequence_ranks": "SELECT event_id, row_number() OVER w AS ordinal, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
}

#: Sums of integers come as wider types from DuckDB; these columns are cast to those of the queries.
TYPES = {
    "inventory_totals": "bytes BIGINT, loc BIGINT, sloc BIGINT, blank_lines BIGINT",
    "language_stats": "bytes BIGINT, tokens BIGINT, loc BIGINT, sloc BIGINT",
    "source_rollup_other": "files BIGINT, bytes BIGINT, tokens BIGINT, loc BIGINT, sloc BIGINT",
    "dir_rollup_depth1": "tokens BIGINT, sloc BIGINT",
    "dir_rollup_depth2": "tokens BIGINT, sloc BIGINT",
    "dup_by_language": "tokens BIGINT, duplicated_tokens BIGINT",
    "bucket_predecessor_cap": "pairs BIGINT",
    "fan_counts": "fan_in BIGINT, fan_out BIGINT",
    "top_depended": "fan_in BIGINT",
    "languages_with_clones": "duplicated_tokens BIGINT",
    "type2_clone_families": "copies BIGINT",
    "reading_relations": "score DOUBLE",
}
for _name, _types in TYPES.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in _types.split(", ")))
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
