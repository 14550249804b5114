"""The SQL that gives the rows of each query, for an engine with list functions."""

TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')"
LOWER = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = rf"""words AS (
  SELECT doc_id, unnest(p) AS word, generate_subscripts(p, 1) - 1 AS pos
  FROM (SELECT doc_id, CASE WHEN text <> '' AND rtrim(text, {BLANKS}) = '' THEN [] ELSE string_split_regex(rtrim(text, {BLANKS}), '[ \t\n\x0B\f\r]') END AS p FROM documents)
)"""
TF = f"tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) GROUP BY ALL)"
DF = f"{TF}, df AS (SELECT *, count(*) OVER (PARTITION BY word ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS df FROM tf)"
PAGES = f"""tok AS (SELECT conv_id AS page, turn + 1 AS version, {LOWER} AS p FROM conversations),
each AS (SELECT page, version, unnest(p) AS word, generate_subscripts(p, 1) - 1 AS pos FROM tok),
pages_ AS (SELECT page, version, word, list(pos ORDER BY pos) AS positions, min(pos) AS first, count(*) AS n FROM each GROUP BY ALL)"""
PACK = lambda page, pos, version, n="0": f"CAST({page} * 1099511627776 + {pos} * 1048576 + {version} * 4096 + {n} AS BIGINT)"
DIFFS = f"""{PAGES}, seen AS (
  SELECT *, lag(first) OVER w AS old_first, lag(n) OVER w AS old_n, lag(version) OVER w AS old_version, row_number() OVER w AS place
  FROM pages_ WINDOW w AS (PARTITION BY page, word ORDER BY version)
)"""
EVENTS = "(PARTITION BY user_id ORDER BY ts, event_id ROWS {} PRECEDING)"
EDGES = "edges AS (SELECT DISTINCT source, target FROM (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS target FROM lineitem) WHERE target IS NOT NULL)"
BM25 = f"""tok AS (SELECT doc_id AS page, {LOWER} AS p FROM documents),
sizes AS (SELECT page, len(p) AS length FROM tok),
total AS (SELECT count(*) AS n, avg(length) AS mean FROM sizes),
hit AS (SELECT page, word, count(*) AS tf FROM (SELECT page, unnest(p) AS word FROM tok) GROUP BY ALL),
term AS (SELECT word, count(*) AS df FROM hit GROUP BY word HAVING count(*) * 3 < (SELECT n FROM total) ORDER BY df DESC, word LIMIT 3),
idf AS (SELECT word, log10((n - df + 0.5) / (df + 0.5)) AS idf FROM term, total),
score AS (
  SELECT page, sum(idf * (tf / length) * 3 / ((tf / length) + 2 * (0.25 + 0.75 * length / mean))) AS score
  FROM hit JOIN idf USING (word) JOIN sizes USING (page), total WHERE idf >= 0 GROUP BY page
)"""


def _grouping(before: int) -> str:
    return f"SELECT event_id, array_to_string(list(event_type) OVER {EVENTS.format(before)}, ',') AS items FROM events"


def _undo(window: int) -> str:
    return f"""SELECT event_id, items FROM (
  SELECT event_id, array_to_string(list(event_type) OVER {EVENTS.format(window - 1)}, ',') AS items,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events
) WHERE rn >= {window} OR (n < {window} AND rn = n)"""


def _hash_stage(source: str) -> str:
    lag = "lag(v) OVER (PARTITION BY v % 20 ORDER BY o_orderkey)"
    h = f"CASE WHEN {lag} IS NULL THEN 31 + v ELSE 31 * wrap(31 + {lag}) + v END"
    for_wrap = h.replace(f"wrap(31 + {lag})", f"(((31 + {lag} + 2147483648) & 4294967295) - 2147483648)")
    return f"SELECT o_orderkey, ((({for_wrap}) + 2147483648) & 4294967295) - 2147483648 AS v FROM {source}"


FOLD = """SELECT user_id, event_id, list_reduce(list_prepend(CAST(7 AS BIGINT), list(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), lambda s, x: (s * 31 + x) % 1000003) AS state FROM events"""
MARKERS = "line AS (SELECT doc_id AS label_doc, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"

ORACLES = {
    "map_chain": "SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) * 24 AS value FROM lineitem",
    "filter_events": "SELECT event_id, event_type FROM events WHERE event_type <> 'view' AND value >= 10",
    "flat_map_children": r"""SELECT doc_id, line_no, child, word FROM (
  SELECT doc_id, line_no, unnest(q) AS word, generate_subscripts(q, 1) - 1 AS child FROM (
    SELECT doc_id, line_no, string_split_regex(line, '[ \t\n\x0B\f\r]') AS q FROM (
      SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))) WHERE word <> ''""",
    "union_fork": "SELECT event_id, 'low' AS side FROM events WHERE value < 50 UNION ALL SELECT event_id, 'high' FROM events WHERE value >= 50",
    "merge_bag": "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE event_type = 'click') GROUP BY ALL",
    "hash_mod": "SELECT (o_custkey - 100) % 5 AS bucket, count(*) AS n FROM orders GROUP BY ALL",
    "broadcast_twice": "SELECT n_name, count(*) AS n FROM nation, range(4) a, range(4) b GROUP BY ALL",
    "post_broadcast_state": "SELECT event_type, CAST(r.range AS INT) AS replica, count(*) AS n FROM events, range(2) r GROUP BY ALL",
    "prefixed_strings": "SELECT c_custkey, 'prefix_' || c_name AS value FROM customer",
    "grouping_w1": _grouping(0),
    "grouping_w2": _grouping(1),
    "grouping_w3": _grouping(2),
    "grouping_undo_w3": _undo(3),
    "grouping_undo_larger_than_group": _undo(60),
    "grouping_unbounded": "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS items FROM events GROUP BY user_id",
    "grouping_custom_order": "SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), value DESC, event_id ROWS 1 PRECEDING), ',') AS items FROM events",
    "grouping_composite_key": "SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS 1 PRECEDING), ',') AS items FROM events",
    "grouping_global": "SELECT n_nationkey, array_to_string(list(n_name) OVER (ORDER BY n_nationkey ROWS 2 PRECEDING), ',') AS items FROM nation",
    "triple_grouping": f"WITH a AS ({_hash_stage('(SELECT o_orderkey, o_custkey AS v FROM orders)')}), b AS ({_hash_stage('a')}) {_hash_stage('b')}",
    "running_sum": "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events",
    "running_sum_by_key": f"SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER {EVENTS.format('UNBOUNDED')} AS BIGINT) AS total FROM events",
    "running_extremes": f"SELECT event_id, min(CAST(round(value * 100) AS BIGINT)) OVER {EVENTS.format('UNBOUNDED')} AS low, max(CAST(round(value * 100) AS BIGINT)) OVER {EVENTS.format('UNBOUNDED')} AS high FROM events",
    "last_value_state": "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM events",
    "stateful_map_general": FOLD,
    "stateful_map_desc_order": "SELECT user_id, event_id, first_value(event_id) OVER w AS top, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)",
    "stateful_map_nulls": "SELECT kind, event_id, coalesce(last_value(big IGNORE NULLS) OVER (PARTITION BY kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS last, big IS NULL AS missing FROM (SELECT nullif(event_type, 'view') AS kind, ts, event_id, CASE WHEN event_id % 5 <> 0 THEN 9007199254740993 + event_id END AS big FROM events)",
    "chained_folds": "SELECT event_type, event_id, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)",
    "running_count_null_keys": "SELECT event_id, row_number() OVER (PARTITION BY nullif(event_type, 'view') ORDER BY event_id) AS n FROM events",
    "stateful_flat_map_sessions": "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 3 = 0",
    "label_scope_counts": f"SELECT doc_id AS label_doc, word, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) GROUP BY ALL",
    "label_markers": f"WITH {MARKERS} SELECT label_doc, CAST(pos AS INT) AS pos, CAST(length(line) AS INT) AS n_chars, false AS is_marker FROM line UNION ALL SELECT doc_id, -1, -1, true FROM documents",
    "label_markers_ordered": f"WITH {MARKERS} SELECT doc_id AS label_doc, CAST((SELECT count(*) FROM line WHERE label_doc = doc_id) + 1 AS INT) AS place FROM documents",
    "label_keyed_state": "SELECT conv_id, turn, count(*) OVER (PARTITION BY role, conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations",
    "wordcount_final": f"WITH {WORDS} SELECT word, count(*) AS count FROM words GROUP BY ALL",
    "wordcount_running": f"WITH {WORDS} SELECT doc_id, pos, word, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS count FROM words",
    "wordcount_top10": f"WITH {WORDS} SELECT word, count(*) AS count FROM words GROUP BY ALL ORDER BY count DESC, word LIMIT 10",
    "wordcount_bucketed_top5": f"WITH {WORDS} SELECT word, count(*) AS count FROM words GROUP BY ALL ORDER BY count DESC, word LIMIT 5",
    "word_positions": f"WITH {PAGES} SELECT page, CAST(version AS INT) AS version, word, array_to_string(positions, ',') AS positions FROM pages_",
    "packed_positions": f"WITH {PAGES} SELECT page, CAST(version AS INT) AS version, word, array_to_string(list_transform(positions, lambda p: {PACK('page', 'p', 'version')}), ',') AS packed FROM pages_",
    "unpacked_positions": f"WITH {PAGES} SELECT word, CAST(page AS INT) AS page, CAST(arg_max(first, version) AS INT) AS position, CAST(max(version) AS INT) AS version, CAST(arg_max(n, version) AS INT) AS range FROM pages_ GROUP BY page, word",
    "index_diff": f"""WITH {DIFFS}
SELECT word, page, CAST(version AS INT) AS version, 'add' AS op, CAST(-1 AS BIGINT) AS start, CAST(-1 AS INT) AS range, array_to_string(list_transform(positions, lambda p: {PACK('page', 'p', 'version')}), ',') AS positions FROM seen
UNION ALL SELECT word, page, CAST(version AS INT), 'remove', {PACK('page', 'old_first', 'old_version')}, CAST(old_n AS INT), '' FROM seen WHERE old_first IS NOT NULL""",
    "index_diff_forgetful": f"WITH {DIFFS} SELECT word, page, CAST(version AS INT) AS version, {PACK('page', 'old_first', '(CASE WHEN place = 2 THEN old_version ELSE 0 END)')} AS start, CAST(old_n AS INT) AS range FROM seen WHERE old_first IS NOT NULL",
    "index_final": f"WITH {PAGES} SELECT word, page, {PACK('page', 'arg_max(first, version)', 'max(version)', 'arg_max(n, version)')} AS entry FROM pages_ GROUP BY page, word",
    "bm25": f"WITH {BM25} SELECT page, round(score, 9) AS score FROM score",
    "bm25_all_docs": f"WITH {BM25} SELECT page, round(coalesce(score, 0), 9) AS score FROM sizes LEFT JOIN score USING (page)",
    "ranking_latest_versions": "SELECT conv_id AS page, CAST(count(*) AS INT) AS version, CAST(length(arg_max(text, turn)) AS INT) AS n_chars FROM conversations GROUP BY conv_id",
    "term_frequency": f"WITH {TF} SELECT * FROM tf",
    "split_labeled": f"WITH w AS (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) SELECT CASE WHEN quality IS NOT NULL THEN doc_id ELSE -1 END AS label_known, CASE WHEN quality IS NULL THEN doc_id ELSE -1 END AS label_unknown, count(*) AS n FROM w LEFT JOIN labels USING (doc_id) GROUP BY doc_id, quality",
    "running_df": f"WITH {DF} SELECT doc_id, word, df FROM df",
    "tfidf": f"WITH {DF}, raw AS (SELECT doc_id, word, tf * ln((doc_id + 1) / df) + 1 AS v FROM df) SELECT doc_id, word, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw",
    "decayed_idf": f"WITH {TF}, b AS (SELECT word, doc_id // 200 AS b FROM tf) SELECT word, round(sum(pow(0.761, (SELECT max(b) FROM b) - b)), 6) AS df FROM b GROUP BY word",
    "windowed_tfidf": f"WITH {TF}, raw AS (SELECT doc_id, word, tf / sum(tf) OVER (PARTITION BY doc_id) * ln((SELECT count(*) FROM documents) / count(*) OVER (PARTITION BY word)) AS v FROM tf) SELECT doc_id, word, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw",
    "vectorized": f"WITH {TF}, v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS idx FROM tf GROUP BY word HAVING count(*) >= 2) SELECT doc_id, coalesce(idx, 0) AS idx, CAST(sum(tf) AS BIGINT) AS tf FROM tf LEFT JOIN v USING (word) GROUP BY ALL",
    "bfs_two_hops": f"""WITH RECURSIVE {EDGES}, walk AS (
  SELECT p_partkey AS request, p_partkey AS vertex, 0 AS depth FROM part
  UNION ALL SELECT DISTINCT request, target, depth + 1 FROM walk JOIN edges ON vertex = source WHERE depth < 2
) SELECT request, depth, count(*) AS n, CAST(sum(vertex) AS BIGINT) AS total, CAST(sum(vertex * vertex % 1000003) AS BIGINT) AS squares FROM (SELECT request, vertex, min(depth) AS depth FROM walk GROUP BY ALL) GROUP BY ALL""",
    "bfs_with_markers": f"""WITH {EDGES}, s AS (SELECT p_partkey AS r FROM part)
SELECT r AS request, r AS vertex, 0 AS depth, false AS is_marker FROM s UNION ALL SELECT r, target, 1, false FROM s JOIN edges ON r = source WHERE target <> r UNION ALL SELECT r, -1, -1, true FROM s""",
    "bfs_mutable_edges": """WITH ask AS (SELECT event_id AS request, user_id AS vertex, ts FROM events WHERE event_type = 'purchase'),
up AS (SELECT user_id AS source, ts, event_id, [(user_id * 7 + event_id) % 150, (user_id * 3 + event_id) % 150] AS targets FROM events),
span AS (SELECT source, ts AS since, lead(ts) OVER (PARTITION BY source ORDER BY ts, event_id) AS until, targets FROM up),
one AS (SELECT DISTINCT request, a.ts, unnest(targets) AS vertex FROM ask a JOIN span s ON s.source = a.vertex AND s.since <= a.ts AND (s.until IS NULL OR s.until > a.ts)),
two AS (SELECT DISTINCT request, unnest(targets) AS vertex FROM one a JOIN span s ON s.source = a.vertex AND s.since <= a.ts AND (s.until IS NULL OR s.until > a.ts))
SELECT request, vertex, min(depth) AS depth FROM (SELECT request, vertex, 0 AS depth FROM ask UNION ALL SELECT request, vertex, 1 FROM one UNION ALL SELECT request, vertex, 2 FROM two) GROUP BY ALL""",
    "latency_percentiles": """WITH l AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS l FROM events GROUP BY user_id), k AS (SELECT l FROM l ORDER BY user_id OFFSET 20)
SELECT CAST(quantile_cont(l, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(l, 0.75) AS DOUBLE) AS p75, CAST(quantile_cont(l, 0.9) AS DOUBLE) AS p90, CAST(quantile_cont(l, 0.99) AS DOUBLE) AS p99 FROM k""",
    "validator_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "arrival_gaps": "SELECT event_id, round(-ln(1 - (event_id * 7919 % 1000 + 0.5) / 1000) * 400, 6) AS gap FROM events",
    "streaming_map_filter": "SELECT event_id, event_type FROM events WHERE event_type <> 'view' AND value >= 10",
    "streaming_wordcount": f"WITH {WORDS} SELECT word, count(*) AS count FROM words GROUP BY ALL",
    "streaming_grouping": _grouping(2),
    "streaming_running_count": "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS count FROM events",
    "streaming_fold": FOLD,
    "streaming_index_diff": f"WITH {DIFFS} SELECT word, page, CAST(version AS BIGINT) AS version, CAST(first AS INT) AS first, CAST(n AS INT) AS n, CAST(coalesce(old_first, -1) AS INT) AS old_first, CAST(coalesce(old_n, -1) AS INT) AS old_n FROM seen",
    "streaming_label_markers": f"WITH {MARKERS} SELECT label_doc, CAST(pos AS INT) AS pos, CAST(length(line) AS INT) AS n_chars, false AS is_marker FROM line UNION ALL SELECT doc_id, -1, -1, true FROM documents",
    "streaming_window_contents": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, string_agg(event_id, ',' ORDER BY ts, event_id) AS items FROM events GROUP BY ALL",
    "pages_from_xml": "SELECT conv_id AS page, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS version, 'conversation ' || conv_id AS title, CAST(length(text) AS INT) AS n_chars FROM conversations WHERE trim(text) <> ''",
    "streaming_time_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
