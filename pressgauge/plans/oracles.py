"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_EVENT_RUNS = "SELECT event_id AS run_id, event_type AS outlet, ts AS started_at, value >= 5 AS ok FROM events"
_INDEX = """SELECT event_id AS id, event_type AS outlet, ts AS seen_at,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + to_minutes(CASE WHEN event_id % 7 = 0 THEN 180 ELSE -(event_id % 240) END) END AS published_at FROM events"""
_EFF = "least(coalesce(published_at, seen_at), seen_at)"
_LOCAL = lambda c: f"(({c}) + INTERVAL 8 HOUR)"  # noqa: E731  the zone has had no clock change since 1979
_S = lambda c: f"CAST(floor(epoch({c})) AS BIGINT)"
_US = lambda c: f"epoch_us({c})"
_WITH = f"""WITH runs AS ({_EVENT_RUNS}), idx AS ({_INDEX}),
totals AS (SELECT outlet, CAST({_LOCAL(_EFF)} AS DATE) AS day, count(*) AS total_articles FROM idx GROUP BY 1, 2),
good AS (SELECT outlet, {_LOCAL('started_at')} AS ts, {_US('started_at')} AS us, row_number() OVER (PARTITION BY outlet ORDER BY started_at, run_id) AS nth FROM runs WHERE ok),
cov AS (SELECT g.outlet, CAST(g.ts AS DATE) AS day, min(g.ts) AS first_run, max(g.ts) AS last_run, coalesce(max(g.us - p.us), 356400000000) AS max_gap_us
  FROM good g LEFT JOIN good p ON p.outlet = g.outlet AND p.nth + 1 = g.nth GROUP BY 1, 2),
rolled AS (SELECT t.outlet, t.day, total_articles, coalesce(t.day < DATE '2024-01-31' AND first_run <= CAST(t.day AS TIMESTAMP) + INTERVAL 90 MINUTE
  AND last_run >= CAST(t.day AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 90 MINUTE AND max_gap_us <= 5400000000, FALSE) AS complete
  FROM totals t LEFT JOIN cov c ON t.outlet = c.outlet AND t.day = c.day)
"""
_DAY = "strftime(day, '%Y-%m-%d') AS day"
_HEALTH = f"""SELECT outlet, strftime({_LOCAL('max(started_at)')}, '%m-%d %H:%M') AS last_ok, count(*) AS ok_runs, coalesce(max(gap), 0) // 1000000 AS largest_gap_seconds
FROM (SELECT outlet, started_at, {_US('started_at')} - {_US('lag(started_at) OVER (PARTITION BY outlet ORDER BY started_at, run_id)')} AS gap
  FROM ({_EVENT_RUNS}) WHERE ok AND started_at > TIMESTAMP '2024-01-30 00:00:00') GROUP BY outlet"""
_SIGHT = "SELECT event_id AS id, event_type AS outlet, 'u' || user_id AS url, ts AS seen_at FROM events"
_CUT = "TIMESTAMP '2024-01-10'"
_URL = r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
u AS (SELECT page_id, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda s: s <> ''
  AND NOT (lower(string_split(s, '=')[1]) IN ('fbclid','gclid','yclid','msclkid','from','source','ref','share','share_source','amp','at_medium','at_campaign','_gl')
  OR lower(s) LIKE 'utm\_%' ESCAPE '\'))), '&') AS q FROM p),
canon AS (SELECT page_id, 'https://' || host || path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url_canonical FROM u)
"""
_O = "o_orderdate"
_MIN = "date_trunc('minute', o_orderdate)"
_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"

_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace({}, '([.!?。!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"
_HASH = "CAST('0x' || left(md5(t), 16) AS UBIGINT)"
_SIMHASH = f"""WITH RECURSIVE h AS (SELECT doc_id, {_HASH} AS h FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS t FROM documents)),
votes AS (SELECT doc_id, count(*) AS n, {', '.join(f'sum(CAST((h >> {i}) & 1 AS BIGINT)) AS v{i}' for i in range(64))} FROM h GROUP BY 1),
prints AS (SELECT doc_id, CAST({' + '.join(f'CASE WHEN 2 * v{i} > n THEN {1 << i if i < 63 else -(1 << 63)}::HUGEINT ELSE 0 END' for i in range(64))} AS BIGINT) AS simhash FROM votes)"""
_LINKS = f"""{_SIMHASH}, v AS (SELECT DISTINCT simhash FROM prints),
links AS (SELECT x.simhash AS a, y.simhash AS b, CAST(bit_count(xor(x.simhash, y.simhash)) AS INTEGER) AS distance FROM v x JOIN v y ON x.simhash < y.simhash WHERE bit_count(xor(x.simhash, y.simhash)) <= 3)"""
_BODY = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size > 0 THEN trim(repeat(p_name || ' ', p_size)) || chr(10) ELSE '' END || p_type || '!'
  WHEN 1 THEN CASE WHEN p_size > 0 THEN trim(repeat(p_name || ' ', p_size)) || chr(10) ELSE '' END || p_type
  WHEN 2 THEN trim(repeat(p_name || ' ', p_size)) ELSE '' END AS body FROM part"""
_TIMES = """SELECT p_partkey, list_filter([
  CASE p_partkey % 7 WHEN 0 THEN dy || 'T08:00:00+08:00' WHEN 1 THEN dy || 'T09:00:00Z' END, CASE WHEN p_partkey % 5 = 1 THEN dy || ' 11:00:00' END,
  CASE WHEN p_partkey % 5 < 2 THEN dy || ' 10:00:00' END, CASE WHEN p_partkey % 5 = 2 THEN dy || ' 12:00:00' END,
  CASE WHEN p_partkey % 3 = 0 THEN dy || 'T13:00:00+00:00' END], lambda x: x IS NOT NULL) AS times
  FROM (SELECT p_partkey, '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS dy FROM part)"""
_SEEN = "1705233600"
_TIER2 = f"""WITH page AS (SELECT p_partkey AS id, b.body, t.times, p_partkey % 3 = 0 AS from_cache, p_partkey % 3 = 0 OR p_partkey % 5 <> 0 AS got
  FROM part JOIN ({_BODY}) b USING (p_partkey) JOIN ({_TIMES}) t USING (p_partkey) WHERE list_contains(string_split(p_name, ' '), 'widget')),
judged AS (SELECT id, from_cache, got, CASE WHEN got THEN length(body) END AS body_chars,
  CASE WHEN NOT got THEN 'page not available' WHEN length(body) < 80 THEN 'body too short: ' || length(body) || ' chars' END AS error,
  list_filter(list_transform(times, lambda x: CAST(epoch(CAST(replace(left(x, 19), 'T', ' ') AS TIMESTAMP)) AS BIGINT) - CASE WHEN x LIKE '%Z' OR x LIKE '%+00:00' THEN 0 ELSE 28800 END), lambda x: x <= {_SEEN} + 7200)[1] AS found_s FROM page),
outcome AS (SELECT id, from_cache, got, body_chars, error, CASE WHEN error IS NULL THEN 'fetched' ELSE 'failed' END AS state,
  CASE WHEN error IS NULL THEN found_s END AS recovered_s, id % 6 <> 0 AND error IS NULL AND found_s IS NOT NULL AS backfills FROM judged)"""
_FEEDS = """WITH feeds AS (SELECT 'r' || n_regionkey AS outlet, n_nationkey AS feed_pos, n_nationkey % 11 <> 10 AS up, 'https://x.example/' || n_nationkey % 7 || '?utm_source=a' AS link,
  'It’s ' || n_name || ' & co & 中' AS title, CASE WHEN n_nationkey % 3 = 2 THEN 0 ELSE 1704420000 END AS published_s FROM nation)"""
_TIER1 = f"""{_FEEDS}, stubs AS (SELECT outlet, link, arg_min(title, feed_pos) AS title FROM feeds WHERE up GROUP BY 1, 2),
new AS (SELECT outlet, replace(link, '?utm_source=a', '') AS url_canonical, link AS url_original, replace(replace(title, '’', ' ’ '), '_', ' _ ') AS title_seg FROM stubs
  WHERE (outlet, link) NOT IN (('r0', 'https://x.example/0?utm_source=a'), ('r1', 'https://x.example/1?utm_source=a'))),
log AS (SELECT o.outlet, coalesce(s.n, 0) AS items_seen, coalesce(w.n, 0) AS items_new, e.error FROM (SELECT DISTINCT outlet FROM feeds UNION SELECT 'silent') o
  LEFT JOIN (SELECT outlet, count(*) AS n FROM stubs GROUP BY 1) s ON s.outlet = o.outlet LEFT JOIN (SELECT outlet, count(*) AS n FROM new GROUP BY 1) w ON w.outlet = o.outlet
  LEFT JOIN (SELECT outlet, count(*) FILTER (WHERE NOT up) || ' of ' || count(*) || ' feeds failed: ' || string_agg(CAST(feed_pos AS VARCHAR), ', ' ORDER BY feed_pos) FILTER (WHERE NOT up) AS error
    FROM feeds GROUP BY 1 HAVING count(*) FILTER (WHERE NOT up) > 0) e ON e.outlet = o.outlet)"""

ORACLES = {
    "daily_totals": f"{_WITH} SELECT outlet, {_DAY}, total_articles FROM totals",
    "trailing_totals": f"SELECT outlet, strftime(CAST({_LOCAL(_EFF)} AS DATE), '%Y-%m-%d') AS day, count(*) AS total_articles FROM ({_INDEX}) WHERE {_EFF} >= TIMESTAMP '2024-01-23 16:00:00' GROUP BY 1, 2",
    "day_coverage": f"{_WITH} SELECT outlet, {_DAY}, {_S('first_run')} AS first_run_s, {_S('last_run')} AS last_run_s, max_gap_us FROM cov",
    "daily_completeness": f"{_WITH} SELECT outlet, {_DAY}, total_articles, complete FROM rolled",
    "completeness_summary": f"{_WITH} SELECT count(*) FILTER (WHERE complete) AS complete_days, count(*) FILTER (WHERE NOT complete) AS incomplete_days FROM rolled",
    "rollup_upsert": f"{_WITH} SELECT outlet, {_DAY}, total_articles + CASE WHEN day >= DATE '2024-01-15' THEN 1 ELSE 0 END AS total_articles, complete FROM rolled",
    "crawl_health_24h": _HEALTH,
    "health_with_silent": f"SELECT o.outlet, last_ok, coalesce(ok_runs, 0) AS ok_runs, largest_gap_seconds FROM (SELECT DISTINCT event_type AS outlet FROM events UNION ALL SELECT 'silent') o LEFT JOIN ({_HEALTH}) h ON o.outlet = h.outlet",
    "failed_runs_text": f"SELECT count(*) FILTER (WHERE NOT ok) || ' failed runs in 24h' AS report FROM ({_EVENT_RUNS}) WHERE started_at > TIMESTAMP '2024-01-30 00:00:00'",
    "effective_at_rule": f"SELECT id, {_S(_EFF)} AS effective_s FROM ({_INDEX})",
    "first_sight_dedup": f"""WITH s AS ({_SIGHT}) SELECT outlet, url, arg_min(id, (seen_at, id)) AS id, {_S('min(seen_at)')} AS seen_s FROM s WHERE seen_at >= {_CUT}
      AND NOT EXISTS (SELECT 1 FROM s o WHERE o.seen_at < {_CUT} AND o.outlet = s.outlet AND o.url = s.url) GROUP BY 1, 2""",
    "seen_and_new": f"""WITH s AS ({_SIGHT}), b AS (SELECT outlet, url FROM s WHERE seen_at >= {_CUT}), o AS (SELECT outlet, url FROM s WHERE seen_at < {_CUT})
      SELECT (SELECT count(*) FROM b) AS items_seen, (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS items_distinct, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM o)) AS items_new""",
    "upsert_update_policy": """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS body, CASE WHEN c_custkey % 2 = 0 THEN 'fetched' ELSE 'failed' END AS enrich_state,
      CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS enrich_error FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""",
    "mark_failed": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS body, CASE WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'fetched' END AS enrich_state,
      CASE WHEN c_custkey % 5 = 0 THEN left(repeat(c_name, 200), 2000) END AS enrich_error FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 = 0""",
    "flag_fetched": "SELECT c_custkey AS id, c_custkey % 4 = 0 AS body_fetched FROM customer",
    "outlet_refresh": """SELECT CAST(n_nationkey AS VARCHAR) AS code, CASE WHEN n_nationkey >= 10 THEN n_name || '*' ELSE n_name END AS name_zh, lower(n_name) AS home_url,
      CASE WHEN n_nationkey < 20 THEN n_nationkey % 2 = 0 ELSE TRUE END AS active FROM nation""",
    "run_judgement": """WITH g AS (SELECT user_id AS outlet, count(*) FILTER (WHERE value >= 12) AS items_seen FROM events GROUP BY 1)
      SELECT outlet, items_seen, items_seen > 0 AND outlet % 17 <> 0 AS ok, CASE WHEN outlet % 17 = 0 THEN left(repeat('timeout ', 400), 2000) WHEN items_seen = 0 THEN '0 items seen' END AS error FROM g""",
    "backfill_published": f"""WITH i AS ({_INDEX}), b AS (SELECT id, seen_at, CASE WHEN id % 2 = 0 THEN coalesce(published_at, seen_at - INTERVAL 1 HOUR) ELSE published_at END AS published_at FROM i)
      SELECT id, {_S('published_at')} AS published_s, {_S(_EFF)} AS effective_s FROM b""",
    "stale_feeds": f"""SELECT outlet, id % 40 AS feed_pos, {_S('max(published_at)')} AS newest_s, coalesce(max(published_at) < TIMESTAMP '2024-01-27', FALSE) AS stale
      FROM ({_INDEX}) WHERE id % 40 > 5 OR seen_at < TIMESTAMP '2024-01-20' GROUP BY 1, 2""",
    "keep_first_link": f"SELECT outlet, url, CAST(id % 3 AS BIGINT) AS feed_pos, id FROM ({_SIGHT}) QUALIFY row_number() OVER (PARTITION BY outlet, url ORDER BY id % 3, id) = 1",
    "longest_title_per_url": """WITH l AS (SELECT p_brand AS outlet, CAST(p_size % 10 AS VARCHAR) AS url, p_partkey AS pos, p_type AS title, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS published_at FROM part),
      m AS (SELECT *, coalesce(max(length(title)) OVER (PARTITION BY outlet, url ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM l)
      SELECT outlet, url, arg_max(title, pos) AS title, arg_max(published_at, pos) FILTER (WHERE published_at IS NOT NULL) AS published_at FROM m WHERE length(title) > before GROUP BY 1, 2""",
    "canonical_url": f"{_URL} SELECT page_id, url_canonical FROM canon",
    "distinct_canonical_urls": f"{_URL} SELECT count(*) AS items_seen, count(DISTINCT url_canonical) AS items_new FROM canon",
    "url_cache_key": r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') || '/' || strftime(TIMESTAMP '2024-01-15 12:00:00' + to_hours(page_id % 240), '%Y-%m-%d')
      || '/' || sha256(url) || '.html.gz' AS path FROM pages""",
    "page_hosts": r"SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, count(*) AS pages FROM pages GROUP BY 1",
    "cache_first": "SELECT page_id AS path, page_id % 2 = 0 AS from_cache, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN length(html) END AS html_chars FROM pages",
    "strip_trailing_clock": r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '  ' || p_partkey % 130 || ':' || p_partkey % 75
      WHEN 1 THEN p_partkey % 130 || ':' || p_partkey % 75 || ' ' || p_name ELSE p_name || p_partkey % 130 || ':' || p_partkey % 75 || ' ' || p_type END AS title FROM part)
      SELECT p_partkey, regexp_replace(title, '\s*[0-9]{1,2}:[0-9]{2}$', '') AS title FROM t""",
    "datetime_prefix": f"SELECT o_orderkey, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN {_S(_O)} - 28800 END AS published_s FROM orders",
    "listing_datetime": f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_S(_O)} - 28800 WHEN 1 THEN {_S(_MIN)} - 28800 WHEN 2 THEN {_S(_O)} - 28800 END AS published_s FROM orders",
    "feed_datetime": f"SELECT o_orderkey, {_S(_O)} - CASE WHEN o_orderkey % 3 = 0 THEN 28800 ELSE 0 END AS published_s FROM orders",
    "free_datetime": f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_S(_O)} - 28800 WHEN 1 THEN {_S(_MIN)} WHEN 2 THEN {_S(_O)} - 28800 END AS published_s,
      CASE o_orderkey % 4 WHEN 0 THEN {_S(_O)} - 28800 WHEN 1 THEN {_S(_MIN)} - 28800 WHEN 2 THEN {_S(_O)} - 28800 END AS clock_kept_s FROM orders""",
    "first_acceptable_time": f"SELECT o_orderkey, {_S(_O)} - CASE WHEN o_orderkey % 2 = 0 THEN 10800 ELSE 3600 END AS published_s FROM orders",
    "epoch_seconds": "SELECT event_id, strftime(make_timestamp(event_id * 3600 * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "title_tokens": f"SELECT p_partkey, array_to_string({_WORDS.format('p_name')}, ' ') AS title_seg FROM part",
    "title_search_topk": f"""SELECT doc_id AS id, 1704067200 + (doc_id % 1000) * 60 AS effective_s FROM documents WHERE list_has_all({_WORDS.format('text')}, ['the', 'with']) ORDER BY doc_id % 1000 DESC, doc_id LIMIT 200""",
    "search_empty": f"SELECT doc_id AS id, 1704067200 + (doc_id % 1000) * 60 AS effective_s FROM documents WHERE list_contains({_WORDS.format('text')}, 'la') ORDER BY doc_id % 1000 DESC, doc_id LIMIT 20",
    "title_search_rank": f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)
      SELECT doc_id AS id, round(len(list_filter(w, lambda t: t IN ('the', 'of'))) / len(w), 9) AS rank FROM w WHERE list_has_all(w, ['the', 'of']) ORDER BY doc_id % 1000 DESC, doc_id LIMIT 50""",
    "token_postings": f"SELECT token, count(*) AS postings FROM (SELECT doc_id, unnest(list_distinct({_WORDS.format('text')})) AS token FROM documents) GROUP BY 1",
    "listing_links": r"""SELECT page_id, count(*) AS links, min(href) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) WHERE regexp_matches(href, '^/[A-Za-z]+$') GROUP BY 1""",
    "outlet_offset_lookup": "SELECT c_custkey AS id, coalesce(n_regionkey = 2, FALSE) AS timestamp_offset_is_wrong FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey",
    "coverage_weight": f"""{_WITH}, inc AS (SELECT outlet, CAST({_LOCAL(_EFF)} AS DATE) AS day, count(*) AS n FROM idx WHERE id % 10 = 0 GROUP BY 1, 2)
      SELECT r.outlet, strftime(r.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, total_articles, complete, CASE WHEN complete AND total_articles >= 20 THEN coalesce(n, 0) / total_articles END AS weight
      FROM rolled r LEFT JOIN inc i ON r.outlet = i.outlet AND r.day = i.day""",
    "baseline_relative": f"{_WITH} SELECT outlet, {_DAY}, total_articles, round(total_articles / avg(total_articles) OVER (PARTITION BY outlet), 9) AS relative FROM rolled",
    "propagation_rank": """WITH c AS (SELECT sha256(text) AS text_key, doc_id AS id, row_number() OVER w AS cluster_rank, lead(doc_id) OVER w AS nxt FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id))
      SELECT text_key, id, CAST(cluster_rank AS INTEGER) AS cluster_rank, cluster_rank = 1 AS is_origin, CASE WHEN cluster_rank = 1 THEN coalesce((nxt - id) * 420 > 1200, TRUE) END AS origin_confident FROM c""",
    "originality_rate": """WITH c AS (SELECT source AS outlet, count(*) OVER (PARTITION BY text) AS n FROM documents)
      SELECT outlet, count(*) AS articles, 1 - (count(*) FILTER (WHERE n > 1)) / count(*) AS originality_rate FROM c GROUP BY 1""",
    "stance_distribution": """SELECT source, count(*) AS n, (count(*) FILTER (WHERE quality = 0)) / count(*) AS share_0, (count(*) FILTER (WHERE quality = 1)) / count(*) AS share_1
      FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""",
    "resegment": r"""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'old' ELSE array_to_string(regexp_extract_all(p_name || '-' || p_type || '-' || p_size, 'cold widget|small bolt|[A-Za-z0-9]+|[^\s]'), ' ') END AS title_seg FROM part""",
    "pattern_listing": r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/\w[^"]*">[^<]*</a>')) AS a FROM pages),
      l AS (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS title, row_number() OVER () AS pos FROM a)
      SELECT CAST(page_id AS VARCHAR) AS outlet, 'https://listing.example.com' || href AS url_original, arg_max(title, (length(title), -pos)) AS title FROM l GROUP BY page_id, href HAVING max(length(title)) > 0""",
    "article_body": f"SELECT p_partkey, body FROM ({_BODY})",
    "article_times": f"SELECT p_partkey, array_to_string(times, '|') AS times FROM ({_TIMES})",
    "enrich_outcomes": f"{_TIER2} SELECT id, from_cache, state, error, backfills, recovered_s, body_chars FROM outcome",
    "enrich_counters": f"""{_TIER2} SELECT count(*) AS matched, count(*) FILTER (WHERE got AND NOT from_cache) AS fetched, count(*) FILTER (WHERE got AND from_cache) AS cached,
      count(*) FILTER (WHERE backfills) AS dated, count(*) FILTER (WHERE state = 'failed') AS failed FROM outcome""",
    "enrich_tables": f"""{_TIER2} SELECT p_partkey AS id, coalesce(state = 'fetched', FALSE) AS body_fetched,
      CASE WHEN p_partkey % 6 = 0 THEN {_SEEN} WHEN backfills THEN recovered_s END AS published_s,
      CASE WHEN state = 'fetched' THEN body_chars WHEN p_partkey % 8 = 0 THEN 3 END AS body_chars,
      CASE WHEN state IS NOT NULL THEN state WHEN p_partkey % 8 = 0 THEN 'fetched' END AS enrich_state,
      CASE WHEN state IS NOT NULL THEN error IS NOT NULL WHEN p_partkey % 8 = 0 THEN FALSE END AS has_error
      FROM part LEFT JOIN outcome ON id = p_partkey""",
    "island_listing": """SELECT CAST(p_partkey AS VARCHAR) AS outlet, CASE WHEN p_partkey % 5 <> 0 THEN 'https://l.example/' || CASE WHEN p_partkey % 2 = 0 THEN 'b/' || p_type ELSE 'news/' || p_partkey END END AS url_original,
      CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 THEN p_partkey + 1700000000 END AS published_s,
      CASE WHEN p_partkey % 5 = 0 THEN 'no RealTimeList island found' END AS error FROM part""",
    "feed_entries": f"""{_FEEDS} SELECT outlet, feed_pos, 0 AS entry_pos, link, title, published_s FROM feeds WHERE up
      UNION ALL SELECT outlet, feed_pos, 1, '', '', NULL FROM feeds WHERE up AND feed_pos % 2 = 0""",
    "feed_audit": f"""{_FEEDS} SELECT outlet, feed_pos, CASE WHEN NOT up THEN 0 WHEN feed_pos % 2 = 0 THEN 2 ELSE 1 END AS entries, CAST(up AS BIGINT) AS usable,
      CAST(up AND feed_pos % 3 <> 2 AS BIGINT) AS with_dates FROM feeds""",
    "audit_groups": f"""{_FEEDS}, o AS (SELECT outlet, bool_or(up) AS rss, bool_or(up AND feed_pos % 3 <> 2) AS dated FROM feeds GROUP BY 1),
      g AS (SELECT outlet, CASE WHEN rss THEN 'rss' ELSE 'html' END AS "group" FROM o UNION ALL SELECT outlet, 'nodates' FROM o WHERE rss AND NOT dated)
      SELECT "group", count(*) AS outlets, string_agg(outlet, ',' ORDER BY outlet) AS names FROM g GROUP BY 1""",
    "crawl_new_rows": f"{_TIER1} SELECT outlet, url_canonical, url_original, title_seg FROM new",
    "crawl_run_log": f"{_TIER1} SELECT outlet, items_seen, items_new, items_seen > 0 AND error IS NULL AS ok, coalesce(error, CASE WHEN items_seen = 0 THEN '0 items seen' END) AS error FROM log",
    "crawl_outcome": f"""{_TIER1} SELECT coalesce(string_agg(outlet, ',' ORDER BY outlet) FILTER (WHERE items_seen = 0 OR error IS NOT NULL), '') AS failed, '' AS empty,
      CASE WHEN count(*) FILTER (WHERE items_seen = 0 OR error IS NOT NULL) > 0 THEN 1 ELSE 0 END AS exit_code FROM log""",
    "charset_repair": "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' 新聞 é' ELSE ' 新聞' END AS text FROM part",
    "page_store": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN sha256(html) END AS html_sha256 FROM pages",
    "sql_functions": r"SELECT p_partkey, array_to_string(regexp_extract_all(p_name || ',' || p_type, '[A-Za-z0-9]+|[^\s]'), ' ') AS seg, p_name AS body, '2024-01-05 09:00:00' AS stamp FROM part",
    "lenient_datetime": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN d + 48600 WHEN 1 THEN d + 3600 WHEN 2 THEN d + 32400 WHEN 3 THEN d + 3600 END AS published_s
      FROM (SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS d FROM orders)""",
    "resolved_links": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'https://l.example/x/' || p_type WHEN 1 THEN 'https://l.example/a/' || p_type || '?q=../x' WHEN 2 THEN 'https://l.example/' || p_type || '#s'
      WHEN 3 THEN 'https://c.example/../' || p_type WHEN 4 THEN 'https://d.example/' || p_type || '/..' ELSE 'https://l.example/x/y/' END AS url FROM part""",
    "canonical_forms": """SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN 'https://a.example/' || p_type || '?a=1&b=' WHEN 3 THEN 'https://a.example:0/' || p_type WHEN 4 THEN 'https://a.example'
      WHEN 5 THEN 'https://a.example:80/' || p_type WHEN 6 THEN p_type WHEN 7 THEN 'https://a.example/?y=' || p_type || '&z=1' ELSE 'https://a.example/' || p_type END AS url_canonical FROM part""",
    "framing_delta": f"""WITH s AS (SELECT doc_id, list_distinct({_SENTENCES.format('text')}) AS s FROM documents)
      SELECT a.doc_id, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS n_added, len(list_filter(b.s, lambda x: NOT list_contains(a.s, x))) AS n_removed,
      len(list_filter(a.s, lambda x: list_contains(b.s, x))) AS n_shared FROM s a JOIN s b ON a.doc_id = b.doc_id + 1""",
    "shared_core": f"""WITH d AS (SELECT doc_id % 50 AS cluster_id, 'Same start. ' || left(text, 300) || CASE WHEN doc_id % 50 < 25 THEN chr(10) || 'Same end!' ELSE '' END AS text FROM documents),
      n AS (SELECT cluster_id, count(*) AS members FROM d GROUP BY 1), e AS (SELECT cluster_id, unnest(list_distinct({_SENTENCES.format('text')})) AS s FROM d),
      c AS (SELECT cluster_id, s, count(*) AS n FROM e GROUP BY 1, 2) SELECT n.cluster_id, members, coalesce(string_agg(s, chr(10) ORDER BY s), '') AS shared_core_text
      FROM n LEFT JOIN c ON n.cluster_id = c.cluster_id AND c.n = members GROUP BY 1, 2""",
    "simhash_prints": f"{_SIMHASH} SELECT doc_id, simhash, {', '.join(f'(simhash >> {16 * i}) & 65535 AS band{i}' for i in range(4))} FROM prints",
    "near_dup_pairs": f"{_LINKS} SELECT a, b, distance FROM links",
    "near_dup_clusters": f"""{_LINKS}, edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reach(node, other) AS (SELECT DISTINCT simhash, simhash FROM prints UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
      least AS (SELECT r.node, min(p.doc_id) AS cluster_id FROM reach r JOIN prints p ON p.simhash = r.other GROUP BY 1)
      SELECT doc_id, cluster_id FROM prints JOIN least ON node = simhash""",
    "streamed_totals": "SELECT event_type AS outlet, strftime(CAST(ts + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS day, count(*) AS total_articles FROM events GROUP BY 1, 2",
}
