"""SQL that recomputes each registered query independently, for DuckDB.

The text is plain set-based SQL on the test tables. Only fixed values (bucket bounds, rule and
panel settings) are taken from the library; all logic is written again.
"""

from __future__ import annotations

from shelfmark.functions.text import SUMMARY_PROMPT
from shelfmark.operators import alerts, dashboards
from shelfmark.operators.metrics import METRICS

RATINGS = """
ratings AS (
  SELECT l_partkey, count(*)::INT AS n,
         ((10 * sum(2 + l_quantity::INT % 9) + count(*)) // (2 * count(*)))::DOUBLE / 10.0 AS mean
  FROM lineitem GROUP BY l_partkey
)"""
PRODUCTS = RATINGS + """,
products_v AS (
  SELECT 'P' || p_partkey AS parent_asin, p_name AS title, p_type AS main_category, p_brand AS store,
         CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price,
         '$' || p_retailprice::VARCHAR AS price_raw,
         r.mean AS average_rating, coalesce(r.n, 0)::INT AS rating_number
  FROM part LEFT JOIN ratings r ON l_partkey = p_partkey
)"""
ITEM = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   round(l_extendedprice * 100)::BIGINT)"""
REVIEWS = f"""
reviews_v AS (
  SELECT {ITEM} AS review_id, 'P' || l_partkey AS parent_asin, o_custkey AS user_id,
         1 + (l_quantity::INT % 9) / 2.0 AS rating,
         round(l_discount * 100)::INT AS helpful_vote,
         l_returnflag <> 'R' AS verified_purchase,
         CASE WHEN l_quantity <> 50 THEN l_shipdate::TIMESTAMP END AS reviewed_at,
         CASE WHEN 1 + (l_quantity::INT % 9) / 2.0 >= 3 THEN 'positive' ELSE 'negative' END AS sentiment_label,
         round(0.5 + l_tax * 5, 4) AS sentiment_score,
         d.text AS review_text
  FROM lineitem
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN documents d ON l_linenumber <> 7 AND d.doc_id = l_orderkey % (SELECT count(*) FROM documents)
)"""
CENTERS = """
long AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
),
means AS (SELECT label, i, avg(x) AS m FROM long GROUP BY ALL),
centers AS (SELECT label AS query_id, list(m ORDER BY i) AS vector FROM means GROUP BY label)"""

BITS_DIFFER = "list_sum(list_transform(list_zip({a}, {b}), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))"
COSINE = "list_cosine_distance({a}::DOUBLE[], {b}::DOUBLE[])"




def _encoded(name: str, rows: str, dim: int) -> str:
    """Common table expressions ending in ``name(id, embedding)``: the default encoder on ``rows`` (id, text)."""
    return f"""
{name}_text AS ({rows}),
{name}_words AS (
  SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {2 * dim} AS bucket
  FROM (SELECT id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {name}_text) WHERE w <> ''
),
{name}_sums AS (
  SELECT id, bucket % {dim} AS i, sum(CASE WHEN bucket < {dim} THEN 1 ELSE -1 END)::INT AS n FROM {name}_words GROUP BY ALL
),
{name}_full AS (
  SELECT t.id, list(coalesce(n, 0) ORDER BY g.i) AS v
  FROM {name}_text t CROSS JOIN range({dim}) g(i) LEFT JOIN {name}_sums s ON s.id = t.id AND s.i = g.i GROUP BY t.id
),
{name} AS (
  SELECT id, list_transform(v, lambda x: CASE WHEN long > 0 THEN x / long ELSE 0 END::FLOAT) AS embedding
  FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS long FROM {name}_full)
)"""


def _word_of_bits(v: str, word: int) -> str:
    """64 sign bits of a vector as a signed number."""
    places = f"list_transform(range(0, 63), lambda j: CASE WHEN {v}[{64 * word} + j + 1] > 0 THEN 2::HUGEINT ** j ELSE 0 END::HUGEINT)"
    return f"(list_sum({places}) - CASE WHEN {v}[{64 * word} + 64] > 0 THEN 9223372036854775808::HUGEINT ELSE 0 END)::BIGINT"


def _search(corpus: str, k: int, columns: str, where: str = "TRUE") -> str:
    return f"""
WITH {PRODUCTS},
asked AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
corpus AS ({corpus}),
first AS (
  SELECT parent_asin, embedding, q FROM corpus, asked
  ORDER BY {BITS_DIFFER.format(a='embedding', b='q')}, parent_asin LIMIT {k * 8}
),
best AS (
  SELECT parent_asin, {COSINE.format(a='embedding', b='q')} AS dist FROM first
  ORDER BY dist, parent_asin LIMIT {k}
)
SELECT {columns}, round(dist, 6) AS _distance
FROM best JOIN products_v USING (parent_asin) WHERE {where}"""


ALL_VECTORS = "SELECT 'P' || vec_id AS parent_asin, embedding FROM embeddings"
DEFAULTS = "parent_asin, title, store, average_rating, price, main_category"


def _batch(k: int, oversample: int, where: str = "TRUE") -> str:
    return f"""
first AS (
  SELECT query_id, 'P' || vec_id AS parent_asin, vector, embedding FROM embeddings, centers WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY query_id
    ORDER BY {BITS_DIFFER.format(a='embedding', b='vector')}, 'P' || vec_id) <= {k * oversample}
),
found AS (
  SELECT query_id, parent_asin, {COSINE.format(a='embedding', b='vector')} AS dist,
         row_number() OVER (PARTITION BY query_id
           ORDER BY {COSINE.format(a='embedding', b='vector')}, parent_asin)::INT AS place
  FROM first QUALIFY place <= {k}
)"""


NEAREST_LIST = f"""
assigned AS (
  SELECT 'P' || vec_id AS parent_asin, label AS category, embedding, query_id AS list_id
  FROM embeddings, centers
  QUALIFY row_number() OVER (PARTITION BY vec_id
    ORDER BY {COSINE.format(a='embedding', b='vector')}, query_id) = 1
)"""

_HIT_CONTEXT = f"""
hits AS (
  SELECT parent_asin FROM (
    SELECT parent_asin, {COSINE.format(a='embedding', b='q')} AS dist FROM (
      SELECT 'P' || vec_id AS parent_asin, embedding, q
      FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)
      ORDER BY {BITS_DIFFER.format(a='embedding', b='q')}, 'P' || vec_id LIMIT 40)
    ORDER BY dist, parent_asin LIMIT 5)
  WHERE parent_asin IN (SELECT 'P' || p_partkey FROM part)
),
chosen AS (
  SELECT review_id, parent_asin, helpful_vote, review_text FROM reviews_v
  WHERE parent_asin IN (SELECT parent_asin FROM hits) AND review_text IS NOT NULL
  ORDER BY helpful_vote DESC, review_id LIMIT 15
)"""

# The prompt template around the reviews, as SQL text.
_HEAD, _TAIL = ("'" + part.replace("'", "''") + "'" for part in SUMMARY_PROMPT.split("{reviews}"))

_SPACES = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _clean(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " ")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    return f"trim(regexp_replace({out}, '{_SPACES}', ' ', 'g'))"


_RAW_PRICE = """
CASE l_linenumber
  WHEN 1 THEN '$' || floor(l_extendedprice::DECIMAL(12,2) / 1000)::INT || ',' ||
              lpad((l_extendedprice::DECIMAL(12,2) % 1000)::DECIMAL(12,2)::VARCHAR, 6, '0')
  WHEN 2 THEN 'from $' || l_extendedprice::DECIMAL(12,2)
  WHEN 3 THEN '$' || l_extendedprice::DECIMAL(12,2) || ' - $99999'
  WHEN 4 THEN 'free' WHEN 5 THEN '' WHEN 6 THEN 'None'
  ELSE '-' || l_extendedprice::DECIMAL(12,2) END"""
_TIME = """
CASE WHEN l_linenumber <= 3 OR l_linenumber = 5 THEN date_trunc('{unit}', l_shipdate::TIMESTAMP)
     WHEN l_linenumber = 4 THEN l_shipdate::TIMESTAMP - INTERVAL 2 HOUR END"""
_TIMES = f"""
  CASE WHEN l_linenumber <= 2 THEN epoch_ms(l_shipdate::TIMESTAMP) END AS timestamp_raw,
  CASE WHEN l_linenumber <= 3 THEN l_shipdate::TIMESTAMP
       WHEN l_linenumber = 4 THEN l_shipdate::TIMESTAMP - INTERVAL 2 HOUR
       WHEN l_linenumber = 5 THEN date_trunc('day', l_shipdate::TIMESTAMP) END AS reviewed_at"""

_BATCH_ROWS = f"""
fresh AS (
  SELECT 'P' || (l_partkey + l_suppkey) AS parent_asin, 't' || l_suppkey AS title,
         's' || l_linenumber AS store, l_returnflag AS main_category, l_extendedprice AS price,
         row_number() OVER (PARTITION BY l_partkey + l_suppkey ORDER BY l_orderkey, l_linenumber, {ITEM}) AS up,
         row_number() OVER (PARTITION BY l_partkey + l_suppkey
           ORDER BY l_orderkey DESC, l_linenumber DESC, {ITEM} DESC) AS down
  FROM lineitem
),
old AS (
  SELECT 'P' || p_partkey AS parent_asin, p_name AS title, p_brand AS store, p_type AS main_category,
         CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price FROM part
)"""
_UPSERT = f"""
WITH {_BATCH_ROWS},
f AS (SELECT * FROM fresh WHERE up = 1), l AS (SELECT * FROM fresh WHERE down = 1)
SELECT o.parent_asin, coalesce(l.title, o.title) AS title, o.store, o.main_category,
       CASE WHEN l.parent_asin IS NULL THEN o.price ELSE l.price END AS price
FROM old o LEFT JOIN l USING (parent_asin)
UNION ALL
SELECT f.parent_asin, l.title, f.store, f.main_category, l.price
FROM f JOIN l USING (parent_asin) WHERE f.parent_asin NOT IN (SELECT parent_asin FROM old)"""

# --- telemetry -----------------------------------------------------------------------------

_EVENTS = """
ev AS (
  SELECT event_id, ts::TIMESTAMP AS ts, event_type AS kind, value AS v, (props->>'k')::INT AS k,
         CASE WHEN (props->>'k')::INT < 50 THEN 'model-a' ELSE 'model-b' END AS model,
         CASE WHEN (props->>'k')::INT < 50 THEN '5' ELSE '10' END AS top_k,
         CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS code
  FROM events
)"""


def _seen(metric: str, labels: str, value: str, where: str = "TRUE") -> str:
    pairs = "MAP {" + labels + "}" if labels else "MAP([]::VARCHAR[], []::VARCHAR[])"
    return f"SELECT ts, '{metric}' AS metric, {pairs} AS labels, ({value})::DOUBLE AS value FROM ev WHERE {where}"


_HTTP = "'method': 'GET', 'endpoint': '/' || kind, 'status_code': code"
_MADE = "kind IN ('purchase', 'signup')"
OBSERVATIONS = _EVENTS + ",\nobs AS (\n" + "\nUNION ALL ".join(
    [
        _seen(
            "search_execution_seconds",
            "'has_vector': CASE WHEN kind = 'click' THEN 'False' ELSE 'True' END,"
            " 'category_filter': CASE WHEN k < 50 THEN 'False' ELSE 'True' END",
            "v / 25",
        ),
        _seen("search_requests_total", "'search_type': kind", "1"),
        _seen("hnsw_stage1_scan_seconds", "'top_k': top_k", "v / 200"),
        _seen("hnsw_stage2_rerank_seconds", "'top_k': top_k", "v / 100"),
        _seen(
            "db_query_seconds",
            "'query_type': CASE WHEN k < 50 THEN 'vector_search' ELSE 'reviews' END",
            "v / 50",
        ),
        _seen("http_requests_total", _HTTP, "1"),
        _seen("http_request_duration_seconds", _HTTP, "v / 100"),
        _seen("llm_generation_seconds", "'model_name': model", "v / 2", _MADE),
        _seen("llm_time_to_first_token_seconds", "'model_name': model", "v / 15", _MADE),
        _seen("llm_tokens_total", "'model_name': model, 'token_type': 'input'", "k * 1000", _MADE),
        _seen("llm_tokens_total", "'model_name': model, 'token_type': 'output'", "k * 10", _MADE),
        _seen("llm_faithfulness_score", "'model_name': model", "k / 100.0", _MADE),
        _seen("llm_answer_relevance_score", "'model_name': model", "(100 - k) / 100.0", _MADE),
        _seen("llm_errors_total", "'model_name': model, 'error_type': 'Timeout'", "1", "kind = 'error'"),
        _seen("search_errors_total", "'search_type': kind, 'error_type': 'Timeout'", "1", "kind = 'error'"),
        _seen("hnsw_recall_rate", "'k': top_k", "(100 - k / 2.0) / 100.0", "kind = 'signup'"),
        _seen("embedding_drift_score", "'category': top_k", "k / 400.0", "kind = 'purchase'"),
        _seen("pg_buffer_hit_ratio", "", "(100 - k / 5.0) / 100.0", "kind = 'view'"),
    ]
) + ")"


def _quoted(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _spec_rows(all_series) -> str:
    rows = []
    for s in all_series:
        by = "[" + ", ".join(f"'{b}'" for b in s.by) + "]::VARCHAR[]"
        (label, pattern), = list(s.where.items()) or [(None, None)]
        rows.append(
            "(" + ", ".join(
                [
                    _quoted(s.name), _quoted(s.kind), _quoted(s.metric), _quoted(s.total_metric or s.metric),
                    by, _quoted(label), _quoted(pattern), str(s.lookback), str(s.interval),
                    f"{s.quantile}::DOUBLE" if s.quantile else "NULL::DOUBLE",
                    f"{s.scale}::DOUBLE", f"{s.epsilon}::DOUBLE",
                ]
            ) + ")"
        )
    return ",\n".join(rows)


def _bounds_rows() -> str:
    return ",\n".join(
        f"('{m}', {i}, {b}::DOUBLE)" for m, d in METRICS.items() for i, b in enumerate(d.bounds)
    )


_COUNTERS = ", ".join(f"'{m}'" for m, d in METRICS.items() if d.kind == "counter")


def _series_values(all_series) -> str:
    """Common table expressions ending in ``points(series, labels, tick, value)``.

    Every observation is laid on each tick whose lookback covers it; values are computed from
    the rows of a tick, bucket by bucket.
    """
    return f"""
{OBSERVATIONS},
spec(series, kind, metric, total_metric, keys, label, pattern, lookback, step, q, scale, eps) AS (VALUES
{_spec_rows(all_series)}
),
bounds(metric, place, le) AS (VALUES {_bounds_rows()}),
fed AS (
  SELECT series, kind, lookback, step, q, scale, eps, s.metric AS metric, ts, value,
         array_to_string(list_transform(keys, lambda b: b || '=' || coalesce(labels[b], '')), ',') AS labels,
         o.metric = s.metric AND (label IS NULL OR coalesce(regexp_full_match(labels[label], pattern), FALSE)) AS is_part,
         s.kind IN ('ratio', 'complement') AND o.metric = s.total_metric AS is_whole,
         CASE WHEN o.metric IN ({_COUNTERS}) THEN value ELSE 1.0 END AS amount,
         (floor(epoch(ts) / step) * step + step)::BIGINT AS slot
  FROM obs o JOIN spec s ON o.metric = s.metric OR (s.kind IN ('ratio', 'complement') AND o.metric = s.total_metric)
),
used AS (SELECT * FROM fed WHERE is_part OR is_whole),
laid AS (
  SELECT *, unnest(range(slot, slot + lookback, step)) AS tick FROM used WHERE kind NOT IN ('gauge', 'silence')
),
plain AS (
  SELECT series, labels, tick, any_value(kind) AS kind, any_value(scale) AS scale, any_value(eps) AS eps,
         any_value(lookback) AS lookback, coalesce(sum(amount) FILTER (is_part), 0) AS part,
         coalesce(sum(amount) FILTER (is_whole), 0) AS whole
  FROM laid WHERE kind <> 'quantile' GROUP BY ALL
),
per_bucket AS (
  SELECT series, labels, tick, place, b.le, any_value(q) AS q, count(*) AS total,
         count(*) FILTER (value <= b.le) AS cum
  FROM laid JOIN bounds b USING (metric) WHERE kind = 'quantile' GROUP BY series, labels, tick, place, b.le
),
stepped AS (
  SELECT *, lag(le) OVER w AS low, coalesce(lag(cum) OVER w, 0) AS below,
         max(le) OVER (PARTITION BY series, labels, tick) AS top
  FROM per_bucket WINDOW w AS (PARTITION BY series, labels, tick ORDER BY place)
),
reached AS (
  SELECT series, labels, tick, any_value(top) AS top,
         arg_min(CASE WHEN place = 0 AND le <= 0 THEN le
                      WHEN cum = below THEN coalesce(low, 0)
                      ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (q * total - below) / (cum - below) END,
                 place) FILTER (cum >= q * total) AS inside
  FROM stepped GROUP BY series, labels, tick
),
gauged AS (
  SELECT series, labels, slot AS tick, arg_max(value, (ts, value)) AS value
  FROM used WHERE kind = 'gauge' GROUP BY series, labels, slot
),
points AS (
  SELECT series, labels, tick, coalesce(inside, top) AS value FROM reached
  UNION ALL
  SELECT series, labels, tick,
         CASE kind WHEN 'rate' THEN part / lookback * scale
                   WHEN 'ratio' THEN (part / lookback) / nullif(whole / lookback + eps, 0)
                   ELSE 1 - (part / lookback) / nullif(whole / lookback + eps, 0) END AS value
  FROM plain
)"""


def _rule_rows(rules) -> str:
    return ",\n".join(
        f"('{r.name}', '{r.series.name}', '{r.compare}', {r.threshold}::DOUBLE, {r.hold}, '{r.severity}',"
        f" '{r.team}', '{r.channel}', {r.series.interval}, {r.series.lookback}, '{r.series.kind}')"
        for r in rules
    )


def _fired(rules) -> str:
    """Common table expressions ending in ``fired(rule, labels, started, fired, ended, value)``."""
    all_series = list({r.series.name: r.series for r in rules}.values())
    return f"""
{_series_values(all_series)},
rules(rule, series, compare, threshold, hold, severity, team, channel, step, lookback, kind) AS (VALUES
{_rule_rows(rules)}
),
closing AS (SELECT floor(max(epoch(ts)))::BIGINT AS last FROM obs),
judged AS (
  SELECT r.*, p.labels, p.tick, p.tick AS until, p.value FROM points p JOIN rules r USING (series)
  UNION ALL
  SELECT r.*, g.labels, g.tick,
         greatest(g.tick, coalesce(lead(g.tick) OVER (PARTITION BY r.rule, g.labels ORDER BY g.tick) - r.step,
                                   last // r.step * r.step)) AS until, g.value
  FROM gauged g JOIN rules r USING (series), closing
),
flagged AS (
  SELECT *, CASE compare WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
                         ELSE value = threshold END AS yes
  FROM judged
),
islands AS (
  SELECT *, sum(starts) OVER (PARTITION BY rule, labels ORDER BY tick) AS island FROM (
    SELECT *, CASE WHEN lag(until) OVER (PARTITION BY rule, labels ORDER BY tick) = tick - step THEN 0 ELSE 1 END AS starts
    FROM flagged WHERE yes)
),
spans AS (
  SELECT rule, labels, island, min(tick) AS started, max(until) AS ended, any_value(step) AS step,
         min(tick) + ceil(any_value(hold) / any_value(step))::BIGINT * any_value(step) AS fired
  FROM islands GROUP BY rule, labels, island
),
busy AS (SELECT DISTINCT labels, slot, lead(slot) OVER (PARTITION BY labels ORDER BY slot) AS following
         FROM (SELECT DISTINCT labels, slot FROM used WHERE kind = 'silence')),
quiet AS (
  SELECT rule, labels, slot + lookback AS started, following - step AS ended,
         slot + lookback + ceil(hold / step)::BIGINT * step AS fired
  FROM busy, rules WHERE kind = 'silence' AND following - step >= slot + lookback
),
fired AS (
  SELECT s.rule, s.labels, s.started, s.fired, s.ended,
         (SELECT arg_max(i.value, i.tick) FROM islands i
          WHERE i.rule = s.rule AND i.labels = s.labels AND i.island = s.island AND i.tick <= s.fired) AS value
  FROM spans s WHERE s.fired <= s.ended
  UNION ALL
  SELECT rule, labels, started, fired, ended, 0.0 FROM quiet WHERE fired <= ended
)"""


# Times are compared as UTC instants without a zone.
_STAMP = "make_timestamp({c} * 1000000)"
_WATERMARK = "(SELECT max(ts)::TIMESTAMP - INTERVAL 10 MINUTE FROM events)"
# Ties of the fourth decimal go up in Spark's format, to the even binary number in DuckDB's.
_MESSAGE = (
    "format('{}{}: {:.4f} {} {:.4f}', r.rule, CASE labels WHEN '' THEN '' ELSE ' [' || labels || ']' END,"
    " round(value::DECIMAL(38,12), 4)::DOUBLE, compare, threshold::DOUBLE)"
)
_LE_LIST = "[" + ", ".join(str(b) for b in METRICS["search_execution_seconds"].bounds) + "]"
_RATE_WINDOWS = """
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type AS search_type,
       count(*)::BIGINT AS events, round(count(*) / 3600.0, 9) AS per_second
FROM (SELECT event_type, unnest(generate_series(
        time_bucket(INTERVAL 15 MINUTE, ts::TIMESTAMP) - INTERVAL 45 MINUTE,
        time_bucket(INTERVAL 15 MINUTE, ts::TIMESTAMP), INTERVAL 15 MINUTE)) AS w FROM events)
GROUP BY ALL"""
_STREAM_RULES = [r for r in alerts.RULES if (r.series.lookback, r.series.interval) == (300, 30)]


def all_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["semantic_search_top"] = _search(ALL_VECTORS, 5, DEFAULTS)
    q["semantic_search_postfilter"] = _search(
        ALL_VECTORS, 20, "parent_asin, title, price_raw, rating_number",
        "price <= 1500 AND average_rating >= 2.5 AND rating_number > 0",
    )
    q["semantic_search_prefilter"] = _search(
        ALL_VECTORS + " WHERE 'P' || vec_id IN (SELECT parent_asin FROM products_v"
        " WHERE price <= 1500 AND average_rating >= 2.5)", 10, DEFAULTS,
    )
    q["semantic_search_batch"] = f"""
WITH {CENTERS}, {_batch(5, 8)}
SELECT query_id, parent_asin, round(dist, 6) AS distance, place FROM found"""
    q["semantic_search_stored"] = _search(ALL_VECTORS, 20, DEFAULTS)
    passing = "price <= 1500 AND average_rating >= 2.5 AND rating_number > 0"
    q["semantic_search_batch_filtered"] = f"""
WITH {PRODUCTS}, {CENTERS},
{_batch(10, 8, f"'P' || vec_id IN (SELECT parent_asin FROM products_v WHERE {passing})")}
SELECT query_id, parent_asin, title, store, price, rating_number, round(dist, 6) AS distance, place
FROM found JOIN products_v USING (parent_asin) WHERE {passing}"""
    q["recall_at_k"] = f"""
WITH {CENTERS}, {_batch(10, 2)},
exact AS (
  SELECT query_id, 'P' || vec_id AS parent_asin FROM embeddings, centers
  QUALIFY row_number() OVER (PARTITION BY query_id
    ORDER BY {COSINE.format(a='embedding', b='vector')}, 'P' || vec_id) <= 10
)
SELECT e.query_id, round(avg((f.parent_asin IS NOT NULL)::INT), 6) AS recall
FROM exact e LEFT JOIN found f ON f.query_id = e.query_id AND f.parent_asin = e.parent_asin
GROUP BY e.query_id"""
    q["ivf_assign"] = f"WITH {CENTERS}, {NEAREST_LIST} SELECT parent_asin, category, list_id FROM assigned"
    q["ivf_search"] = f"""
WITH {CENTERS}, {NEAREST_LIST},
asked AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
probed AS (SELECT query_id FROM centers, asked ORDER BY {COSINE.format(a='vector', b='q')}, query_id LIMIT 3)
SELECT parent_asin, round({COSINE.format(a='embedding', b='q')}, 6) AS distance, list_id
FROM assigned, asked WHERE list_id IN (SELECT query_id FROM probed)
ORDER BY {COSINE.format(a='embedding', b='q')}, parent_asin LIMIT 10"""
    q["ivf_search_batch"] = f"""
WITH {CENTERS}, {NEAREST_LIST},
asked AS (SELECT 'P' || vec_id AS asker, embedding AS q FROM embeddings WHERE label = 5),
probed AS (
  SELECT asker, q, query_id AS list_id FROM centers, asked
  QUALIFY row_number() OVER (PARTITION BY asker ORDER BY {COSINE.format(a='vector', b='q')}, query_id) <= 3
)
SELECT asker AS query_id, parent_asin, round({COSINE.format(a='embedding', b='q')}, 6) AS distance, list_id,
       row_number() OVER (PARTITION BY asker ORDER BY {COSINE.format(a='embedding', b='q')}, parent_asin)::INT AS place
FROM assigned JOIN probed USING (list_id) QUALIFY place <= 10"""
    q["ivf_kmeans_search"] = f"""
SELECT 'P' || vec_id AS parent_asin, round({COSINE.format(a='embedding', b='q')}, 6) AS distance
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)
ORDER BY {COSINE.format(a='embedding', b='q')}, 'P' || vec_id LIMIT 10"""
    q["embed_text"] = f"""
WITH {_encoded("made", "SELECT 'P' || p_partkey AS id, p_name || ' ' || p_type || ' size ' || p_size AS text FROM part", 128)}
SELECT id AS parent_asin, list_transform(embedding, lambda x: round(x::DOUBLE, 6)::FLOAT) AS embedding,
       [{_word_of_bits('embedding', 0)}, {_word_of_bits('embedding', 1)}] AS bits,
       'hashing-bag-of-words' AS model_name, 'run-1' AS run_id
FROM made"""
    q["sentiment_facts"] = """
SELECT doc_id, CASE WHEN text IS NOT NULL THEN TRUE END AS known_label,
       CASE WHEN text IS NOT NULL THEN TRUE END AS sound_score, TRUE AS tells_apart FROM documents"""
    q["text_search"] = f"""
WITH {_encoded("docs", "SELECT doc_id::VARCHAR AS id, text FROM documents", 256)},
{_encoded("asks", "SELECT item_id AS id, text FROM benchmark", 256)},
first AS (
  SELECT a.id AS query_id, d.id AS parent_asin, {COSINE.format(a='d.embedding', b='a.embedding')} AS dist
  FROM docs d, asks a
  QUALIFY row_number() OVER (PARTITION BY a.id
    ORDER BY {BITS_DIFFER.format(a='d.embedding', b='a.embedding')}, d.id) <= 24
)
SELECT query_id, parent_asin, round(dist, 6) AS _distance,
       row_number() OVER (PARTITION BY query_id ORDER BY dist, parent_asin)::INT AS _rank
FROM first QUALIFY _rank <= 3"""
    q["embedding_drift"] = """
WITH long AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
),
binned AS (SELECT label, i, least(greatest(floor((x + 1) / 2 * 20)::INT, 0), 19) AS bin FROM long),
cats AS (SELECT DISTINCT label FROM embeddings),
grid AS (SELECT label, i, bin FROM cats, (SELECT DISTINCT i FROM binned), range(20) r(bin)),
p AS (SELECT label, i, bin, count(*) / sum(count(*)) OVER (PARTITION BY label, i) AS p FROM binned GROUP BY label, i, bin),
q AS (SELECT i, bin, count(*) / sum(count(*)) OVER (PARTITION BY i) AS q FROM binned GROUP BY i, bin),
both_ AS (
  SELECT g.label, g.i, coalesce(p, 0) AS p, coalesce(q, 0) AS q
  FROM grid g LEFT JOIN p USING (label, i, bin) LEFT JOIN q ON q.i = g.i AND q.bin = g.bin
),
js AS (
  SELECT label, i, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
                 + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS d
  FROM both_ GROUP BY label, i
)
SELECT label AS category, round(avg(d), 6) AS js_divergence FROM js GROUP BY label"""
    q["vector_stats"] = """
WITH long AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
),
w AS (
  SELECT vec_id, count(*) FILTER (x > 0) AS set_bits, round(sum(x * x), 5) AS self_dot,
         sum(CASE WHEN x > 0 THEN CASE WHEN i = 64 THEN -(2::HUGEINT ** 63)::HUGEINT
                                       ELSE (1::HUGEINT << (i - 1)::INT) END ELSE 0 END) AS word
  FROM long GROUP BY vec_id
)
SELECT vec_id, set_bits::BIGINT AS set_bits, word::BIGINT AS word, 1.0::DOUBLE AS unit_norm, self_dot FROM w"""
    q["half_precision"] = """
WITH long AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
),
h AS (
  SELECT vec_id, i, CASE WHEN x = 0 THEN 0.0 ELSE
    round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0)
      * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END AS h
  FROM long
)
SELECT vec_id, round(sum(h ORDER BY i), 6) AS half_sum, max(h) FILTER (i = 4) AS fourth FROM h GROUP BY vec_id"""
    q["vector_text_roundtrip"] = """
SELECT vec_id,
       '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS text,
       len(embedding)::BIGINT AS dims, round(printf('%.6f', embedding[6]::DOUBLE)::FLOAT::DOUBLE, 6) AS sixth
FROM embeddings"""

    q["keyword_search"] = f"""
WITH {PRODUCTS}
SELECT {DEFAULTS} FROM products_v
WHERE list_has_all(string_split_regex(lower(title), '[^a-z0-9]+'), ['blue', 'bolt'])
ORDER BY average_rating DESC NULLS LAST, parent_asin LIMIT 50"""
    q["keyword_search_stemmed"] = f"""
WITH {PRODUCTS}
SELECT {DEFAULTS} FROM products_v
WHERE regexp_matches(lower(title), '(^|[^a-z0-9])plates?($|[^a-z0-9])')
  AND price <= 1800 AND average_rating >= 2.0
ORDER BY average_rating DESC NULLS LAST, parent_asin LIMIT 50"""
    plain = "list_transform(string_split_regex(lower(p_name) || 's', '[^a-z0-9]+'), lambda x: regexp_replace(x, 's$', ''))"
    titled = f"""
titled AS (
  SELECT v.* REPLACE (title || 's' AS title), {plain} AS words
  FROM products_v v JOIN part ON 'P' || p_partkey = parent_asin
)"""
    q["keyword_search_stored"] = f"""
WITH {PRODUCTS}, {titled}
SELECT {DEFAULTS}, 'two' AS asked FROM (
  SELECT * FROM titled WHERE list_has_all(words, ['cold', 'plate'])
  ORDER BY average_rating DESC NULLS LAST, parent_asin LIMIT 100)
UNION ALL
SELECT {DEFAULTS}, 'one' FROM (
  SELECT * FROM titled WHERE list_has_all(words, ['anvil']) AND price <= 1500
  ORDER BY average_rating DESC NULLS LAST, parent_asin LIMIT 100)"""
    q["list_products"] = f"""
WITH {PRODUCTS}
SELECT parent_asin, title, store, main_category, average_rating, price, rating_number FROM products_v
WHERE main_category ILIKE '%sma%' AND store ILIKE '%brand#1%' AND price >= 905 AND price <= 2500
  AND average_rating >= 1.5
ORDER BY average_rating DESC NULLS LAST, parent_asin LIMIT 50 OFFSET 5"""
    order = "helpful_vote DESC NULLS FIRST, reviewed_at DESC NULLS FIRST, review_id"
    flat = """rating, helpful_vote, verified_purchase, reviewed_at::VARCHAR AS reviewed_at, sentiment_label"""
    q["product_detail"] = f"""
WITH {REVIEWS},
top AS (
  SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place FROM reviews_v
  WHERE parent_asin = 'P7' QUALIFY place < 5
)
SELECT 'P7' AS parent_asin, (SELECT p_name FROM part WHERE p_partkey = 7) AS title, place, review_id, {flat},
       (sum(coalesce(length(review_text), 0)) OVER ())::BIGINT AS text_chars
FROM top"""
    q["products_with_reviews"] = f"""
WITH {REVIEWS},
top AS (
  SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY {order}) - 1 AS place FROM reviews_v
  QUALIFY place < 3
)
SELECT 'P' || p_partkey AS parent_asin, p_name AS title, place, review_id, {flat}
FROM part LEFT JOIN top ON top.parent_asin = 'P' || p_partkey"""
    q["list_reviews"] = f"""
WITH {REVIEWS}
SELECT review_id, user_id, rating, helpful_vote, verified_purchase, reviewed_at::VARCHAR AS reviewed_at,
       sentiment_label, sentiment_score
FROM reviews_v
WHERE parent_asin = 'P7' AND verified_purchase AND rating >= 2 AND sentiment_label = 'positive'
ORDER BY {order} LIMIT 50 OFFSET 1"""
    counts = """
  (SELECT count(*) FROM part) AS total_products, (SELECT count(*) FROM lineitem) AS total_reviews,
  (SELECT count(*) FROM embeddings) AS total_embeddings,
  (SELECT round(avg(average_rating::DECIMAL(20,8)), 2)::DOUBLE FROM products_v) AS avg_rating"""
    q["catalog_counts"] = f"WITH {PRODUCTS} SELECT {counts}"
    stars = """
  SELECT floor(rating)::BIGINT AS rating, count(*) AS review_count,
         round(avg(sentiment_score::DECIMAL(20,8)), 4)::DOUBLE AS avg_sentiment
  FROM reviews_v GROUP BY floor(rating)"""
    q["rating_distribution"] = f"WITH {REVIEWS} {stars}"
    q["price_summary"] = f"""
WITH {PRODUCTS}
SELECT min(price) AS min_price, max(price) AS max_price, round(avg(price::DECIMAL(20,8)), 2)::DOUBLE AS avg_price,
       round(quantile_cont(price, 0.5), 2) AS median_price FROM products_v"""
    q["metrics_summary"] = f"""
WITH {PRODUCTS}, {REVIEWS}
SELECT {counts}, (SELECT round(quantile_cont(price, 0.5), 2) FROM products_v) AS median_price, s.*
FROM ({stars}) s"""
    q["exact_price_quantiles"] = """
SELECT round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem"""
    q["review_navigation"] = """
SELECT 'P' || p_partkey AS parent_asin, e.label AS category, count(l_orderkey) AS reviews
FROM part LEFT JOIN embeddings e ON vec_id = p_partkey LEFT JOIN lineitem ON l_partkey = p_partkey
GROUP BY ALL"""

    q["review_context"] = f"WITH {REVIEWS}, {_HIT_CONTEXT} SELECT * FROM chosen"
    q["prompt_text"] = f"""
WITH {REVIEWS}, {_HIT_CONTEXT},
numbered AS (SELECT *, row_number() OVER (ORDER BY helpful_vote DESC, review_id) AS i FROM chosen)
SELECT {_HEAD} || (SELECT string_agg(i || '. ' || review_text, chr(10) ORDER BY i) FROM numbered WHERE i <= 10)
       || {_TAIL} AS prompt,
       (SELECT sum(length(review_text)) // 4 FROM numbered)::BIGINT AS input_tokens,
       (SELECT count(*) FROM numbered) AS n_texts"""
    q["review_context_batch"] = f"""
WITH {REVIEWS}, {CENTERS}, {_batch(5, 8)},
numbered AS (
  SELECT query_id, review_text, row_number() OVER (PARTITION BY query_id ORDER BY helpful_vote DESC, review_id) AS i
  FROM found JOIN reviews_v USING (parent_asin) WHERE review_text IS NOT NULL QUALIFY i <= 15
)
SELECT query_id, count(*) AS n_texts, (sum(length(review_text)) // 4)::BIGINT AS input_tokens,
       md5({_HEAD} || string_agg(i || '. ' || review_text, chr(10) ORDER BY i) FILTER (i <= 10) || {_TAIL}) AS prompt_md5
FROM numbered GROUP BY query_id"""
    q["token_usage"] = f"""
SELECT doc_id, (length(text) // 4)::BIGINT AS input_tokens,
       len(list_filter(string_split_regex(text, '{_SPACES}'), lambda x: x <> ''))::BIGINT AS output_tokens
FROM documents"""
    strip = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    q["summary_after_marker"] = f"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^{strip}+', ''), '{strip}+$', '')) AS summary_md5,
       md5(text) AS unmarked_md5 FROM documents"""

    q["clean_pages"] = f"SELECT page_id, {_clean('html')} AS text FROM pages"
    q["product_text"] = """
SELECT 'P' || p_partkey AS parent_asin,
       CASE WHEN p_type = 'PROMO' THEN 'P' || p_partkey
            WHEN p_type = 'LARGE' THEN left(p_name, 16)
            ELSE left(p_name || ' ' || p_type || ' size ' || p_size, 16) END AS text FROM part"""
    q["parse_price"] = f"""
SELECT {ITEM} AS item, {_RAW_PRICE} AS raw,
       CASE WHEN l_linenumber IN (4, 5, 6) THEN NULL ELSE l_extendedprice::DECIMAL(12,2)::DOUBLE END AS price
FROM lineitem"""
    q["parse_time"] = f"SELECT {ITEM} AS item, {_TIMES} FROM lineitem"

    q["ingest_products"] = """
SELECT p_partkey AS line_no, 'P' || p_partkey AS parent_asin, p_name || ' & more' AS title, p_brand AS store,
       (p_size / 10)::DECIMAL(3,1)::DOUBLE AS average_rating, '$' || p_size || '.50' AS price_raw,
       p_size + 0.5::DOUBLE AS price, p_type || '|<b>' AS features, 0::BIGINT AS n_categories
FROM part WHERE p_type <> 'PROMO'"""
    q["skipped_products"] = """
SELECT count(*) AS total, count(*) FILTER (p_type <> 'PROMO') AS kept,
       count(*) FILTER (p_type = 'PROMO') AS skipped FROM part"""
    q["jsonl_scan"] = """
SELECT (SELECT count(*) FROM part) AS good, count(*) AS bad, sum(length(text))::BIGINT AS bad_chars
FROM documents WHERE trim(text, ' ') <> ''"""
    q["ingest_reviews"] = f"""
SELECT {ITEM} AS item, 'P' || l_partkey AS parent_asin, 'U' || l_suppkey AS user_id, l_quantity % 7 AS rating,
       'good ' || l_returnflag || '"' AS review_text,
       CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END::INT AS helpful_vote,
       l_returnflag = 'R' AS verified_purchase, {_TIMES},
       l_quantity % 7 BETWEEN 1 AND 5 AS valid
FROM lineitem WHERE l_linenumber NOT IN (5, 6)"""
    q["valid_reviews"] = """
SELECT l_quantity % 7 AS rating, l_quantity % 7 BETWEEN 1 AND 5 AS valid, count(*) AS n FROM lineitem GROUP BY ALL"""
    q["load_semi_join"] = f"""
WITH {REVIEWS} SELECT review_id, parent_asin, rating FROM reviews_v
WHERE parent_asin IN (SELECT 'P' || vec_id FROM embeddings)"""
    q["upsert_products"] = _UPSERT
    q["table_versions"] = _UPSERT
    q["stream_upsert"] = _UPSERT
    q["upsert_embeddings"] = """
WITH bits AS (
  SELECT vec_id, label, embedding[1] AS x, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS set_bits FROM embeddings
)
SELECT 'P' || vec_id AS parent_asin, CASE WHEN seen THEN 'r2' ELSE 'r1' END AS run_id,
       round((x * CASE WHEN seen THEN 2 ELSE 1 END)::FLOAT::DOUBLE, 6) AS first_component, set_bits
FROM (SELECT *, vec_id IN (SELECT l_partkey FROM lineitem) AS seen FROM bits)
UNION ALL
SELECT 'NP' || vec_id, 'r2', round((x * 2)::FLOAT::DOUBLE, 6), set_bits FROM bits WHERE label = 3"""
    q["stream_append_reviews"] = f"""
SELECT 'P' || l_partkey AS parent_asin, 'U' || l_suppkey AS user_id, l_quantity % 7 AS rating,
       'good ' || l_returnflag || '"' AS review_text,
       CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END::INT AS helpful_vote,
       l_returnflag = 'R' AS verified_purchase, {_TIMES}, count(*) AS n
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_linenumber NOT IN (4, 5, 6) AND l_quantity % 7 BETWEEN 1 AND 5 AND p_type <> 'PROMO' GROUP BY ALL"""
    q["stream_review_counts"] = """
SELECT '000000000' AS batch, count(*) FILTER (l_linenumber = 4) AS unreadable,
       count(*) FILTER (l_linenumber IN (5, 6)) AS skipped,
       count(*) FILTER (read AND NOT valid) AS set_aside,
       count(*) FILTER (read AND valid AND p_type = 'PROMO') AS unknown,
       count(*) FILTER (read AND valid AND p_type <> 'PROMO') AS loaded, TRUE AS distinct_ids
FROM (SELECT *, l_linenumber NOT IN (4, 5, 6) AS read, l_quantity % 7 BETWEEN 1 AND 5 AS valid
      FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
    q["ingest_pipeline"] = """
WITH p AS (SELECT *, 'P' || p_partkey AS parent_asin FROM part WHERE p_type <> 'PROMO'),
r AS (
  SELECT 'P' || l_partkey AS parent_asin, l_quantity % 7 BETWEEN 1 AND 5 AS valid, l_quantity % 7 AS rating,
         CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END AS votes
  FROM lineitem WHERE l_linenumber NOT IN (5, 6) AND l_partkey IN (SELECT p_partkey FROM p)
),
words AS (
  SELECT *, list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower(p_name) || ' more', '[^a-z0-9]+'),
    lambda x: x <> ''), lambda x: CASE x WHEN 'large' THEN 'larg' ELSE x END))) AS terms FROM p
)
SELECT 'product' AS kind, parent_asin AS key, concat_ws('|', p_name || ' & more', p_brand, '$' || p_size || '.50',
       p_size || '.50', array_to_string(terms, ' ')) AS value FROM words
UNION ALL SELECT 'embedding', parent_asin, '64|1|run-1' FROM p
UNION ALL SELECT 'reviews', parent_asin, concat_ws('|', count(*), count(*), sum(votes)::BIGINT, count(*),
       sum(round(rating / 7, 4)::DECIMAL(6,4))) FROM r WHERE valid GROUP BY parent_asin
UNION ALL SELECT 'run', 'run-1', (SELECT count(*) FROM p) || '|64'
UNION ALL SELECT 'counts', 'w1', concat_ws('|', (SELECT count(*) FROM p), (SELECT count(*) FROM p),
       (SELECT count(*) FROM r WHERE valid), (SELECT count(*) FROM r WHERE NOT valid), 0,
       (SELECT count(*) FROM part WHERE p_type = 'PROMO'), 0,
       (SELECT count(*) FROM lineitem WHERE l_linenumber IN (5, 6)))"""
    q["insert_if_absent"] = f"""
WITH {_BATCH_ROWS}
SELECT * FROM old UNION ALL
SELECT parent_asin, title, store, main_category, price FROM fresh
WHERE up = 1 AND parent_asin NOT IN (SELECT parent_asin FROM old)"""
    q["cascade_delete"] = """
SELECT 'P' || p_partkey AS parent_asin, CASE WHEN count(l_orderkey) > 0 THEN count(l_orderkey) END AS reviews
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_type <> 'PROMO' GROUP BY p_partkey"""
    q["missing_products"] = """
SELECT 'P' || p_partkey AS parent_asin FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)"""
    q["surrogate_keys"] = "SELECT count(*) AS n, 0::BIGINT AS repeats, 0::BIGINT AS clashes FROM lineitem"

    q["rolling_latency"] = """
WITH w AS (
  SELECT event_id, event_type AS search_type,
         list_sort(list(round(value * 100)::BIGINT) OVER f) AS s, avg(round(value * 100)::BIGINT) OVER f AS mean
  FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)
)
SELECT search_type, event_id, s[len(s) // 2 + 1] AS p50,
       s[least(floor(len(s) * 0.95::DOUBLE)::INT, len(s) - 1) + 1] AS p95, mean, len(s)::INT AS samples
FROM w"""
    q["latency_summary"] = """
WITH newest AS (
  SELECT event_type, round(value * 100)::BIGINT AS v FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200
), s AS (SELECT event_type, list_sort(list(v)) AS s, avg(v) AS mean FROM newest GROUP BY event_type)
SELECT event_type AS search_type, s[len(s) // 2 + 1] AS p50,
       s[least(floor(len(s) * 0.95::DOUBLE)::INT, len(s) - 1) + 1] AS p95, mean, len(s)::INT AS samples
FROM s"""
    buckets = f"""
SELECT search_type, le, count(*) FILTER (v <= le) AS bucket_count, count(*) AS total, round(sum(v), 4) AS sum
FROM (SELECT event_type AS search_type, value / 100 AS v, unnest({_LE_LIST})::DOUBLE AS le FROM events)
GROUP BY search_type, le"""
    q["latency_histogram"] = buckets
    quantiles = ", ".join(
        f"""round(coalesce(min_by(CASE WHEN cum = below THEN low ELSE low + (le - low) * ({p}::DOUBLE * total - below) / (cum - below) END, le)
             FILTER (cum >= {p}::DOUBLE * total), max(le)), 9) AS p{n}"""
        for n, p in ((10, 0.10), (50, 0.50), (95, 0.95), (99, 0.99))
    )
    q["histogram_quantiles"] = f"""
WITH b AS ({buckets}), s AS (
  SELECT search_type, le, bucket_count AS cum, total, coalesce(lag(le) OVER w, 0) AS low,
         coalesce(lag(bucket_count) OVER w, 0) AS below
  FROM b WINDOW w AS (PARTITION BY search_type ORDER BY le)
)
SELECT search_type, {quantiles} FROM s GROUP BY search_type"""
    q["request_rate"] = _RATE_WINDOWS
    q["stream_request_rate"] = f"""
SELECT * FROM ({_RATE_WINDOWS}) WHERE window_end <= {_WATERMARK}"""
    q["stream_histogram"] = f"""
SELECT window_start, event_type, le, count(*) FILTER (v <= le) AS bucket_count, count(*) AS total,
       round(sum(v), 4) AS sum
FROM (SELECT date_trunc('day', ts::TIMESTAMP)::TIMESTAMP AS window_start, event_type, value / 100 AS v,
             unnest({_LE_LIST})::DOUBLE AS le FROM events)
WHERE window_start + INTERVAL 1 DAY <= {_WATERMARK}
GROUP BY window_start, event_type, le"""
    hour = dashboards._tokens("input", "tokens_in_last_hour", 3600, 3600.0, ())
    point = f"SELECT series, labels, {_STAMP.format(c='tick')} AS tick, round(value, 9) AS value"
    q["tokens_last_hour"] = f"WITH {_series_values([hour])} {point} FROM points"
    # a gauge stands at every tick until its next setting, the last one until the newest observation
    carried = """,
steps AS (SELECT DISTINCT series, step FROM spec),
standing AS (
  SELECT g.*, step, coalesce(lead(tick) OVER (PARTITION BY g.series, labels ORDER BY tick) - step,
    (SELECT floor(max(epoch(ts)))::BIGINT FROM obs) // step * step) AS until
  FROM gauged g JOIN steps USING (series)
),
carried AS (
  SELECT series, labels, value, unnest(range(tick, greatest(tick, until) + step, step)) AS tick FROM standing
)"""
    q["dashboard_panels"] = f"""
WITH {_series_values(dashboards.PANELS)} {carried} {point} FROM (
  SELECT * FROM points UNION ALL SELECT series, labels, tick, value FROM carried)"""
    q["error_share"] = """
SELECT date_trunc('hour', ts::TIMESTAMP)::TIMESTAMP AS hour,
       round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_share,
       round(1 - count(*) FILTER (event_type = 'error') / count(*), 6) AS success_share
FROM events GROUP BY 1"""
    q["counter_increase"] = """
WITH s AS (
  SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP) AS slot, (props->>'k')::DOUBLE AS k,
         lag((props->>'k')::DOUBLE) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p
  FROM events
)
SELECT event_type AS search_type, slot AS slot_start,
       sum(CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END) AS increase
FROM s GROUP BY event_type, slot"""
    q["alerts_fired"] = f"""
WITH {_fired(alerts.RULES)}
SELECT f.rule, f.labels, {_STAMP.format(c='started')} AS started_at, {_STAMP.format(c='fired')} AS fired_at,
       {_STAMP.format(c='ended')} AS ended_at, round(value, 9) AS value, severity, team, channel, {_MESSAGE} AS message
FROM fired f JOIN rules r ON r.rule = f.rule"""
    q["no_traffic"] = """
WITH s AS (SELECT DISTINCT (floor(epoch(ts) / 15) * 15 + 15)::BIGINT AS slot FROM events),
until AS (SELECT floor((floor(max(epoch(ts))) + 7200) / 15)::BIGINT * 15 + 15 AS tick FROM events),
spine AS (SELECT unnest(range((SELECT min(slot) FROM s), (SELECT tick FROM until) + 15, 15)) AS tick),
loud AS (SELECT DISTINCT unnest(range(slot, slot + 300, 15)) AS tick FROM s),
silent AS (SELECT tick FROM spine WHERE tick NOT IN (SELECT tick FROM loud)),
g AS (SELECT tick, tick - 15 * row_number() OVER (ORDER BY tick) AS run FROM silent)
SELECT min(tick)::BIGINT AS started, max(tick)::BIGINT AS ended FROM g GROUP BY run"""
    q["cumulative_tokens"] = f"""
WITH {OBSERVATIONS}
SELECT labels['token_type'] AS token_type, labels['model_name'] AS model_name, sum(value) AS total
FROM obs WHERE metric = 'llm_tokens_total' GROUP BY ALL"""
    q["gauge_bands"] = f"""
WITH {OBSERVATIONS}, g AS (
  SELECT 'k=' || labels['k'] AS labels, arg_max(value, ts) AS value, 'recall' AS gauge FROM obs
  WHERE metric = 'hnsw_recall_rate' GROUP BY ALL
  UNION ALL
  SELECT 'category=' || labels['category'], arg_max(value, ts), 'drift' FROM obs
  WHERE metric = 'embedding_drift_score' GROUP BY ALL
)
SELECT labels, round(value, 6) AS value, gauge,
       CASE WHEN gauge = 'recall' THEN CASE WHEN value >= 0.9 THEN 'green' WHEN value >= 0.8 THEN 'yellow' ELSE 'red' END
            ELSE CASE WHEN value >= 0.2 THEN 'red' WHEN value >= 0.1 THEN 'yellow' ELSE 'green' END END AS colour
FROM g"""
    q["search_runs"] = """
SELECT event_id::VARCHAR AS run_id, length(event_type)::VARCHAR AS query_chars,
       round(value * 10 * 0.1 + value * 10 * 0.25 + value * 10 * 0.5
             + CASE WHEN (props->>'k')::INT > 50 THEN value * 10 ELSE 0 END, 4) AS total_ms,
       ((props->>'k')::INT % 6)::DOUBLE AS results, 4::BIGINT AS n_params
FROM events"""
    q["embedding_run_metrics"] = """
SELECT event_type AS run_id, sum((props->>'k')::INT)::BIGINT AS total_embed,
       round(sum(value / 100) * 1000, 1) AS total_embeddings_time_ms,
       round(sum(value / 100) / greatest(sum((props->>'k')::INT), 1) * 1000, 4) AS avg_embedding_time_ms,
       384 AS embedding_dim
FROM events GROUP BY event_type"""
    q["prompt_variants"] = """
SELECT role AS variant_name, count(*) AS runs, round(avg(length(text)), 6) AS input_tokens,
       round(avg(turn), 6) AS output_tokens, round(avg(CASE WHEN turn > 0 THEN turn / 10.0 END), 6) AS faithfulness,
       NULL::DOUBLE AS answer_relevance
FROM conversations GROUP BY role"""
    q["stream_alerts"] = f"""
WITH {_fired(_STREAM_RULES)}
SELECT rule, labels, started, fired, round(value, 9) AS value FROM fired
WHERE {_STAMP.format(c='fired')} <= {_WATERMARK}"""
    q["stream_alerts_all"] = f"""
WITH {_fired(alerts.RULES)},
changes AS (
  SELECT rule, labels, 'firing' AS status, started, fired, NULL::BIGINT AS ended, value FROM fired
  WHERE {_STAMP.format(c='fired')} <= {_WATERMARK}
  UNION ALL
  SELECT f.rule, labels, 'resolved', started, fired, ended, value FROM fired f JOIN rules r ON r.rule = f.rule
  WHERE {_STAMP.format(c='(ended + step)')} <= {_WATERMARK}
)
SELECT c.rule, c.labels, status, {_STAMP.format(c='started')} AS started_at, {_STAMP.format(c='fired')} AS fired_at,
       {_STAMP.format(c='ended')} AS ended_at, round(value, 9) AS value, severity, team, channel, {_MESSAGE} AS message
FROM changes c JOIN rules r ON r.rule = c.rule"""
    silence = [r for r in alerts.RULES if r.series.kind == "silence"]
    q["stream_no_traffic"] = (
        f"WITH {_fired(silence)} SELECT rule, started, fired FROM fired"
        f" WHERE {_STAMP.format(c='(fired + 15)')} <= {_WATERMARK}"
    )
    return q
