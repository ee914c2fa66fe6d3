"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from shelfmark.llm import centroids, license_scans, mixing, quality_rules as rules

_WORD = "[^\\x20\\x09-\\x0D]+"


def _op3() -> str:
    def codes(pattern: str) -> str:
        return pattern.replace("'", "''")

    closers = rules.CLOSERS.replace("]", "\\]")
    phrases = " OR ".join(f"contains(lower(line), '{x}')" for x in rules.BOILERPLATE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT row, doc_id, body, regexp_extract_all(body, '{_WORD}') AS words FROM d),
win AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS key
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
again AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, key) > 1),
cover AS (
  SELECT row, count(DISTINCT i + k) AS n
  FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row
),
l AS (
  SELECT row, line, len(regexp_extract_all(line, '{_WORD}')) AS n
  FROM (SELECT row, unnest(string_split(body, chr(10))) AS line FROM d)
),
judged AS (
  SELECT row, line, n,
    (n >= {rules.PARAGRAPH_WORDS} OR regexp_matches(line, '[{codes(rules.STOPS)}][{codes(closers)}]*[\\x20\\x09-\\x0D]*$'))
    AND len(regexp_extract_all(line, '{rules.SEPARATOR}')) * 4 < n
    AND len(regexp_extract_all(line, '{rules.MARKS}')) * 5 < n
    AND (n > {rules.BOILERPLATE_WORDS} OR NOT ({phrases})) AS ok
  FROM l WHERE n > 0
),
lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS dup, count(*) AS n_lines,
    count(*) FILTER (ok) AS n_kept, coalesce(sum(n) FILTER (ok), 0) AS words_kept
  FROM judged GROUP BY row
),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(body, '{rules.SYMBOLS}')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_kept, 0) AS n_lines_kept, coalesce(words_kept, 0) AS kept_words
  FROM w LEFT JOIN cover USING (row) LEFT JOIN lines USING (row)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
  n_lines_kept::BIGINT AS n_lines_kept, kept_words::BIGINT AS kept_words,
  n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words
    AS base_failed,
  NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words)
    AND kept_words * 100 >= n_words * {rules.MIN_KEPT_PERCENT} AS kept
FROM m"""


def _op4() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = " UNION ALL ".join(
        f"SELECT row, i, '{label}' AS label FROM places WHERE words[i + 1:i + {len(p.split())}] = {p.split()}"
        for p, label in license_scans.PHRASES
    )
    templates = ", ".join(
        f"({i}, '{label}', {len(s)}, {license_scans.needed(len(s), license_scans.THRESHOLD)}, "
        f"{sorted(w.decode() for w in s)})"
        for i, (label, s) in enumerate(license_scans._templates(license_scans.TEMPLATES))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {lower} AS low FROM documents),
w AS (SELECT row, doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
places AS (SELECT row, words, unnest(range(0, len(words))) AS i FROM w WHERE contains(low, 'license')),
base AS ({places}),
b AS (
  SELECT row, count(*) AS n, min(i) AS first, max(i) AS last, list_sort(list_distinct(list(label))) AS labels
  FROM base GROUP BY row
),
t AS (SELECT * FROM (VALUES {templates}) AS v(template, label, size, need, tokens)),
tokens AS (SELECT template, label, size, need, unnest(tokens) AS token FROM t),
blocks AS (
  SELECT row, block, unnest(list_distinct(regexp_extract_all(part, '{word}'))) AS token
  FROM (
    SELECT row, unnest(parts) AS part, unnest(range(0, len(parts))) AS block
    FROM (SELECT row, string_split_regex(low, '\\n|[.!?][ \\t\\r\\n\\x0b\\x0c]+') AS parts FROM d)
  )
),
hits AS (
  SELECT row, label, count(*) / size AS containment
  FROM blocks JOIN tokens USING (token) GROUP BY row, block, template, label, size, need HAVING count(*) >= need
),
h AS (
  SELECT row, list_distinct(list(label)) AS labels, max(containment) AS containment FROM hits GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first::BIGINT AS first_word,
  b.last::BIGINT AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(h.labels, []))), ','), '')
    AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(h.containment, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN h USING (row)"""


def _op5() -> str:
    steps, half = mixing.STEPS, mixing.STEPS // 2
    def measured(k: str) -> str:  # entropy and repetition of all sources at a step
        return f"""(SELECT struct_pack(
          h := ln(sum(p)) - sum(p * ln(p)) / sum(p), r := max(p / n_tokens) / min(p / n_tokens))
        FROM (SELECT n_tokens, pow(n_tokens / (SELECT t FROM told), {k} / {steps}.0) AS p FROM sizes))"""

    def before(epoch: str) -> str:  # tokens of the source's blocks before this one in an epoch
        return f"""coalesce(sum(n) OVER (PARTITION BY source
      ORDER BY md5('{mixing.SEED}:' || coalesce(source, '') || ':' || ({epoch})::BIGINT || ':' || block), block
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, greatest(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')), 1) AS n_tokens,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
),
sizes AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::DOUBLE AS n_tokens FROM d GROUP BY source),
told AS (SELECT sum(n_tokens) AS t, {mixing.TARGET_ENTROPY} * ln(count(*)) - 1e-12 AS enough FROM sizes),
-- both bounds by halving: the largest step with enough entropy, the largest that repeats too often
b AS (
  SELECT 0 AS h, 0 AS r, {half} AS w, {measured("0")}.r > {mixing.REPEAT_LIMIT} AS often
  UNION ALL
  SELECT CASE WHEN {measured("(h + w)")}.h >= (SELECT enough FROM told) THEN h + w ELSE h END,
    CASE WHEN {measured("(r + w)")}.r > {mixing.REPEAT_LIMIT} THEN r + w ELSE r END, w // 2, often
  FROM b WHERE w > 0
),
k AS (SELECT greatest(CASE WHEN {measured(str(steps))}.h >= (SELECT enough FROM told) THEN {steps} ELSE h END, CASE WHEN often THEN r + 1 ELSE 0 END) AS k FROM b WHERE w = 0),
weighted AS (
  SELECT source, n_docs, n_tokens, pow(n_tokens / (SELECT t FROM told), (SELECT k FROM k) / {steps}.0) AS power
  FROM sizes
),
plan AS (
  SELECT source, ceil(n_docs / {mixing.BLOCK_ROWS}.0)::BIGINT AS n_blocks, n_tokens::BIGINT AS of_tokens,
    floor(power * (SELECT max(n_tokens / power) FROM weighted) + 0.5)::BIGINT AS budget
  FROM weighted
),
placed AS (
  SELECT doc_id, d.source, n_tokens, key, ('0x' || substr(key, 1, 8))::BIGINT % n_blocks AS block,
    of_tokens, budget // of_tokens AS epochs, budget % of_tokens AS rest
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
),
blocks AS (
  SELECT source, block, {before("epochs")} AS before, {before("epochs - 1")} AS whole
  FROM (SELECT source, block, epochs, sum(n_tokens) AS n FROM placed GROUP BY source, block, epochs)
),
run AS (
  SELECT placed.*, before, whole, before < rest AS taken, before + coalesce(sum(n_tokens) OVER (PARTITION BY placed.source, placed.block ORDER BY key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
  FROM placed JOIN blocks ON placed.source IS NOT DISTINCT FROM blocks.source AND placed.block = blocks.block
)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, block,
  (epochs + CASE WHEN reached < rest THEN 1 ELSE 0 END)::BIGINT AS draws,
  (CASE WHEN taken THEN epochs WHEN epochs > 0 THEN epochs - 1 END)::BIGINT AS epoch,
  (CASE WHEN taken THEN epochs * of_tokens + before WHEN epochs > 0 THEN (epochs - 1) * of_tokens + whole END)::BIGINT AS start
FROM run"""


def _op6() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10"""


def _op9() -> str:
    # 5 hexadecimal digits are 20 bits, that is 4 letters of base 32
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
        f"((('0x' || substr(sha, {5 * g + 1}, 5))::INT >> {15 - 5 * k}) & 31) + 1, 1)"
        for g in range(8)
        for k in range(4)
    )
    return f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS sha
  FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, n) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {letters} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


def _op11() -> str:
    k, rounds = 40, 5
    ctes = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(floor(256 * x::DOUBLE)) > {centroids.LARGEST})) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v
  FROM k QUALIFY c < {k}
)""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT row, c, list_sum(list_transform(list_zip(k.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM k, c{i}
  ) GROUP BY row
)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT best.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS i FROM k JOIN a{i} USING (row)) GROUP BY 1, 2
    ) GROUP BY c
  ) m USING (c)
)""")
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM k JOIN a{rounds} USING (row) JOIN c{rounds} z ON z.c = best.c"""


def _op13() -> str:
    return """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents
),
g AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM g
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""


def all_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": _op3(), "op4_license_scans": _op4(), "op5_mixing": _op5(), "op6_exact_topk": _op6(),
        "op9_warc": _op9(), "op11_centroid_clustering": _op11(),
        "op13_fill_in_middle": _op13(),
    }
