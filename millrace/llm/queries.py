"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from millrace.llm.exact_dedup import op7_exact_dedup
from millrace.llm.fingerprints import op1_fingerprints
from millrace.llm.language_id import op10_language_id
from millrace.llm.lm_scoring import op5_lm_scoring
from millrace.llm.mixing import op8_mixing
from millrace.llm.ngram_join import op3_ngram_join
from millrace.llm.packing import op4_packing
from millrace.llm.quality import op13_quality
from millrace.llm.sharding import op2_sharding
from millrace.llm.spelling import op12_spelling
from millrace.llm.toxicity import op6_toxicity
from millrace.llm.vector_codes import op11_vector_codes
from millrace.llm.warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_sharding, op3_ngram_join, op4_packing, op5_lm_scoring, op6_toxicity, op7_exact_dedup, op8_mixing, op9_warc, op10_language_id, op11_vector_codes, op12_spelling, op13_quality)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _codes_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Product codes: each round is an assignment over all entries and a floor of averages."""
    near = "SELECT p.part, p.vec_id, p.label, any_value(p.x) AS x, min(list_sum(list_transform(range(1, {w} + 1), lambda i: (p.x[i] - c.c[i]) * (p.x[i] - c.c[i]))) * {k} + c.entry) AS m FROM p JOIN c{r} c ON c.part = p.part GROUP BY 1, 2, 3"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, x[part * {width} + 1:part * {width} + {width}] AS x FROM v, range({parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(w=width, k=entries, r=r)})")
        steps.append(f"m{r} AS (SELECT part, entry, list(z ORDER BY i) AS c FROM (SELECT part, m % {entries} AS entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS z FROM a{r}, range(1, {width} + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry)")
    steps.append(f"e AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM ({near.format(w=width, k=entries, r=rounds)}) GROUP BY 1, 2)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e, s"


#: Where SQL can tell the result. The others depend on hashes, sketches or models, and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
  r AS (SELECT a AS id, a AS m FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m),
  t AS (SELECT id, min(m) AS m FROM r GROUP BY 1)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(t.m, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.id = d.doc_id""",
    "op7_exact_dedup": r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, md5(CAST(doc_id AS VARCHAR)) < '8' AS past FROM documents),
  k AS (SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size, bool_or(past) AS in_history FROM d GROUP BY 1)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256, in_history FROM d JOIN k USING (h)""",
    "op8_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5('order ' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY 1),
  w AS (SELECT *, CAST(list_extract([5, 2, 1], CAST(place % 3 + 1 AS INT)) AS DOUBLE) AS weight, list_extract([0.6::DOUBLE, -0.6::DOUBLE, 0::DOUBLE], CAST(place % 3 + 1 AS INT)) AS slope FROM s),
  o AS (SELECT *, 2 * source_size / weight AS fill FROM w),
  l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
  t AS (SELECT source, source_size, slope, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
  r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d),
  m AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.slope, pos, CAST(round(t.target) AS BIGINT) AS goal, greatest(0, least(r.size, CAST(round(t.target) AS BIGINT) - pos)) AS one, greatest(0, least(r.size, CAST(round(t.target) AS BIGINT) - pos - t.source_size)) AS two FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source)
  SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(one + two AS BIGINT) AS taken, CAST((one > 0)::INT + (two > 0)::INT AS INT) AS turns,
    round(CASE WHEN one > 0 THEN 2 * (pos / goal) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (pos / goal))) END, 9) AS position FROM m""",
    "op9_warc": r"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, regexp_replace(coalesce(url, 'about:blank'), '[\x00-\x20\x7f]', '%20', 'g') AS u FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to,
    'GET ' || coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]*([^#]*)', 1), ''), '/') || ' HTTP/1.1' AS request FROM f""",
    "op11_vector_codes": _codes_sql(),
    "op12_spelling": r"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
  o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS key, w, count(*) AS n FROM r GROUP BY ALL),
  h AS (SELECT w, n, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(key, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM o, t),
  d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
  k AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
  c AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM k)),
  e AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
    UNION SELECT c.word, k.word, k.n FROM c JOIN k ON k.word = c.s UNION SELECT k.word, c.word, c.n FROM c JOIN k ON k.word = c.s),
  b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY 1),
  f AS MATERIALIZED (SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * k.n THEN near END AS form, CASE WHEN near_n >= 2 * k.n THEN near_n END AS form_n FROM k LEFT JOIN b USING (word)),
  g AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.root AND f.form IS NOT NULL),
  z AS (SELECT word, arg_max(root, step) AS root FROM g GROUP BY 1)
  SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN z USING (word)""",
}
