"""SQL for the training-text queries that SQL expresses, over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str) -> str:
    return f"regexp_extract_all({_LOWER}, '{pattern}')"


RANKED_SEARCH = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {_words(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")} AS w FROM documents),
tf AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
base AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, base GROUP BY t, n),
m AS (SELECT rid, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, base WHERE len(w) > 0),
q AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest({_words(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")}) AS t FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN weight USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

DECONTAMINATION = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
spans AS MATERIALIZED (
  SELECT DISTINCT item, l, array_to_string(w[s:s + l - 1], ' ') AS span
  FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS s
        FROM (SELECT item, w, least(10, len(w)) AS l FROM i WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT l FROM spans),
windows AS (
  SELECT rid, s, l, array_to_string(w[s:s + l - 1], ' ') AS span
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lengths WHERE len(w) >= l)),
hits AS MATERIALIZED (SELECT rid, s, l, item FROM windows JOIN spans USING (l, span)),
n_hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (rid) LEFT JOIN named USING (rid)
"""


def _code_rounds(rounds: int = 4) -> str:
    """Assignments and codebooks of all rounds, and the last assignment, as a chain of tables."""
    out = []
    for i in range(rounds + 1):
        out.append(
            f"""
a{i} AS MATERIALIZED (
  SELECT rid, part, min(distance * 256 + entry) AS best
  FROM (SELECT rid, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance
        FROM parts JOIN c{i} USING (part, dim) GROUP BY ALL) GROUP BY ALL)"""
        )
        if i < rounds:
            out.append(
                f"""
c{i + 1} AS MATERIALIZED (
  SELECT part, entry, dim, coalesce(mean, c) AS c
  FROM c{i} LEFT JOIN (
    SELECT part, best % 256 AS entry, dim, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS mean
    FROM parts JOIN a{i} USING (rid, part) GROUP BY ALL) USING (part, entry, dim))"""
            )
    return ",".join(out)


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (
  SELECT rid, (i - 1) // (n // 4) AS part, (i - 1) % (n // 4) AS dim, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT rid, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, dim, x AS c FROM parts WHERE rid <= 256),
{_code_rounds()},
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM a4 GROUP BY rid),
book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, dim)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), book
"""
