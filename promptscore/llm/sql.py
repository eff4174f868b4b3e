"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, source FROM documents
), w AS (
  SELECT rn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), windows AS (
  SELECT rn, p, list_slice(words, p, p + 7) AS win
  FROM (SELECT rn, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)
), chosen AS (
  SELECT rn, p FROM (SELECT rn, p, count(*) OVER (PARTITION BY rn, win) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rn, sum(least(8, coalesce(nxt - p, 8))) AS n
  FROM (SELECT rn, p, lead(p) OVER (PARTITION BY rn ORDER BY p) AS nxt FROM chosen) GROUP BY rn
), base AS (
  SELECT d.rn, d.doc_id, d.source, d.text, len(w.words) AS n_words,
         length(array_to_string(w.words, '')) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(w.lines) - len(list_distinct(w.lines)) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rn) LEFT JOIN covered USING (rn)
), judged AS (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM base
), units AS (
  SELECT source, text, line, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words
  FROM (
    SELECT source, text, array_to_string(regexp_extract_all(
             translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line
    FROM (SELECT DISTINCT d.source, d.text, w.lines, generate_subscripts(w.lines, 1) AS i, unnest(w.lines) AS l
          FROM d JOIN w USING (rn))
  ) GROUP BY source, text, line
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source
), common AS (
  SELECT u.source, u.line FROM (SELECT source, line, count(*) AS docs FROM units GROUP BY source, line) u
  JOIN hosts h ON u.source IS NOT DISTINCT FROM h.source
  WHERE u.docs >= 8 AND u.docs * 50 > h.host_docs
), worn AS (
  SELECT u.source, u.text, sum(CASE WHEN c.line IS NOT NULL THEN u.words ELSE 0 END) AS lost, sum(u.words) AS total
  FROM units u LEFT JOIN common c ON u.source IS NOT DISTINCT FROM c.source AND u.line = c.line
  GROUP BY u.source, u.text
)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       NOT j.base_failed AND coalesce(x.lost, 0) * 100 <= coalesce(x.total, 0) * 70 AS kept,
       CAST(floor(coalesce(x.lost, 0) * 100 / greatest(coalesce(x.total, 1), 1)) AS BIGINT) AS lost_percent
FROM judged j LEFT JOIN worn x ON j.source IS NOT DISTINCT FROM x.source AND j.text = x.text
"""

OP4 = r"""
WITH l AS (
  SELECT doc_id, lines, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), u AS (
  SELECT doc_id, i, line, regexp_extract_all(
           translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start
  FROM l
), r AS (
  SELECT *, len(words) >= 20 AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, i) > 1 AS gone
  FROM u
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       coalesce(string_agg(concat(CAST(start AS BIGINT), '-', CAST(start AS BIGINT) + length(line)), ',' ORDER BY i)
                FILTER (WHERE gone), '') AS removed
FROM r GROUP BY doc_id
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark
), si AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), k AS (SELECT DISTINCT k FROM si), sd AS (
  SELECT DISTINCT doc_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k.k, unnest(range(1, len(w) - k.k + 2)) AS p FROM d, k WHERE len(w) >= k.k)
), n AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id)
SELECT sd.doc_id, n.item_id, n.item_shingles, count(*) AS shared
FROM si JOIN sd USING (k, s) JOIN n USING (item_id)
GROUP BY sd.doc_id, n.item_id, n.item_shingles HAVING count(*) * 10 >= n.item_shingles * 8
"""

OP11 = r"""
WITH clean AS (
  SELECT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (
    SELECT DISTINCT vec_id, label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) > 1048576)) = 0
  )
), anchors AS (
  SELECT * FROM clean WHERE vec_id % 100 = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS a_label, c.vec_id, c.label,
         CAST(coalesce(list_sum(list_transform(range(1, greatest(len(a.v), len(c.v)) + 1),
              lambda i: coalesce(a.v[i], 0) * coalesce(c.v[i], 0))), 0) AS BIGINT) AS score
  FROM anchors a JOIN clean c ON c.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
    FROM scored WHERE label = a_label
  ) WHERE r <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.a_label
   AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""


def _base32_of_hex(h: str) -> str:
    """DuckDB expression: the base32 text of the 40 hex digits ``h``, 40 bits (8 letters) at a time."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    parts = []
    for group in range(4):
        bits = f"('0x' || substr({h}, {10 * group + 1}, 10))::BIGINT"
        parts += [f"substr({letters}, (({bits} >> {35 - 5 * k}) & 31) + 1, 1)" for k in range(8)]
    return " || ".join(parts)


OP13 = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST) AS r,
         first_value(page_id) OVER (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST) AS top
  FROM p
)
SELECT page_id, payload_bytes, {_base32_of_hex("h")} AS payload_digest,
       CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r = 1 THEN NULL ELSE top END AS refers_to
FROM ranked
"""
