"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP5 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (CAST(list_aggregate(list_transform(range(5), lambda b:
        ((instr('0123456789abcdef', hex[1 + (i * 5 + b) // 4]) - 1)
          >> (3 - (i * 5 + b) % 4) & 1) << (4 - b)), 'sum') AS INT))]),
    'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id
    THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
    THEN first_id END AS refers_to,
  CAST(NULL AS VARCHAR) AS fault
FROM f
"""

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP6 = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b
        WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Bytes of runs: À to ÿ are two bytes in UTF-8, C3 and the code point minus 64.
OP11 = r"""
WITH RECURSIVE
crc(t) AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
  WHERE length(r) >= 7),
seen AS (SELECT id, run, count(*) AS times FROM run GROUP BY id, run),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(id || ':' || run, ''), lambda ch:
        CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [195, unicode(ch) - 64] END))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
  FROM seen, crc),
word AS (
  SELECT times, CASE WHEN h % 31 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
v AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM word WHERE length(word) >= 7
  GROUP BY word HAVING sum(times) >= 2),
gap AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM gap a JOIN gap b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT gap.word, v.word FROM gap JOIN v ON rest = v.word
  UNION SELECT v.word, gap.word FROM gap JOIN v ON rest = v.word),
ranked AS (
  SELECT a, b, v.n, count(*) OVER (PARTITION BY a) AS n_near,
    row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS place
  FROM near JOIN v ON b = v.word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN r.n >= 10 * v.n THEN b END AS form, CASE WHEN r.n >= 10 * v.n THEN r.n END AS form_n
  FROM v LEFT JOIN ranked r ON a = word AND place = 1),
chain AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word
  WHERE f.form IS NOT NULL),
last AS (SELECT chain.word, root FROM chain JOIN f ON root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""

OP12 = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1),
      lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM q a, q b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id, positive_score, row_id AS negative_id, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id)
    AS INTEGER) AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLES = {"op5_warc": OP5, "op6_decontamination": OP6, "op11_spelling": OP11, "op12_hard_negatives": OP12}
