"""The queries that SQL can express on whole tables, in DuckDB SQL."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: str) -> str:
    return f"translate({c}, '{_UP}', '{_LOW}')"


OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
s AS (SELECT win FROM p WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT doc_id, i, word, max((s.win IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 34 PRECEDING) AS gone
      FROM p LEFT JOIN s ON s.win = p.win),
a AS (SELECT doc_id, sum(gone)::BIGINT AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)"""

OP2 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, {_lower(r"trim(ls[i], E' \t\n\x0b\x0c\r')")} AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT doc_id, i, line, owner IS NULL OR owner = doc_id AS stays FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP4 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = e.vec_id AS kept
FROM (SELECT vec_id FROM embeddings) e JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) k ON k.u = e.vec_id
LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) x ON x.u = e.vec_id"""

OP7 = """
WITH RECURSIVE bits AS (
  SELECT b AS b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents)),
s AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
    sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total
  FROM d, crc),
g AS (SELECT *, ((2 * before + size) * 24 // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM g"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)),
f AS (SELECT doc_id, item_id, p.n, i FROM p JOIN bw ON bw.win = p.win AND bw.n = p.n),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op2_line_dedup": OP2,
    "op4_embedding_near_dedup": OP4,
    "op7_sharding": OP7,
    "op9_benchmark_decontamination": OP9,
}
