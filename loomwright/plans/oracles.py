"""The registered queries in DuckDB SQL, built from shared fragments."""

from __future__ import annotations

from loomwright.functions.text import GUARD_PATTERNS, PROTECTED_TOKEN_PARTS
from loomwright.operators import generate

_WS = "E' \\n\\t\\r'"
_GUARD = "(?i)" + "|".join(p.replace("'", "''") for p in GUARD_PATTERNS)
_SAFE = "|".join(p.replace("'", "''") for p in PROTECTED_TOKEN_PARTS)


def _parts(split: str) -> str:
    return f"list_filter(list_transform({split}, lambda x: trim(x, {_WS})), lambda x: x <> '')"


SEGMENTS = f"""
prompt AS (SELECT doc_id, text, trim(coalesce(text, ''), {_WS}) AS t FROM documents),
cut AS (
  SELECT doc_id, text, t,
    {_parts(r"string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")} AS s,
    {_parts(r"string_split_regex(t, '\n\s*\n')")} AS p
  FROM prompt),
part AS (
  SELECT doc_id, text, CASE WHEN t = '' THEN [] WHEN len(s) > 1 THEN s WHEN len(p) > 1 THEN p ELSE [t] END AS parts FROM cut),
seg AS (
  SELECT doc_id, idx - 1 AS idx, parts[idx] AS segment,
    list_filter(string_split_regex(parts[idx], '\\s+'), lambda x: x <> '') AS toks
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS idx FROM part))"""

UNIGRAMS = """
cnt AS (SELECT token, count(*) AS c FROM (SELECT unnest(toks) AS token FROM seg) GROUP BY token),
tot AS (SELECT sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v FROM cnt)"""

SCORES = f"""
tok AS (SELECT doc_id, idx, toks[i] AS token FROM (SELECT doc_id, idx, toks, unnest(range(2, len(toks) + 1)) AS i FROM seg)),
sc AS (
  SELECT doc_id, idx, round(exp(avg(-ln((c + 1) / (n + v)))), 9) AS score
  FROM tok JOIN cnt USING (token), tot GROUP BY doc_id, idx),
scored AS (
  SELECT seg.doc_id, seg.idx, segment, least(len(toks), 4096) AS tc, coalesce(score, 'inf'::DOUBLE) AS score,
    regexp_matches(segment, '{_GUARD}') AS protected
  FROM seg LEFT JOIN sc USING (doc_id, idx))"""


def _selected(ratios: str) -> str:
    """Selection at each ratio, before any trim."""
    return f"""
rat AS (SELECT unnest({ratios})::DOUBLE AS ratio),
arr AS (
  SELECT doc_id, list(struct_pack(idx := idx, segment := segment, tc := tc, score := score, protected := protected) ORDER BY idx) AS segs,
    greatest(1, sum(tc)) AS original_tokens
  FROM scored GROUP BY doc_id),
tgt AS (
  SELECT arr.*, ratio, greatest(1, trunc(original_tokens * (1::DOUBLE - ratio))::INT) AS target_tokens,
    list_filter(segs, lambda s: s.protected) AS held,
    list_sort(list_transform(list_filter(segs, lambda s: NOT s.protected), lambda s: struct_pack(r := -s.score, idx := s.idx, n := s.tc))) AS ranked
  FROM arr, rat),
rm AS (SELECT *, greatest(0, target_tokens - coalesce(list_sum(list_transform(held, lambda s: s.tc)), 0)) AS room FROM tgt),
tk AS (
  SELECT *, list_reduce(list_transform(ranked, lambda s: struct_pack(used := s.n::BIGINT, took := [s.idx])),
    lambda a, s: CASE WHEN a.used + s.used <= room THEN struct_pack(used := a.used + s.used, took := list_concat(a.took, s.took)) ELSE a END,
    struct_pack(used := 0::BIGINT, took := []::BIGINT[])) AS f
  FROM rm),
kp AS (
  SELECT *, list_concat(list_transform(held, lambda s: s.idx), f.took) AS took FROM tk),
sel AS (
  SELECT doc_id, ratio, segs, original_tokens, target_tokens, held,
    list_sort(CASE WHEN len(took) > 0 THEN took ELSE [ranked[1].idx] END) AS kept
  FROM kp),
txt AS (
  SELECT *, array_to_string(list_transform(kept, lambda i: segs[i + 1].segment), ' ') AS joined FROM sel),
fl AS (
  SELECT *, len(list_filter(string_split_regex(joined, '\\s+'), lambda x: x <> '')) AS jt FROM txt),
need AS (
  SELECT *, (len(segs) = 1 AND original_tokens > target_tokens) AS single,
    (len(segs) = 2 AND jt > trunc(target_tokens * 1.35::DOUBLE)) AS over
  FROM fl),
ptok AS (
  SELECT doc_id, ratio, target_tokens, n, i - 1 AS pos, toks[i] AS token
  FROM (SELECT doc_id, ratio, target_tokens, len(toks) AS n, toks, unnest(range(1, len(toks) + 1)) AS i
        FROM (SELECT need.doc_id, ratio, target_tokens, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS toks
              FROM need JOIN prompt USING (doc_id) WHERE single OR over))),
plost AS (
  SELECT ptok.*, CASE WHEN pos = 0 THEN 'inf'::DOUBLE ELSE round(-ln((coalesce(c, 0) + 1) / (tot.n + v)), 9) END AS loss,
    (regexp_matches(lower(token), '{_SAFE}') OR pos < 4 OR pos >= ptok.n - 2) AS safe
  FROM ptok LEFT JOIN cnt USING (token), tot),
prank AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ratio, safe ORDER BY loss, pos) AS rk FROM plost),
trimmed AS (
  SELECT doc_id, ratio, string_agg(token, ' ' ORDER BY pos) AS tr, count(*) AS tt
  FROM prank WHERE safe OR rk > greatest(0, n - target_tokens) GROUP BY doc_id, ratio),
result AS (
  SELECT prompt.doc_id, rat.ratio, coalesce(original_tokens, 0) AS original_tokens, coalesce(target_tokens, 0) AS target_tokens,
    CASE WHEN segs IS NULL THEN 0 WHEN tr IS NOT NULL THEN tt ELSE jt END AS compressed_tokens,
    CASE WHEN segs IS NULL THEN 0 WHEN single THEN 1 ELSE len(kept) END AS segments_kept,
    coalesce(len(segs), 0) AS segments_total,
    CASE WHEN segs IS NULL OR single THEN 0 ELSE len(held) END AS protected_segments_kept,
    CASE WHEN segs IS NULL THEN coalesce(text, '') WHEN tr IS NOT NULL THEN tr ELSE joined END AS compressed, kept
  FROM prompt CROSS JOIN rat LEFT JOIN need ON need.doc_id = prompt.doc_id AND need.ratio = rat.ratio
  LEFT JOIN trimmed ON trimmed.doc_id = prompt.doc_id AND trimmed.ratio = rat.ratio)"""


COMPRESS = f"WITH {SEGMENTS}, {UNIGRAMS}, {SCORES}, {_selected('[0.40]')}"
SWEEP = f"WITH {SEGMENTS}, {UNIGRAMS}, {SCORES}, {_selected('[0.25, 0.40, 0.55]')}"
REDUCTION = "CASE WHEN original_tokens = 0 THEN 0 ELSE 1 - compressed_tokens / original_tokens::DOUBLE END"


def _unified(source: str, tau: float) -> str:
    """Sequential leader clustering of rows (k, v) as a recursive walk that carries the list of leaders."""
    return f"""
src AS MATERIALIZED ({source}),
num AS MATERIALIZED (SELECT k, v, row_number() OVER (ORDER BY k) AS r FROM src),
sim AS MATERIALIZED (
  SELECT a.r AS i, b.r AS j, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS s
  FROM num a JOIN num b ON b.r < a.r),
near AS MATERIALIZED (SELECT num.r AS i, list(j ORDER BY j) FILTER (WHERE s >= {tau}) AS js FROM num LEFT JOIN sim ON sim.i = num.r GROUP BY num.r),
walk AS (
  SELECT 1::BIGINT AS r, [1::BIGINT] AS led
  UNION ALL
  SELECT w.r + 1, CASE WHEN len(list_intersect(w.led, coalesce(n.js, []))) > 0 THEN w.led ELSE list_append(w.led, w.r + 1) END
  FROM walk w JOIN near n ON n.i = w.r + 1),
leaders AS MATERIALIZED (SELECT unnest(led) AS l FROM (SELECT led FROM walk ORDER BY r DESC LIMIT 1)),
best AS (
  SELECT i, max(s) AS s, min(j) FILTER (WHERE s = m) AS j
  FROM (SELECT i, j, s, max(s) OVER (PARTITION BY i) AS m FROM sim JOIN leaders ON l = j) GROUP BY i),
cid AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS canonical_id FROM leaders),
uni AS (
  SELECT num.k, lead.k AS leader, canonical_id, coalesce(b.s, 0)::DOUBLE AS similarity, self.l IS NULL AS cache_hit
  FROM num LEFT JOIN best b ON b.i = num.r LEFT JOIN leaders self ON self.l = num.r
  JOIN cid ON cid.l = CASE WHEN self.l IS NULL THEN b.j ELSE num.r END JOIN num lead ON lead.r = cid.l)"""


_EMBEDDED = "SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings"


def _vectors(source: str) -> str:
    """Hashed bags of words of (doc_id, body)."""
    return f"""
SELECT doc_id AS k, list(coalesce(c, 0)::DOUBLE ORDER BY b) AS v FROM (
  SELECT d.doc_id, g.b, h.c FROM (SELECT doc_id FROM {source}) d CROSS JOIN (SELECT unnest(range(256)) AS b) g
  LEFT JOIN (
    SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS b, count(*) AS c
    FROM (SELECT doc_id, unnest(list_filter(string_split_regex(compressed, '\\s+'), lambda x: x <> '')) AS token FROM {source})
    GROUP BY ALL) h ON h.doc_id = d.doc_id AND h.b = g.b) GROUP BY doc_id"""


def _purity(tau: float) -> str:
    return f"""SELECT {tau}::DOUBLE AS tau, sum(n)::BIGINT AS total_prompts, sum(h)::BIGINT AS cache_hits, sum(h) / sum(n)::DOUBLE AS cache_hit_rate,
  count(*) AS canonical_count, count(*) FILTER (WHERE c > 1) AS merged_cluster_count, avg(1.0::DOUBLE / c) AS cluster_purity
FROM (SELECT canonical_id, count(DISTINCT label) AS c, count(*) AS n, count(*) FILTER (WHERE cache_hit) AS h
      FROM uni JOIN embeddings ON vec_id = k GROUP BY canonical_id)"""


def _recorded() -> str:
    return """
open AS (SELECT *, trim(coalesce(text, ''), E' \\n\\t\\r') <> '' AS o FROM conversations),
k AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'system' AND o) AS s, max(turn) FILTER (WHERE role = 'user' AND o) AS u, max(turn) AS e FROM open GROUP BY conv_id)"""


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(options: list[str]) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"[{listed}][('0x' || substr(md5(x || '42'), 1, 6))::BIGINT % {len(options)} + 1]"


_NEAREST = "list_sort(list(value))[least(trunc(count(*) * p)::INT + 1, count(*))]"
_LOWERED = "lower(substr(b, 1, 1)) || substr(b, 2)"

PARAPHRASES = f"""b AS (SELECT item_id, trim(text, E' \\n\\t\\r') AS x, regexp_replace(trim(text, E' \\n\\t\\r'), '[.!?]+$', '') AS b FROM benchmark WHERE text IS NOT NULL),
made AS (
  SELECT item_id, 'conditional' AS transform, 'Given the input below, ' || {_LOWERED} || '.' AS text FROM b WHERE x <> '' AND NOT (lower(x) LIKE 'if %' OR lower(x) LIKE 'when %' OR lower(x) LIKE 'given %')
  UNION ALL SELECT item_id, 'passive', 'The following task should be completed: ' || {_LOWERED} || '.' FROM b WHERE regexp_matches(lower(x), '^(?:{"|".join(generate.ACTION_VERBS)})')
  UNION ALL SELECT item_id, 'purpose', {_pick(generate.PURPOSES)} || ', ' || {_LOWERED} || '.' FROM b WHERE x <> ''
  UNION ALL SELECT item_id, 'output_first', {_pick(generate.OUTPUTS)} || ': ' || {_LOWERED} || '.' FROM b WHERE x <> ''
  UNION ALL SELECT item_id, 'negation', {_pick(generate.WARNINGS)} || {_LOWERED} || '.' FROM b WHERE x <> '')"""

#: Each user prompt twice, compressed and unified in the order run, key.
_EXPERIMENT = f"""WITH RECURSIVE u AS (SELECT conv_id * 1000 + turn AS o, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
runs AS (SELECT o + r * (SELECT max(o) + 1 FROM u) AS doc_id, text FROM u, (SELECT unnest([0, 1]) AS r)),
{SEGMENTS.replace("FROM documents", "FROM runs")}, {UNIGRAMS}, {SCORES}, {_selected("[0.40]")}, {_unified(_vectors("result"), 0.95)},
res AS (SELECT *, {REDUCTION} AS red FROM result)"""

ORACLES: dict[str, str] = {
    "segments": f"WITH {SEGMENTS} SELECT prompt.doc_id, count(segment) AS n_segments, coalesce(sum(least(len(toks), 4096)), 0)::BIGINT AS n_tokens FROM prompt LEFT JOIN seg USING (doc_id) GROUP BY prompt.doc_id",
    "guarded_segments": f"WITH {SEGMENTS} SELECT doc_id, idx, substr(segment, 1, 120) AS preview, least(len(toks), 64) AS token_count, len(toks) > 64 AS truncated FROM seg WHERE regexp_matches(segment, '{_GUARD}')",
    "segment_scores": f"WITH {SEGMENTS}, {UNIGRAMS}, {SCORES} SELECT doc_id, idx, tc AS token_count, protected, score FROM scored",
    "compress": f"{COMPRESS} SELECT doc_id, ratio, original_tokens, target_tokens, compressed_tokens, segments_kept, segments_total, protected_segments_kept, {REDUCTION} AS token_reduction, compressed FROM result",
    "compression_sweep": f"{SWEEP} SELECT ratio, count(*) AS prompts, avg({REDUCTION}) AS avg_token_reduction, min({REDUCTION}) AS min_token_reduction, max({REDUCTION}) AS max_token_reduction, sum(original_tokens)::BIGINT AS original_tokens, sum(compressed_tokens)::BIGINT AS compressed_tokens FROM result GROUP BY ratio",
    "segment_diagnostics": f"{COMPRESS} SELECT s.doc_id, s.idx, substr(segment, 1, 120) AS preview, tc AS token_count, score, protected, list_contains(kept, s.idx) AS kept FROM scored s JOIN sel USING (doc_id)",
    "nearest_canonical": f"""WITH RECURSIVE {_unified(_EMBEDDED, 0.30)}, s AS (
  SELECT q.k, c.canonical_id AS c, round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 9) AS s
  FROM num q, num i JOIN cid c ON c.l = i.r)
SELECT k AS vec_id, CASE WHEN s >= 0.30 THEN c END AS canonical_id, s AS similarity, s >= 0.30 AS hit
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, c) AS r FROM s) WHERE r = 1""",
    "unify_in_rounds": f"WITH RECURSIVE {_unified(_EMBEDDED, 0.30)} SELECT k AS vec_id, leader, canonical_id, similarity, cache_hit FROM uni",
    "unify_from_inventory": f"WITH RECURSIVE {_unified(_EMBEDDED, 0.30)} SELECT k AS vec_id, canonical_id, similarity, cache_hit FROM uni",
    "unify_prompts": f"WITH RECURSIVE {_unified(_EMBEDDED, 0.30)} SELECT k AS vec_id, leader, canonical_id, similarity, cache_hit FROM uni",
    "tau_sweep": " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_unified(_EMBEDDED, t)} {_purity(t)})" for t in (0.25, 0.30, 0.40)),
    "pipeline_process": f"""{COMPRESS.replace('WITH', 'WITH RECURSIVE', 1)}, {_unified(_vectors('result'), 0.95)}
SELECT r.doc_id, c.compressed AS final_prompt, r.original_tokens, r.compressed_tokens, {REDUCTION.replace('original_tokens', 'r.original_tokens').replace('compressed_tokens', 'r.compressed_tokens')} AS token_reduction,
  cache_hit, round(similarity, 6) AS similarity, canonical_id, NOT cache_hit AS is_new_canonical
FROM result r JOIN uni ON uni.k = r.doc_id JOIN result c ON c.doc_id = uni.leader""",
    "canonical_inventory": f"""{COMPRESS.replace('WITH', 'WITH RECURSIVE', 1)}, {_unified(_vectors('result'), 0.95)}
SELECT canonical_id, compressed AS text, len(list_filter(string_split_regex(compressed, '\\s+'), lambda x: x <> '')) AS token_count, list_sum(v)::BIGINT AS mass
FROM uni JOIN result ON doc_id = k JOIN src USING (k) WHERE NOT cache_hit""",
    "exact_dedupe": "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "cluster_overlap": """WITH w AS (SELECT source, doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
o AS (SELECT a.source, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM w a JOIN w b ON a.source = b.source AND a.doc_id < b.doc_id)
SELECT source, count(*) AS pairs, round(avg(CASE WHEN x = 0 OR y = 0 THEN 0 ELSE i / (x + y - i)::DOUBLE END), 9) AS mean_overlap, max(CASE WHEN x = 0 OR y = 0 THEN 0 ELSE i / (x + y - i)::DOUBLE END) AS max_overlap FROM o GROUP BY source""",
    "near_duplicate_removal": """WITH RECURSIVE w AS MATERIALIZED (
  SELECT source, doc_id, row_number() OVER (ORDER BY doc_id) AS r, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
near AS MATERIALIZED (
  SELECT a.r AS i, list(b.r) FILTER (WHERE b.r IS NOT NULL AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE >= 0.92) AS js
  FROM w a LEFT JOIN w b ON a.source = b.source AND b.r < a.r GROUP BY a.r),
walk AS (
  SELECT 1::BIGINT AS r, [1::BIGINT] AS led
  UNION ALL
  SELECT k.r + 1, CASE WHEN len(list_intersect(k.led, coalesce(n.js, []))) > 0 THEN k.led ELSE list_append(k.led, k.r + 1) END FROM walk k JOIN near n ON n.i = k.r + 1)
SELECT doc_id, source FROM w JOIN (SELECT unnest(led) AS r FROM (SELECT led FROM walk ORDER BY r DESC LIMIT 1)) USING (r)""",
    "training_pairs": """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, text AS c FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r FROM u) WHERE r = 1)
SELECT conv_id, text AS anchor, c AS positive FROM u JOIN c USING (conv_id) WHERE text <> c UNION ALL SELECT conv_id, c, text FROM u JOIN c USING (conv_id)""",
    "shortest_member": """SELECT source, doc_id, n AS token_count FROM (
  SELECT source, doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY source ORDER BY len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), doc_id) AS r FROM documents) WHERE r = 1""",
    "route_messages": f"WITH {_recorded()} SELECT conv_id, turn, role, (role = 'system' AND o) OR (s IS NULL AND turn IS NOT DISTINCT FROM u) AS processed, CASE WHEN s IS NOT NULL THEN turn = s ELSE turn IS NOT DISTINCT FROM u END AS recorded FROM open JOIN k USING (conv_id)",
    "recorded_prompts": f"WITH {_recorded()} SELECT conv_id, turn, role, coalesce(text, '') AS text, s IS NULL AND u IS NULL AS noop FROM open JOIN k USING (conv_id) WHERE turn = coalesce(s, u, e)",
    "first_user_prompts": "SELECT conv_id, trim(text, E' \\n\\t\\r') AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user' AND trim(coalesce(text, ''), E' \\n\\t\\r') <> '') WHERE r = 1 AND length(trim(text, E' \\n\\t\\r')) > 20 ORDER BY conv_id LIMIT 50",
    "rejected_requests": "SELECT event_id, 400 AS status FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN E' \\n' ELSE event_type || E'\\n' || props END AS prompt FROM events) WHERE trim(prompt, E' \\n\\t\\r') = ''",
    "request_log": f"""{COMPRESS} SELECT doc_id::VARCHAR AS request_id, 'chat' AS endpoint, {REDUCTION} AS token_reduction, original_tokens::BIGINT AS original_tokens, compressed_tokens::BIGINT AS final_tokens,
  (original_tokens - compressed_tokens)::BIGINT AS token_delta, substr(compressed, 1, 500) AS final_prompt, NULL::BIGINT AS canonical_id, 'default' AS model, 512 AS max_tokens FROM result""",
    "service_stats": "SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'purchase') AS unifier_cache_hits, avg((event_type = 'purchase')::INT) AS unifier_hit_rate, avg(value) AS avg_pipeline_ms FROM events",
    "latency_percentiles": f"SELECT event_type, p, {_NEAREST} AS value FROM events, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p) WHERE value IS NOT NULL GROUP BY event_type, p",
    "request_summary": """WITH r AS (SELECT event_type, value, (event_id % 10) / 10.0::DOUBLE AS red, (user_id % 5) / 5.0::DOUBLE AS rou, event_id % 3 = 0 AS hit FROM events),
m AS (SELECT event_type, avg(red) AS avg_token_reduction, avg(rou) AS avg_rouge_l, avg(hit::INT) AS unifier_hit_rate, count(*) AS total_requests,
  list_sort(list(value))[least(trunc(count(value) * 0.5::DOUBLE)::INT + 1, count(value))] AS p50_latency_ms, list_sort(list(value))[least(trunc(count(value) * 0.99::DOUBLE)::INT + 1, count(value))] AS p99_latency_ms FROM r GROUP BY event_type)
SELECT *, avg_token_reduction >= 0.30 AS meets_token_reduction, avg_rouge_l >= 0.85 AS meets_rouge_l, p99_latency_ms <= 50.0 AS meets_latency FROM m""",
    "cluster_hits": f"""WITH RECURSIVE {_unified(_EMBEDDED, 0.30)},
o AS (SELECT label, cache_hit, row_number() OVER (PARTITION BY label ORDER BY k) AS r FROM uni JOIN embeddings ON vec_id = k)
SELECT label, count(*) AS variants, bool_or(NOT cache_hit) FILTER (WHERE r = 1) AS first_miss, count(*) FILTER (WHERE r > 1 AND cache_hit) AS subsequent_hits, count(*) FILTER (WHERE r > 1) AS subsequent_total FROM o GROUP BY label""",
    "cluster_hit_rate": f"""WITH RECURSIVE {_unified(_EMBEDDED, 0.30)},
o AS (SELECT label, cache_hit, row_number() OVER (PARTITION BY label ORDER BY k) AS r FROM uni JOIN embeddings ON vec_id = k),
c AS (SELECT label, count(*) FILTER (WHERE r > 1 AND cache_hit) AS h, count(*) FILTER (WHERE r > 1) AS n FROM o GROUP BY label)
SELECT sum(h) / sum(n)::DOUBLE AS subsequent_hit_rate, avg((n > 0 AND h = n)::INT) AS full_cluster_rate, sum(h) / sum(n)::DOUBLE >= 0.70 AS meets_goal FROM c""",
    "prefix_diversity": "SELECT lang, avg(k) AS unique_final_prompts_per_cluster FROM (SELECT lang, source, count(DISTINCT text) AS k FROM documents GROUP BY lang, source) GROUP BY lang",
    "mode_summary": """WITH r AS (SELECT event_type AS mode, (user_id % 10)::VARCHAR AS cluster, event_id % 2 + 1 AS run_index, props AS final_prompt, event_id % 3 = 0 AS hit, (event_id % 7 - 2) / 10.0::DOUBLE AS red, value AS ms, CASE WHEN event_id % 11 > 0 THEN value * 2 END AS back FROM events)
SELECT mode, count(*) AS total_requests, coalesce(avg(red) FILTER (WHERE red > 0), 0) AS avg_token_reduction, avg(hit::INT) AS unifier_hit_rate, avg(ms) AS avg_pipeline_ms, avg(back) AS avg_backend_ms,
  avg(back) FILTER (WHERE run_index = 2 AND back <> 0) AS avg_backend_run2_ms, avg(back) FILTER (WHERE run_index = 1 AND back <> 0) / avg(back) FILTER (WHERE run_index = 2 AND back <> 0) AS speedup_run2_vs_run1,
  any_value(d) AS unique_final_prompts_per_cluster
FROM r JOIN (SELECT mode, avg(k) AS d FROM (SELECT mode, cluster, count(DISTINCT final_prompt) AS k FROM r GROUP BY mode, cluster) GROUP BY mode) USING (mode) GROUP BY mode""",
    "baseline_comparison": """WITH m AS (SELECT CASE event_type WHEN 'click' THEN 'full' ELSE 'no_compression' END AS mode, avg((event_id % 3 = 0)::INT) AS unifier_hit_rate, count(*) AS total_requests FROM events GROUP BY 1),
d AS (SELECT * FROM (VALUES ('no_compression', 'ok', false, false), ('compression_only', 'ok', true, false), ('full', 'ok', true, true), ('external_compressor', 'unavailable', false, false), ('exact_cache_only', 'stub', false, false)) t(mode, status, enable_compression, enable_unification)),
b AS (SELECT coalesce(max(unifier_hit_rate) FILTER (WHERE mode = 'full'), 0) AS f, coalesce(max(unifier_hit_rate) FILTER (WHERE mode = 'compression_only'), 0) AS b FROM m)
SELECT d.*, unifier_hit_rate, total_requests, CASE WHEN b > 0 THEN f / b WHEN f > 0 THEN 'inf'::DOUBLE ELSE 1 END AS cache_hit_improvement FROM d LEFT JOIN m USING (mode), b""",
    "best_mode": "SELECT event_type, n, score FROM (SELECT event_type, count(*) AS n, round(avg(value), 9) AS score, min(event_id) AS o FROM events GROUP BY event_type) ORDER BY score DESC, o LIMIT 1",
    "share_above": "SELECT event_type, avg((value >= 50)::INT) AS share FROM events GROUP BY event_type",
    "result_roll_up": """WITH s AS (SELECT user_id::VARCHAR AS source, event_type AS mode, avg(value) AS a, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
SELECT source, 0.4::DOUBLE AS compression_ratio, mode, 'ok' AS status, a AS avg_token_reduction, NULL::DOUBLE AS avg_rouge_l, NULL::DOUBLE AS p99_latency_ms, NULL::DOUBLE AS unifier_hit_rate, n AS total_requests FROM s""",
    "derived_metrics": "WITH s AS (SELECT avg(value) FILTER (WHERE event_id % 2 = 0) AS a FROM events GROUP BY user_id, event_type) SELECT count(*) AS benchmark_runs, coalesce(sum(a), 0) / greatest(1, count(a)) AS avg_token_reduction, 0::DOUBLE AS avg_unifier_hit_rate FROM s",
    "summary_table": """SELECT 'benchmark' AS row_type, event_type AS mode, avg(value) AS avg_token_reduction, NULL::DOUBLE AS tau, NULL::BIGINT AS total_prompts FROM events GROUP BY event_type
UNION ALL SELECT 'tau_sweep', NULL, NULL, (label / 10.0)::DOUBLE, count(*) FROM embeddings GROUP BY label""",
    "paraphrases": f"WITH {PARAPHRASES} SELECT item_id, transform, text FROM made",
    "expanded_clusters": f"""WITH {PARAPHRASES},
every AS (SELECT item_id, 0 AS turn, x AS text FROM b WHERE x <> '' UNION ALL SELECT item_id, list_position(['{"', '".join(generate.TRANSFORMS)}'], transform), text FROM made),
first AS (SELECT item_id % 5 AS cluster_id, turn, item_id, text, row_number() OVER (PARTITION BY item_id % 5, regexp_replace(text, '\\s+', ' ', 'g') ORDER BY turn, item_id, text) AS r FROM every),
nth AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY turn, item_id) - 1 AS variant_id, text FROM first WHERE r = 1)
SELECT * FROM nth WHERE variant_id < 40""",
    "invented_paraphrases": f"""WITH n AS (SELECT id, id % 50 AS c, id // 50 AS v FROM (SELECT unnest(range(500)) AS id)),
w AS (SELECT id, c, v, {_listed(generate.VERBS)}[c % {len(generate.VERBS)} + 1] AS verb, {_listed(generate.OPENINGS)}[v % {len(generate.OPENINGS)} + 1] AS opening,
  {_listed(generate.TOPICS)}[(c // {len(generate.VERBS)} + c) % {len(generate.TOPICS)} + 1] AS topic, {_listed(generate.FORMS)}[c % {len(generate.FORMS)} + 1] AS form FROM n),
t AS (SELECT id, lower(verb) AS category, c + 1 AS cluster_id, v AS variant_id,
  opening || CASE WHEN opening = '' THEN verb ELSE lower(verb) END || ' ' || topic || ' as ' || form || CASE WHEN v >= {len(generate.OPENINGS)} THEN ', part ' || v ELSE '' END || '.' AS text FROM w),
s AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY len(string_split(text, ' ')), variant_id, text) AS r FROM t)
SELECT s.id, s.category, s.cluster_id, s.variant_id, s.text, s.variant_id = f.variant_id AS is_canonical, f.text AS canonical FROM s JOIN s f ON f.cluster_id = s.cluster_id AND f.r = 1""",
    "experiment_modes": f"""{_EXPERIMENT}
SELECT 'raw' AS mode, count(*) AS total_requests, 0::DOUBLE AS unifier_hit_rate, 0::DOUBLE AS avg_token_reduction, count(DISTINCT text) AS final_prompts FROM runs
UNION ALL SELECT 'compress_only', count(*), 0, coalesce(avg(red) FILTER (WHERE red > 0), 0), count(DISTINCT compressed) FROM res
UNION ALL SELECT 'full', count(*), avg(cache_hit::INT), coalesce(avg(red) FILTER (WHERE red > 0), 0), count(DISTINCT c.compressed) FROM res JOIN uni ON uni.k = res.doc_id JOIN result c ON c.doc_id = uni.leader""",
    "percentiles_of_all": f"SELECT p, {_NEAREST} AS value FROM events, (SELECT unnest([0.0, 0.5, 0.9, 1.0])::DOUBLE AS p) WHERE value IS NOT NULL GROUP BY p",
    "all_user_prompts": "SELECT conv_id, trim(text, E' \\n\\t\\r') AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user' AND trim(coalesce(text, ''), E' \\n\\t\\r') <> '') WHERE r = 1",
    "whole_bundle": """WITH a AS (SELECT 0 AS s, item_id AS o, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark),
d AS (SELECT text, s, o FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s, o) AS r FROM a) WHERE r = 1)
SELECT row_number() OVER (ORDER BY s, o) - 1 AS ord, text FROM d""",
    "workload_cross": "SELECT d.source AS cluster, b.item_id AS paraphrase_index, d.text || E'\\n\\nTask: ' || b.text AS text FROM (SELECT source, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1) d JOIN benchmark b ON 'src' || (b.item_id % 20)::VARCHAR = d.source",
    "prompt_bundle": """WITH a AS (SELECT 0 AS s, item_id AS o, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark),
d AS (SELECT text, s, o FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s, o) AS r FROM a) WHERE r = 1)
SELECT row_number() OVER (ORDER BY s, o) - 1 AS ord, text FROM d ORDER BY s, o LIMIT 500""",
    "unstemmed_overlap": """WITH w AS (SELECT doc_id, lang, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
f AS (SELECT lang, w AS f FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM w) WHERE r = 1)
SELECT doc_id, CASE WHEN len(w) = 0 OR len(f) = 0 THEN 0 ELSE len(list_intersect(w, f)) / (len(w) + len(f) - len(list_intersect(w, f)))::DOUBLE END AS overlap FROM w JOIN f USING (lang)""",
    "line_file_prompts": """WITH l AS (SELECT doc_id, pl, trim(parts[pl], E' \\n\\t\\r') AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pl FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\\n') AS parts FROM documents)))
SELECT row_number() OVER (ORDER BY doc_id, pl) - 1 AS ord, text FROM l WHERE text <> ''""",
    "json_file_prompts": """WITH i AS (SELECT item_id, CASE WHEN item_id % 3 <> 1 THEN text END AS p, CASE WHEN item_id % 3 <> 0 THEN 't ' || text END AS t, CASE WHEN item_id % 3 = 2 THEN item_id END AS c, row_number() OVER (ORDER BY item_id) - 1 AS ord FROM benchmark),
n AS (SELECT c, row_number() OVER (ORDER BY item_id) - 1 AS ord, trim(coalesce(t, p), E' \\n\\t\\r') AS text FROM i WHERE trim(coalesce(t, p, ''), E' \\n\\t\\r') <> '')
SELECT ord, coalesce(p, t, '') AS text, coalesce(c, ord) AS cluster_id, 'prompt' AS by FROM i UNION ALL SELECT ord, text, coalesce(c, ord), 'text' FROM n""",
    "cluster_file_prompts": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, text, row_number() OVER (ORDER BY item_id) - 1 AS cluster_id FROM benchmark",
    "workload_file": "SELECT 'c' || (item_id // 10) AS cluster, row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) - 1 AS paraphrase_index, text FROM benchmark",
    "paraphrase_file": "SELECT item_id // 10 AS cluster_id, 'k' AS category, row_number() OVER (PARTITION BY item_id // 10 ORDER BY CASE WHEN item_id % 10 > 2 THEN 10 - item_id % 10 ELSE 0 END, item_id) - 1 AS place, text FROM benchmark",
    "mixed_file_prompts": """WITH m AS (SELECT 0 AS f, item_id, 0 AS pl, trim(text, E' \\n\\t\\r') AS text FROM benchmark
UNION ALL SELECT 1, item_id, pl, trim(string_split(text, E'\\n')[pl], E' \\n\\t\\r') FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS pl FROM benchmark))
SELECT row_number() OVER (ORDER BY f, item_id, pl) - 1 AS ord, text FROM m WHERE text <> ''""",
    "inventory_round_trip": f"WITH RECURSIVE {_unified(_EMBEDDED, 0.30)} SELECT canonical_id, 'label ' || label AS text, vec_id::INT AS token_count, len(embedding) AS dims FROM uni JOIN embeddings ON vec_id = k WHERE NOT cache_hit",
    "shorter_canonicals": """WITH t AS (SELECT source, doc_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS b FROM t)
SELECT x.source AS canonical_id, CASE WHEN y.n < x.n THEN y.text ELSE x.text END AS text, least(x.n, y.n) AS token_count FROM r x JOIN r y ON x.source = y.source AND x.a = 1 AND y.b = 1""",
    "appended_log": "SELECT event_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN props END AS props FROM events",
    "unify_only": f"""WITH RECURSIVE raw AS (SELECT doc_id, coalesce(text, '') AS compressed FROM documents), {_unified(_vectors('raw'), 0.95)}
SELECT r.doc_id, c.compressed AS final_prompt, len(list_filter(string_split_regex(r.compressed, '\\s+'), lambda x: x <> '')) AS compressed_tokens, cache_hit, canonical_id
FROM raw r JOIN uni ON uni.k = r.doc_id JOIN raw c ON c.doc_id = uni.leader""",
    "compress_only": f"{COMPRESS} SELECT doc_id, compressed AS final_prompt, compressed_tokens, false AS cache_hit, NULL::BIGINT AS canonical_id FROM result",
    "streamed_log": "SELECT event_id, event_type, value FROM events",
}
# The same results by another way: from files or streams.
ORACLES |= {"report_file": ORACLES["service_stats"], "streamed_stats": ORACLES["service_stats"], "streamed_unify": ORACLES["unify_prompts"], "streamed_search": ORACLES["nearest_canonical"]}

#: Sums of doubles depend on their order in the last digits: these columns are compared to six digits.
ROUNDED = {
    "compress": ["token_reduction"],
    "compression_sweep": ["avg_token_reduction", "min_token_reduction", "max_token_reduction"],
    "segment_scores": ["score"],
    "segment_diagnostics": ["score"],
    "nearest_canonical": ["similarity"],
    "unify_prompts": ["similarity"],
    "unify_in_rounds": ["similarity"],
    "unify_from_inventory": ["similarity"],
    "tau_sweep": ["cache_hit_rate", "cluster_purity"],
    "pipeline_process": ["similarity", "token_reduction"],
    "cluster_overlap": ["mean_overlap", "max_overlap"],
    "request_log": ["token_reduction"],
    "service_stats": ["unifier_hit_rate", "avg_pipeline_ms"],
    "request_summary": ["avg_token_reduction", "avg_rouge_l", "unifier_hit_rate"],
    "cluster_hit_rate": ["subsequent_hit_rate", "full_cluster_rate"],
    "prefix_diversity": ["unique_final_prompts_per_cluster"],
    "mode_summary": ["avg_token_reduction", "unifier_hit_rate", "avg_pipeline_ms", "avg_backend_ms", "avg_backend_run2_ms", "speedup_run2_vs_run1", "unique_final_prompts_per_cluster"],
    "baseline_comparison": ["unifier_hit_rate"],
    "experiment_modes": ["unifier_hit_rate", "avg_token_reduction"],
    "best_mode": ["score"],
    "share_above": ["share"],
    "result_roll_up": ["avg_token_reduction"],
    "derived_metrics": ["avg_token_reduction"],
    "summary_table": ["avg_token_reduction"],
    "unstemmed_overlap": ["overlap"],
    "report_file": ["unifier_hit_rate", "avg_pipeline_ms"],
    "streamed_stats": ["unifier_hit_rate", "avg_pipeline_ms"],
    "streamed_unify": ["similarity"],
    "streamed_search": ["similarity"],
}
ORACLES = {n: q if n not in ROUNDED else "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED[n]) + f") FROM ({q})" for n, q in ORACLES.items()}
