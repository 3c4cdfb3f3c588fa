"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import op01_mixing, op05_sharding, op09_rules, op11_rope_infill

W = r"[^\x20\x09-\x0D]+"


def mix_sql() -> str:
    weights, total, most = list(op01_mixing.WEIGHTS), op01_mixing.TOTAL, op01_mixing.MOST
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ({weights})[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(weights)} + 1)::INT] AS w FROM sizes),
levels AS (SELECT *, (source_size * {most})::DOUBLE / w AS full_at FROM weighed),
before AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS w_left, coalesce(sum(source_size) OVER p, 0) AS size_before, sum(source_size) OVER () AS all_size
           FROM levels WINDOW p AS (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT *, (all_size * {total}::DOUBLE - size_before * {most}) / w_left AS share FROM before),
common AS (SELECT max(share) AS c FROM shares WHERE share <= full_at),
plan AS (SELECT source, source_size, least(source_size * {float(most)}::DOUBLE, w * coalesce(c, 'inf'::DOUBLE)) AS target FROM shares, common),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan),
hist AS (SELECT source, size, count(*) AS n, floor(sqrt(size::DOUBLE) * 1000)::BIGINT AS z FROM sized WHERE size > 0 GROUP BY ALL),
tried AS (SELECT h.source, size, z, target - whole * source_size AS rest, (target - whole * source_size - larger) / open AS factor FROM
  (SELECT *, coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS larger,
   (sum(n * size * z) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open FROM hist) h
  JOIN rests r ON h.source IS NOT DISTINCT FROM r.source),
factors AS (SELECT source, max_by(factor, size) AS factor FROM tried WHERE rest > 0 AND factor * z < 1 GROUP BY source),
drawn AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}::DOUBLE AS u FROM sized),
included AS (SELECT s.*, source_size, target, whole, target - whole * source_size AS rest, CASE WHEN size > 0 THEN least(1.0::DOUBLE, factor * floor(sqrt(size::DOUBLE) * 1000)::BIGINT) END AS inclusion
  FROM drawn s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN factors f ON s.source IS NOT DISTINCT FROM f.source),
ranked AS (SELECT *, CASE WHEN inclusion >= 1 THEN 0.0::DOUBLE WHEN inclusion > 0 THEN u / (1.0::DOUBLE - u) / (inclusion / (1.0::DOUBLE - inclusion)) END AS rank FROM included),
placed AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS so_far FROM ranked WINDOW o AS (PARTITION BY source ORDER BY rank IS NULL, rank, doc_id NULLS FIRST, size)),
fitted AS (SELECT *, rank IS NOT NULL AND rest > 0 AS sampled, so_far <= rest AND so_far + size > rest AS over_, so_far + size <= rest AS fits FROM placed),
gaps AS (SELECT source, any_value(rest - so_far) AS gap, any_value(size) AS over_size FROM fitted WHERE sampled AND over_ GROUP BY source),
later AS (SELECT f.*, gap, over_size, sampled AND NOT fits AND NOT over_ AND size <= gap AS small FROM fitted f LEFT JOIN gaps g ON f.source IS NOT DISTINCT FROM g.source),
refilled AS (SELECT *, coalesce(sum(CASE WHEN small THEN size END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS again FROM later WINDOW o AS (PARTITION BY source ORDER BY rank IS NULL, rank, doc_id NULLS FIRST, size)),
refits AS (SELECT *, coalesce(small AND again + size / 2.0::DOUBLE <= gap, false) AS refit FROM refilled),
nearer AS (SELECT *, abs(gap - coalesce(sum(CASE WHEN refit THEN size END) OVER (PARTITION BY source), 0)) < CASE WHEN over_size / 2.0::DOUBLE <= gap THEN over_size - gap ELSE gap END AS fill FROM refits)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN sampled AND (fits OR CASE WHEN fill THEN refit ELSE over_ AND size / 2.0::DOUBLE <= gap END) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM nearer"""


def rules_sql() -> str:
    stop = list(dict.fromkeys(f(w) for w in op09_rules.STOP_WORDS.split() for f in (str.lower, str.capitalize, str.upper)))
    verdict = " AND ".join(
        f"{r.measure} {sign} {bound}::DOUBLE" for r in op09_rules.RULES for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    )
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents),
spread AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM spread) WHERE n > 1),
spots AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n, 0) AS n_repeat_words,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{W}')) AS ls,
      len(list_filter(ws, lambda w: list_contains({stop}, w))) AS n_stop, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS n_letters, len(regexp_extract_all(text, '!')) AS n_bangs
      FROM t LEFT JOIN spots USING (rid)),
r AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, {ratio('word_chars', 'n_words')} AS mean_word_chars, {ratio('n_symbols', 'word_chars')} AS symbol_ratio,
      {ratio('n_stop', 'n_words')} AS stop_word_ratio, {ratio('(len(ls) - len(list_distinct(ls)))', 'len(ls)')} AS dup_line_ratio,
      {ratio('n_letters', 'word_chars')} AS letter_ratio, {ratio('n_bangs', 'n_words')} AS bang_ratio FROM m),
b AS (SELECT *, n_words < {op09_rules.MIN_WORDS} OR 100 * n_repeat_words > {op09_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept FROM b"""


def infill_sql() -> str:
    p, s, m = op11_rope_infill.PREFIX, op11_rope_infill.SUFFIX, op11_rope_infill.MIDDLE
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    held = " OR ".join(f"contains(text, '{x}')" for x in (p, s, m))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
      CASE WHEN text = '' OR {held} OR h3 % 100 >= {op11_rope_infill.CHANGED_PERCENT} THEN 'plain' WHEN h4 % 100 < {op11_rope_infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
d AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM d"""


def shard_sql() -> str:
    n = op05_sharding.SHARDS
    # CRC-32 by its table, a byte after the other.
    return f"""
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
raw AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(text)) AS h FROM documents),
single AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32 FROM raw, tab),
keyed AS (SELECT *, (coalesce(text_crc32, 0) << 31) + (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 1) AS key FROM single),
begun AS (SELECT *, (sum(size) OVER (ORDER BY key, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT - size AS at_byte, (sum(size) OVER ())::BIGINT AS total FROM keyed),
dealt AS (SELECT *, least(((2 * at_byte + size) * {n}) // (2 * total), {n - 1})::INT AS shard FROM begun)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY at_byte, key, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM dealt"""


ORACLE = {"op5_sampled_splitters": shard_sql(), "op1_pareto_mix": mix_sql(), "op9_quality_rules": rules_sql(), "op11_rope_infill_digests": infill_sql()}
