"""DuckDB SQL with the rows of the catalogue's queries."""

from __future__ import annotations

from ..functions import text as T
from ..operators.questions import ARTIFACTS, ASKERS, ATTRIBUTES, CONTROL, INFERENTIAL, INTENTS, MOST_HOOKS, PERSONAS, SHORT
from .catalog import BRANDS, PICKED, STAGES, THEMES


def _list(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w.replace(chr(39), chr(39) * 2)}')" for w in dict.fromkeys(words)) + ")"


TOKENS = f"list_filter(regexp_extract_all(lower(text), '{T.TOKEN}'), lambda t: length(t) > 2 AND NOT list_contains({_list(T.STOPWORDS)}, t))"

MENTIONS = f"""
runs AS (SELECT conv_id || '-' || turn AS run_id, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
brands AS (SELECT unnest({_list(BRANDS)}) AS brand, unnest(range({len(BRANDS)})) AS ord),
hits AS (SELECT run_id, text, brand, strpos(lower(text), brand) AS ix, row_number() OVER (PARTITION BY run_id ORDER BY strpos(lower(text), brand), ord) AS position
         FROM runs JOIN brands ON strpos(lower(text), brand) > 0),
around AS (SELECT run_id, brand, position, substring(text, greatest(1, ix - {T.RADIUS}), ix + length(brand) + {T.RADIUS} - greatest(1, ix - {T.RADIUS})) AS context FROM hits),
roles AS (SELECT *, CASE WHEN {_any('lower(context)', T.DISCARD)} THEN 'discarded' WHEN {_any('lower(context)', T.COMPARISON)} THEN 'compared'
          WHEN position = 1 THEN 'recommended_first' ELSE 'mentioned' END AS role FROM around),
mentions AS (SELECT run_id, brand, position, role, CASE WHEN role = 'discarded' THEN 'negative'
             WHEN {_any('lower(context)', T.POSITIVE)} AND NOT {_any('lower(context)', T.NEGATIVE)} THEN 'positive'
             WHEN {_any('lower(context)', T.NEGATIVE)} AND NOT {_any('lower(context)', T.POSITIVE)} THEN 'negative' ELSE 'neutral' END AS sentiment, context FROM roles)
"""

ORDERS = """
firsts AS (SELECT l_orderkey AS run_id, p_brand AS brand, min({'n': l_linenumber, 'f': l_returnflag}) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
mentions AS (SELECT run_id, brand, row_number() OVER (PARTITION BY run_id ORDER BY m.n, brand) AS position,
             CASE m.f WHEN 'N' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END::DOUBLE AS value FROM firsts)
"""


def _metrics(total: str, brands: str) -> str:
    return f"""
stats AS (SELECT brand, count(*) AS n, avg(position) AS position, avg(value) AS mood, count(*) FILTER (position = 1) AS first FROM valued GROUP BY brand),
own AS (SELECT b.brand, coalesce(n, 0) AS n, position, coalesce(mood, 0.0) AS mood, coalesce(first, 0) AS first,
        coalesce(n, 0)::DOUBLE / ({total}) AS sov FROM ({brands}) b LEFT JOIN stats USING (brand)),
others AS (SELECT a.brand, (SELECT avg(o.sov) FROM own o WHERE o.brand <> a.brand) AS rest FROM own a)
SELECT brand, round(sov, 6) AS share_of_voice, round(sov / coalesce(nullif(rest, 0), nullif(1.0::DOUBLE / ({total}), 0), 1.0), 6) AS relative_share_of_voice,
       round(position, 6) AS average_position, round(first::DOUBLE / ({total}), 6) AS first_mention_rate, round(mood::DOUBLE, 6) AS sentiment_score, n AS mention_count
FROM own JOIN others USING (brand)"""


def cloud(site: str) -> str:
    return f"""
pages_ AS (SELECT {site} AS site, doc_id AS page, coalesce(text, '') AS text FROM documents),
counts AS (SELECT site, page, term, count(*) AS tf FROM (SELECT site, page, unnest({TOKENS}) AS term FROM pages_) GROUP BY ALL),
sizes AS (SELECT site, count(*) AS n_pages FROM pages_ GROUP BY site),
terms AS (SELECT site, term, count(*) AS document_frequency, sum(tf)::BIGINT AS occurrences FROM counts GROUP BY ALL),
cloud AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, term) AS rank FROM
          (SELECT site, term, round((ln((n_pages + 1)::DOUBLE / (document_frequency + 1)) + 1) * occurrences, 6) AS score, document_frequency, occurrences FROM terms JOIN sizes USING (site)))
"""


PATH = "(CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) END)"
KIND = f"""CASE WHEN regexp_matches({PATH}, '(?i)^/?(index\\.html)?$') THEN 'home' WHEN regexp_matches({PATH}, '(?i)pricing|precios|planes') THEN 'pricing'
 WHEN regexp_matches({PATH}, '(?i)/blog(/|$)') THEN 'blog' WHEN regexp_matches({PATH}, '(?i)/(docs|documentation|help|guide|guides)(/|$)') THEN 'docs' ELSE 'other' END"""
LOCAL = f"(regexp_extract({PATH}, '(?i)^/([a-z]{{2}}(?:-[a-z]{{2,4}})?)(?:/|$)', 1) <> '' AND NOT starts_with(lower(regexp_extract({PATH}, '(?i)^/([a-z]{{2}}(?:-[a-z]{{2,4}})?)(?:/|$)', 1)), 'en'))"
_WORDS = "+".join(f"len(regexp_extract_all(lower(text), '\\b{w}\\b'))" for w in T.PROMOTIONAL)
_NUM = r"len(regexp_extract_all(text, '\b\d+(?:[.,]\d+)?%?\b'))"
_CMP = r"len(regexp_extract_all(text, '(?i)\b(vs\.?|versus|compared to|faster than|better than|more than|less than|frente a|comparado con)\b'))"
_THEMES = " UNION ALL ".join(f"SELECT '{t}' AS theme, unnest({_list(ks.split())}) AS term" for t, ks in THEMES.items())

_CLUSTERED = f"""WITH {cloud("'all'")}, taxonomy AS ({_THEMES}),
clustered AS (SELECT theme, term, score FROM cloud LEFT JOIN taxonomy USING (term) WHERE rank <= 50)"""
_STATS = f""", answers AS (SELECT conv_id || '-' || turn AS run_id, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
toks AS (SELECT DISTINCT run_id, unnest({TOKENS}) AS term FROM answers),
told AS (SELECT theme, count(DISTINCT run_id) AS n FROM toks JOIN clustered USING (term) WHERE theme IS NOT NULL GROUP BY theme)"""

ORACLE: dict[str, str] = {
    "mentions_text": f"WITH {MENTIONS} SELECT * FROM mentions",
    "brand_metrics_text": f"WITH {MENTIONS}, valued AS (SELECT *, CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE AS value FROM mentions), "
    + _metrics("SELECT count(*) FROM runs", "SELECT brand FROM brands"),
    "brand_metrics_orders": f"WITH {ORDERS}, valued AS (SELECT * FROM mentions), " + _metrics("SELECT count(*) FROM orders", "SELECT DISTINCT p_brand AS brand FROM part"),
    "brand_cooccurrence": f'WITH {ORDERS} SELECT a.brand, b.brand AS other_brand, count(*) AS "count" FROM mentions a JOIN mentions b ON a.run_id = b.run_id AND a.brand <> b.brand GROUP BY ALL',
    "sov_by_dimension": f"""WITH {ORDERS},
flat AS (SELECT o_orderkey AS run_id, unnest(['status','priority','year']) AS dimension, unnest([o_orderstatus, o_orderpriority, year(o_orderdate)::VARCHAR]) AS value FROM orders),
totals AS (SELECT dimension, value, count(*) AS run_count FROM flat WHERE value IS NOT NULL GROUP BY ALL),
hits AS (SELECT f.dimension, f.value, m.brand, count(*) AS n FROM flat f JOIN mentions m USING (run_id) GROUP BY ALL)
SELECT dimension, value, brand, round(coalesce(n, 0)::DOUBLE / run_count, 6) AS share_of_voice, run_count
FROM totals CROSS JOIN (SELECT DISTINCT p_brand AS brand FROM part) LEFT JOIN hits USING (dimension, value, brand)""",
    "tagcloud_site": f"WITH {cloud('source')} SELECT site, rank, term, score, document_frequency, occurrences FROM cloud WHERE rank <= 50",
    "tagcloud_page": f"""WITH {cloud('source')} SELECT page, rank, term, score FROM
(SELECT page, term, score, row_number() OVER (PARTITION BY site, page ORDER BY score DESC, term) AS rank FROM
 (SELECT c.site, c.page, c.term, round((ln((n_pages + 1)::DOUBLE / (document_frequency + 1)) + 1) * tf, 6) AS score FROM counts c JOIN terms USING (site, term) JOIN sizes USING (site))) WHERE rank <= 10""",
    "keyword_density": f"""WITH {cloud('source')}, totals AS (SELECT page, sum(tf) AS total FROM counts GROUP BY page)
SELECT page, rank, term, n AS "count", round(n::DOUBLE / total, 6) AS density FROM
(SELECT page, term, tf AS n, row_number() OVER (PARTITION BY page ORDER BY tf DESC, term) AS rank FROM counts) JOIN totals USING (page) WHERE rank <= 10""",
    "geo_text_signals": f"""SELECT doc_id, n AS numbers, c AS comparatives, p AS promotional, round(CASE WHEN n + c + p > 0 THEN (n + c)::DOUBLE / (n + c + p) ELSE 0 END, 6) AS factual_density FROM
(SELECT doc_id, {_NUM} AS n, {_CMP} AS c, ({_WORDS})::BIGINT AS p FROM documents WHERE text IS NOT NULL)""",
    "page_index": f"SELECT page_id, url, substring(sha1(url), 1, 16) AS url_hash, {KIND} AS page_type, {LOCAL} AS localized FROM pages",
    "robots_filter": f"""SELECT page_id, url, CASE WHEN starts_with({PATH}, '/de/blog') THEN true WHEN starts_with({PATH}, '/de') OR starts_with({PATH}, '/fr') THEN false ELSE true END AS allowed FROM pages""",
    "quick_url_selection": f"""WITH m AS (SELECT page_id AS ord, url, page_id % 10 / 10.0::DOUBLE AS priority, {KIND} AS kind, {LOCAL} AS local FROM pages),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY local, ord) AS place FROM m),
s AS (SELECT *, CASE WHEN kind = 'home' AND place <= 1 THEN 0 WHEN kind = 'pricing' AND place <= 2 THEN 1 WHEN kind = 'docs' AND place <= 2 THEN 2 WHEN kind = 'blog' AND place <= 2 THEN 3 ELSE 4 END AS stage FROM p),
k AS (SELECT *, CASE WHEN stage = 4 THEN -priority ELSE 0 END AS w FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY stage, local, w, ord) AS again FROM k)
SELECT url, pick FROM (SELECT url, row_number() OVER (ORDER BY stage, local, w, ord) AS pick FROM o WHERE again = 1) WHERE pick <= 15""",
    "html_tag_counts": r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[\s>]')) AS h1_count, len(regexp_extract_all(html, '(?i)<(?:ul|ol)[\s>]')) AS lists,
len(regexp_extract_all(html, '(?i)<table[\s>]')) AS tables, len(regexp_extract_all(html, '(?i)<img[\s>]')) AS images_total FROM pages""",
    "geo_aeo_gaps": f"WITH {MENTIONS}, {cloud(chr(39) + 'all' + chr(39))}, vocab AS (SELECT DISTINCT unnest({TOKENS.replace('text', 'context')}) AS term FROM mentions WHERE brand = '{BRANDS[2]}') "
    "SELECT term, score AS site_score, term IN (SELECT term FROM vocab) AS mentioned_by_model FROM cloud WHERE rank <= 30",
    "theme_clusters": _CLUSTERED + " SELECT * FROM clustered",
    "theme_answer_stats": _CLUSTERED + _STATS + f""", spots AS (SELECT theme, run_id, min({{'ix': strpos(lower(a.text), term), 'term': term}}) AS m, any_value(a.text) AS text
 FROM toks JOIN clustered USING (term) JOIN answers a USING (run_id) WHERE theme IS NOT NULL GROUP BY theme, run_id),
seen AS (SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY run_id) AS k,
 trim(regexp_replace(substring(text, greatest(1, m.ix - {T.RADIUS}), m.ix + length(m.term) + {T.RADIUS} - greatest(1, m.ix - {T.RADIUS})), '\\s+', ' ', 'g')) AS c FROM spots),
shown AS (SELECT theme, string_agg(c, ' | ' ORDER BY k) AS contexts FROM seen WHERE k <= 3 GROUP BY theme)
SELECT theme, (SELECT count(*) FROM answers) AS runs_scanned, coalesce(n, 0) AS runs_mentioning, contexts
FROM (SELECT DISTINCT theme FROM clustered WHERE theme IS NOT NULL) LEFT JOIN told USING (theme) LEFT JOIN shown USING (theme)""",
    "prompt_run_groups": """SELECT conv_id, prompt, coalesce(n, 0) AS n_runs FROM
(SELECT conv_id, min_by(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id)
LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id) USING (conv_id)""",
    "question_quota": """SELECT *, least(n_inferential, quota - hooks) AS inferential FROM (SELECT *, least(n_hooks, greatest((quota + 1) // 2, quota - n_inferential)) AS hooks FROM
(SELECT source, count(*) // 2 AS quota, count(*) FILTER (doc_id % 2 = 0) AS n_hooks, count(*) FILTER (doc_id % 6 = 1) AS n_inferential FROM documents GROUP BY source))""",
    "labels_quality_split": """SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
}

ORACLE["phrase_cloud"] = f"""WITH {cloud('source')},
cut AS (SELECT site, page, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM pages_),
lines AS (SELECT site, page, unnest(ss) AS line, unnest(range(len(ss))) AS sentence FROM cut),
top AS (SELECT site, term FROM cloud WHERE rank <= 30),
hits AS (SELECT lines.site, term, page, line, row_number() OVER (PARTITION BY lines.site, term ORDER BY page, sentence) AS pos FROM lines JOIN top ON lines.site = top.site AND contains(lower(line), term)
         WHERE regexp_matches(line, '(?i)\\b' || term || '\\b'))
SELECT site, term, pos, page, CASE WHEN length(line) > {T.SNIPPET} THEN substring(line, 1, {T.SNIPPET}) || '…' ELSE line END AS snippet FROM hits WHERE pos <= 5"""

_SHORT = " UNION ALL ".join(f"SELECT {i} AS t, '{a}' AS template_id, '{p}' AS pattern" for i, (a, p) in enumerate(SHORT))
ORACLE["hook_question_set"] = f"""WITH {cloud('source')}, templates AS ({_SHORT}),
numbered AS (SELECT term AS hook, template_id, pattern, row_number() OVER (ORDER BY site, rank, t) - 1 AS n FROM cloud CROSS JOIN templates WHERE rank <= 50)
SELECT n AS ord, template_id || '-' || n AS id, replace(replace(pattern, '{{persona}}', ({_list(ASKERS)})[(n % 4 + 1)::INT]), '{{hook}}', hook) AS text, template_id, hook, 'tagcloud' AS hook_source FROM numbered"""
ORACLE["hook_question_set_full"] = f"""WITH {cloud('source')}, templates AS ({_SHORT}),
good AS (SELECT site, rank, term, row_number() OVER (PARTITION BY site ORDER BY rank) AS place FROM cloud
         WHERE rank <= 50 AND document_frequency >= 2 AND length(term) >= 4 AND NOT list_contains({_list(ARTIFACTS)}, term)),
numbered AS (SELECT term AS hook, template_id, pattern, row_number() OVER (ORDER BY site, rank, t) - 1 AS n FROM good CROSS JOIN templates WHERE place <= {MOST_HOOKS})
SELECT n AS ord, template_id || '-' || n AS id, replace(replace(pattern, '{{persona}}', ({_list(ASKERS)})[(n % 4 + 1)::INT]), '{{hook}}', hook) AS text, template_id, hook, 'tagcloud' AS hook_source FROM numbered"""

_HOPS = f"""wanted AS (SELECT DISTINCT theme, true AS q FROM said JOIN clustered USING (term) WHERE theme IS NOT NULL),
per AS (SELECT theme, count(*) AS v, CASE WHEN coalesce(bool_or(q), false) THEN 'asked' ELSE 'not asked' END AS q,
CASE WHEN coalesce(max(n), 0) > 0 THEN 'mentioned' ELSE 'not mentioned' END AS m FROM clustered LEFT JOIN told USING (theme) LEFT JOIN wanted USING (theme) WHERE theme IS NOT NULL GROUP BY theme)
SELECT source, target, sum(v)::BIGINT AS value FROM (SELECT theme AS source, q AS target, v FROM per UNION ALL SELECT q, m, v FROM per) GROUP BY ALL"""
ORACLE["theme_sankey_asked"] = _CLUSTERED + _STATS + f", said AS (SELECT unnest({TOKENS}) AS term FROM conversations WHERE role = 'user'), {_HOPS}"
ORACLE["theme_sankey_edges"] = _CLUSTERED + _STATS + f", said AS (SELECT unnest({TOKENS}) AS term FROM ({ORACLE['hook_question_set_full']})), {_HOPS}"

ORACLE["theme_treemap"] = _CLUSTERED + " SELECT theme, round(greatest(1.0::DOUBLE, sum(score)), 6) AS size, count(*) AS n_terms FROM clustered WHERE theme IS NOT NULL GROUP BY theme"
ORACLE["cluster_totals"] = _CLUSTERED + " SELECT count(DISTINCT theme) AS n_themes, count(*) FILTER (theme IS NULL) AS n_unclustered FROM clustered"
ORACLE["theme_questions"] = _CLUSTERED + f""", said AS (SELECT conv_id || '-' || turn AS id, unnest({TOKENS}) AS term FROM conversations WHERE role = 'user')
SELECT DISTINCT theme, id FROM said JOIN clustered USING (term) WHERE theme IS NOT NULL"""
ORACLE["brand_grounded_breakdown"] = f"""WITH {MENTIONS},
flat AS (SELECT run_id, unnest(['source', 'stage']) AS dimension, unnest([CASE WHEN conv_id % 2 = 0 THEN 'hook' ELSE 'inferential' END, CASE WHEN conv_id % 2 <> 0 THEN ({_list(STAGES)})[(conv_id % 3 + 1)::INT] END]) AS value
 FROM (SELECT conv_id || '-' || turn AS run_id, conv_id FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)),
totals AS (SELECT dimension, value, count(*) AS run_count FROM flat WHERE value IS NOT NULL GROUP BY ALL),
found AS (SELECT dimension, value, brand, count(*) AS n FROM flat JOIN mentions USING (run_id) GROUP BY ALL)
SELECT dimension, value, brand, round(coalesce(n, 0)::DOUBLE / run_count, 6) AS share_of_voice, run_count FROM totals CROSS JOIN (SELECT brand FROM brands) LEFT JOIN found USING (dimension, value, brand)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    cell = lambda v: _list(v) + "::VARCHAR[]" if isinstance(v, list) else _quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


_RIVALS = BRANDS[1:4]
_PAIRS = [(a, b) for i, a in enumerate(_RIVALS) for b in _RIVALS[i + 1 :]]
_INFERRED = f"""claims AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS claim, array_to_string(ws[1:4], ' ') AS problem, CASE WHEN item_id % 2 = 1 THEN ws[5:5] ELSE []::VARCHAR[] END AS audience
 FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM benchmark)), patterns AS (SELECT * FROM {_values([(i, *r[:4]) for i, r in enumerate(INFERENTIAL)])} p(t, template_id, stage, pattern, wants)),
inferred_ AS (SELECT *, row_number() OVER (ORDER BY claim, t) - 1 AS n FROM claims JOIN patterns ON wants = 'any' OR (wants = 'with') = (len(audience) > 0)),
inferred AS (SELECT n AS ord, template_id || '-' || n AS id, replace(replace(replace(replace(replace(pattern, '{{persona}}', ({_list(ASKERS)})[(n % 4 + 1)::INT]), '{{problem}}', problem), '{{audience}}', coalesce(audience[1], '')),
 '{{competitorA}}', ({_list([a for a, _ in _PAIRS])})[(claim % {len(_PAIRS)} + 1)::INT]), '{{competitorB}}', ({_list([b for _, b in _PAIRS])})[(claim % {len(_PAIRS)} + 1)::INT]) AS text, template_id, stage, problem FROM inferred_)"""
ORACLE["inferential_question_set"] = f"WITH {_INFERRED} SELECT * FROM inferred"
ORACLE["question_prompts"] = f"""WITH hooked AS ({ORACLE["hook_question_set_full"]}), {_INFERRED},
n AS (SELECT least((SELECT count(*) FROM hooked), greatest(20, 40 - (SELECT count(*) FROM inferred))) AS h),
q AS (SELECT h, least((SELECT count(*) FROM inferred), 40 - h) AS i FROM n)
SELECT ord, id, text, 'hook' AS source, template_id, NULL::VARCHAR AS stage FROM hooked, q WHERE ord < h
UNION ALL SELECT ord + h, id, text, 'inferential', template_id, stage FROM inferred, q WHERE ord < i"""

_HREFS = r"""hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
kinds AS (SELECT page_id, regexp_matches(href, '^[a-z]+://') AND regexp_extract(href, '://([^/?#:]+)', 1) <> regexp_extract(url, '://([^/?#:]+)', 1) AS outside, href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:)') AS counts FROM hrefs)"""
ORACLE["link_classification"] = f"""WITH {_HREFS},
said AS (SELECT page_id, count(*) FILTER (counts AND NOT outside) AS i, count(*) FILTER (counts AND outside) AS e FROM kinds GROUP BY page_id),
inside AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
cited AS (SELECT page_id, count(*) AS c FROM inside WHERE regexp_matches(href, '^(mailto|tel):') OR (regexp_matches(href, '^[a-z]+://') AND regexp_extract(href, '://([^/?#:]+)', 1) <> regexp_extract(url, '://([^/?#:]+)', 1)) GROUP BY page_id)
SELECT page_id, coalesce(i, 0) AS internal_links, coalesce(e, 0) AS external_links, coalesce(c, 0) AS outbound_citations FROM pages LEFT JOIN said USING (page_id) LEFT JOIN cited USING (page_id)"""
_SCORED = r"""scored AS (SELECT url, images, (CASE WHEN h1 = 1 THEN 100.0 ELSE 0.0 END + CASE WHEN described IS NULL THEN 0.0 WHEN length(described) >= 50 THEN 100.0 ELSE 50.0 END + CASE WHEN typed THEN 100.0 ELSE 0.0 END
 + CASE WHEN images = 0 THEN 100.0 ELSE floor(100.0 * (1 - missing::DOUBLE / images) + 0.5) END)::DOUBLE / 4 AS score, missing FROM
(SELECT url, len(regexp_extract_all(html, '(?i)<h1[\s>]')) AS h1, nullif(trim(regexp_extract(html, '(?i)<meta\s+name="description"\s+content="([^"]*)"', 1)), '') AS described,
 regexp_matches(html, '(?i)application/ld\+json|itemtype=') AS typed, len(regexp_extract_all(html, '(?i)<img[\s>]')) AS images,
 len(regexp_extract_all(html, '(?i)<img[\s>]')) - len(regexp_extract_all(html, '(?i)<img\s[^>]*alt="[^"]*[^"\s]')) AS missing FROM pages))"""
ORACLE["seo_page_scores"] = f"WITH {_SCORED} SELECT url, round(score, 6) AS score, CASE WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'needs_work' ELSE 'critical' END AS label FROM scored"
ORACLE["seo_site_scores"] = f"""WITH {_SCORED} SELECT kind, greatest(0, floor(avg(score) - least(30, 5 * any_value(coalesce(dead, 0))) + 0.5))::BIGINT AS score, sum(missing)::BIGINT AS missing_alt FROM (SELECT *, {KIND} AS kind FROM scored)
LEFT JOIN (SELECT {KIND} AS kind, count(*) AS dead FROM pages WHERE page_id % 11 = 0 OR page_id % 7 = 0 GROUP BY ALL) USING (kind) GROUP BY kind"""

_CRAWLED = f"""got AS (SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 13 = 0 THEN '' ELSE html END AS html FROM pages),
chosen AS ({ORACLE["quick_url_selection"]}),
states AS (SELECT 'fetched' AS state, url FROM got WHERE html <> '' AND coalesce(status, 0) < 400 UNION ALL SELECT 'broken', url FROM got WHERE status IS NULL OR status >= 400
 UNION ALL SELECT 'skipped', url FROM got WHERE url NOT IN (SELECT url FROM chosen))"""
ORACLE["crawl_url_lists"] = f"WITH {_CRAWLED} SELECT state, url FROM states"
ORACLE["crawl_coverage"] = f"""WITH {_CRAWLED} SELECT (SELECT count(*) FROM pages) AS total_urls, count(*) FILTER (state = 'fetched') AS fetched_urls,
count(*) FILTER (state = 'broken') AS broken_urls, count(*) FILTER (state = 'skipped') AS skipped_urls FROM states"""
ORACLE["sitemap_entries"] = """SELECT page_id // 10 AS ord, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS at, url AS loc,
CASE WHEN page_id % 3 > 0 THEN round((page_id % 10)::DOUBLE / 10, 6) END AS priority FROM pages"""
_CUT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
ORACLE["text_measures"] = rf"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, len(ss) AS sentences, len(regexp_extract_all(coalesce(ss[1], ''), '\S+')) > 6 AS long_first,
{_any("lower(coalesce(ss[1], ''))", BRANDS)} AS names_brand FROM (SELECT doc_id, text, {_CUT} AS ss FROM documents WHERE text IS NOT NULL)"""
ORACLE["cross_audit"] = f"""SELECT brand, value, row_number() OVER (ORDER BY value DESC, brand) AS place FROM (SELECT b.brand, coalesce(share_of_voice, 0) AS value FROM (SELECT unnest({_list(PICKED)}) AS brand) b
LEFT JOIN (SELECT brand, share_of_voice FROM ({ORACLE["sov_by_dimension"]}) WHERE dimension = 'status' AND value = 'F') USING (brand))"""
ORACLE["claims_of_answers"] = f"""WITH turns AS (SELECT conv_id * 1000 + turn AS ord, conv_id || '-' || turn AS url, {_CUT} AS ss FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
plain AS (SELECT ord, url, list_filter(list_transform(ss, lambda x: trim(regexp_replace(lower(x), '[^a-z]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM turns),
lines AS (SELECT ord, url, unnest(ls) AS line, unnest(range(len(ls))) AS nth FROM plain),
said AS (SELECT ord, nth, url, line, trim('reduce ' || regexp_replace(line || ' for product teams', '^(teams|team|you|us|people|users|companies|everyone)\\b\\s+', '')) AS problem FROM lines)
SELECT min_by(problem, {{'o': ord, 'a': nth}}) AS problem, 'product teams,product team' AS audience, count(DISTINCT {{'u': url, 's': line}}) AS evidence FROM said GROUP BY lower(problem)"""

# Prompts: one row for each number, its intent, persona and anchor turning with it.
_N, _ADV = 24, 4
_OWN = _N - _ADV


def _turn(values, at: str) -> str:
    return f"({_list(values)})[(({at}) % {len(values)} + 1)::INT]"


_FILLED = "pattern"
for _key, _value in (
    ("category", "'tracking ' || site"),
    ("persona", f"CASE WHEN en THEN {_turn([p[2] for p in PERSONAS], 'i')} ELSE {_turn([p[3] for p in PERSONAS], 'i')} END"),
    ("attribute", f"CASE WHEN en THEN {_turn([a[1] for a in ATTRIBUTES], 'i + i % 5')} ELSE {_turn([a[2] for a in ATTRIBUTES], 'i + i % 5')} END"),
    ("brandA", "first"),
    ("brandB", "rival"),
    ("brandC", "second"),
):
    _FILLED = f"replace({_FILLED}, '{{{_key}}}', {_value})"
ORACLE["prompt_set"] = f"""WITH {cloud('source')}, n AS (SELECT ord, ord < {_OWN} AS own, CASE WHEN ord < {_OWN} THEN ord ELSE ord - {_OWN} END AS i FROM range({_N}) r(ord)),
tops AS (SELECT site, min_by(term, rank) AS brand, list(term ORDER BY rank)[2:] AS rivals FROM cloud WHERE rank <= 5 GROUP BY site),
k AS (SELECT *, i % 2 = 0 AS en, CASE WHEN own THEN {_turn([r[0] for r in INTENTS], 'i')} ELSE '{CONTROL[0]}' END AS intent, all_[(i % len(all_) + 1)::INT] AS rival, all_[((i + 1) % len(all_) + 1)::INT] AS second
 FROM (SELECT *, CASE WHEN len(rivals) > 0 THEN rivals ELSE ['the competition'] END AS all_ FROM n CROSS JOIN tops)),
f AS (SELECT *, CASE WHEN intent = 'troubleshooting_replacement' AND en THEN rival ELSE brand END AS first,
 CASE WHEN own AND en THEN {_turn([r[2] for r in INTENTS], 'i')} WHEN own THEN {_turn([r[3] for r in INTENTS], 'i')} WHEN en THEN {_quoted(CONTROL[2])} ELSE {_quoted(CONTROL[3])} END AS pattern FROM k)
SELECT site, ord, intent || '-' || ord AS id, {_FILLED} AS text, intent, {_turn([p[0] for p in PERSONAS], 'i')} AS persona_role, {_turn([p[1] for p in PERSONAS], 'i')} AS team_size,
CASE WHEN own THEN {_turn([r[1] for r in INTENTS], 'i')} ELSE 'generic' END AS specificity, CASE WHEN own THEN {_turn([a[0] for a in ATTRIBUTES], 'i + i % 5')} ELSE 'none' END AS attribute,
CASE WHEN en THEN 'en' ELSE 'es' END AS language, CASE intent WHEN 'direct_comparison' THEN brand || '|' || rival WHEN 'troubleshooting_replacement' THEN first
 WHEN 'final_decision' THEN brand || '|' || rival || '|' || second ELSE '' END AS brands_named FROM f"""

# Pages: what a reader sees, by taking away what is hidden and then all tags.
_SEEN = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "nav", "header", "footer", "noscript", "template"):
    _SEEN = f"regexp_replace({_SEEN}, '(?is)<{_tag}[\\s>].*?</{_tag}>', '', 'g')"


def _plain(html: str) -> str:
    bare = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", chr(160)), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return bare


ORACLE["html_signals"] = f"""WITH {_HREFS}, said AS (SELECT page_id, count(*) FILTER (counts AND NOT outside) AS i, count(*) FILTER (counts AND outside) AS e FROM kinds GROUP BY page_id)
SELECT url, trim(regexp_replace({_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS h1_count,
coalesce(i, 0) AS internal_link_count, coalesce(e, 0) AS external_link_count, len(regexp_extract_all(html, '(?i)<img[\\s>]')) AS images_total, len(regexp_extract_all({_plain(_SEEN)}, '\\S+')) AS word_count
FROM pages LEFT JOIN said USING (page_id)"""

_RULES = (
    ("h1 = 0", "seo", "'Missing H1 on ' || url", "medium", "low", "Add a single, descriptive H1 heading to the page."),
    ("h1 > 1", "seo", "h1 || ' H1 tags on ' || url", "low", "low", "Keep exactly one H1 per page; demote the rest to H2/H3."),
    ("described IS NULL", "seo", "'Missing meta description on ' || url", "medium", "low", "Add a ~150-character meta description summarizing the page."),
    ("NOT typed", "seo", "'No schema.org markup on ' || url", "low", "medium", "Add JSON-LD structured data appropriate to the page type."),
    ("NOT defined", "geo", "'No self-contained \"what is this\" definition on ' || url", "high", "low", "Add a short, quotable definition near the top of the page."),
    ("density < 0.4", "geo", "'Low factual density on ' || url || ' (mostly promotional language)'", "medium", "medium", "Replace vague adjectives with concrete numbers/comparisons."),
    ("NOT signed AND NOT dated", "geo", "'No visible author or publish date on ' || url", "medium", "medium", "Add a visible byline and publish/update date."),
    ("blocks < 2", "geo", "'Little extractable structure on ' || url || ' (no lists/tables/definitions)'", "medium", "medium", "Break key content into lists, tables, or definition blocks."),
)
_FOUND = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {t} AS finding, '{i}' AS impact, '{e}' AS effort, {_quoted(a)} AS suggested_action FROM facts WHERE {w}" for w, d, t, i, e, a in _RULES)
_PARTS = "list_transform(string_split(html, '<p>')[2:4], lambda x: regexp_replace(x, '(?s)</p>.*', ''))"
_ARTICLE = r"'\b(is|are|es|son)\s+(a|an|the|el|la|los|las|un|una)\b'"
_FACTS = f"""WITH seen AS (SELECT page_id, url, html, trim(regexp_replace({_plain(_SEEN)}, '\\s+', ' ', 'g')) AS text FROM pages),
counted AS (SELECT *, {_NUM} + {_CMP} AS facts, ({_WORDS}) AS praise, len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS h1,
 nullif(trim(regexp_extract(html, '(?i)<meta\\s+name="description"\\s+content="([^"]*)"', 1)), '') AS described, regexp_matches(html, '(?i)application/ld\\+json|itemtype=') AS typed,
 len(list_filter({_PARTS}, lambda x: regexp_matches({_plain('x')}, '(?i)' || {_ARTICLE}))) > 0 AS shown, regexp_matches(text, '\\bby\\s+[A-Z][a-z]+\\s+[A-Z][a-z]+') OR regexp_matches(html, '(?i)rel="author"|class="[^"]*(author|byline)|<meta\\s+name="author"') AS signed,
 regexp_matches(html, '(?i)<time\\s[^>]*datetime|article:published_time|"datePublished"\\s*:') AS dated, len(regexp_extract_all(html, '(?i)<(?:ul|ol|table|dl)[\\s>]')) AS blocks FROM seen),
facts AS (SELECT *, CASE WHEN facts + praise > 0 THEN facts::DOUBLE / (facts + praise) ELSE 0 END AS density, coalesce(length(described) > 30, false) OR shown AS defined,
 least(1.0::DOUBLE, blocks::DOUBLE / 10) AS structure, regexp_matches(html, 'article:modified_time|"dateModified"\\s*:') AS updated FROM counted),
judged AS (SELECT *, (CASE WHEN defined THEN 100.0 ELSE 0.0 END + density * 100 + CASE WHEN signed THEN 33.0 ELSE 0.0 END + CASE WHEN dated THEN 33.0 ELSE 0.0 END + CASE WHEN updated THEN 34.0 ELSE 0.0 END + structure * 100)::DOUBLE / 4 AS score FROM facts)
"""
ORACLE["findings_priorities"] = _FACTS + _FOUND
ORACLE["geo_page_scores"] = _FACTS + """SELECT url, defined, round(density, 6) AS factual_density, signed AS has_author, dated AS has_publish_date, updated AS has_update_date, round(structure, 6) AS structure_score,
round(score, 6) AS score, CASE WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'needs_work' ELSE 'critical' END AS label FROM judged"""
ORACLE["geo_site_averages"] = _FACTS + """SELECT count(*) AS pages, round(avg(density), 6) AS factual_density, round(avg(structure), 6) AS structure_score, floor(avg(score) + 0.5)::BIGINT AS score FROM judged"""

_MEASURED = (
    f"WITH {MENTIONS}, valued AS (SELECT *, CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE AS value FROM mentions), measured AS (WITH "
    + _metrics("SELECT count(*) FROM runs", "SELECT brand FROM brands").strip()
    + f"), {cloud(chr(39) + 'all' + chr(39))}"
)
ORACLE["aeo_priorities"] = _MEASURED + f""", vocab AS (SELECT DISTINCT brand, unnest({TOKENS.replace('text', 'context')}) AS term FROM mentions),
missing AS (SELECT b.brand, term, score, row_number() OVER (PARTITION BY b.brand ORDER BY score DESC, term) AS k FROM brands b JOIN cloud ON rank <= 30 WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.brand = b.brand AND v.term = cloud.term)),
listed AS (SELECT brand, string_agg(term, ', ' ORDER BY k) AS terms FROM missing WHERE k <= 5 GROUP BY brand),
whole AS (SELECT m.*, (SELECT avg(o.share_of_voice) FROM measured o WHERE o.brand <> m.brand) AS rival, coalesce(terms, '') AS terms,
 floor(0.6::DOUBLE * share_of_voice * 100 + 0.4::DOUBLE * ((sentiment_score + 1) / 2 * 100) + 0.5)::BIGINT AS score FROM measured m LEFT JOIN listed USING (brand))
SELECT brand, 'aeo' AS dimension, brand || '''s Share of Voice (' || floor(share_of_voice * 100 + 0.5)::BIGINT || '%) is below the competitor average (' || floor(rival * 100 + 0.5)::BIGINT || '%)' AS finding, 'high' AS impact, 'high' AS effort,
 'Publish more citable, comparison-ready content (see GEO findings) to increase how often the model surfaces the brand.' AS suggested_action, score FROM whole WHERE share_of_voice < rival
UNION ALL SELECT brand, 'aeo', brand || ' is mentioned with net-negative sentiment (' || printf('%.2f', sentiment_score) || ')', 'high', 'high',
 'Investigate and address the specific negative associations found in the raw AEO runs.', score FROM whole WHERE sentiment_score < 0
UNION ALL SELECT brand, 'aeo', brand || ' is rarely the first brand mentioned (' || floor(first_mention_rate * 100 + 0.5)::BIGINT || '% of runs)', 'medium', 'high',
 'Strengthen category-defining content to be the default recommendation, not an afterthought.', score FROM whole WHERE first_mention_rate < 0.2 AND share_of_voice > 0
UNION ALL SELECT brand, 'aeo', 'Top site keywords the model never uses when describing ' || brand || ': ' || terms, 'medium', 'medium',
 'Reinforce these terms in citable, structured site content so the model picks them up.', score FROM whole WHERE terms <> ''"""

_PHRASES = ORACLE["phrase_cloud"].replace("SELECT source AS site", "SELECT 'all' AS site")
ORACLE["product_hooks"] = f"""WITH {cloud("'all'")}, phrases AS ({_PHRASES}), cut AS (SELECT doc_id, {_CUT.replace('text', "coalesce(text, '')")} AS ss FROM documents),
told AS (SELECT 0 AS part, doc_id AS n, ss[1] AS hook, 'meta_description' AS source, 1 AS document_frequency, 1 AS evidence, 'd' || doc_id AS u FROM cut WHERE length(ss[1]) >= 20 AND NOT contains(lower(ss[1]), '{BRANDS[0]}')
 UNION ALL SELECT 1, doc_id, ss[2], 'definition', 1, 1, 'd' || doc_id FROM cut WHERE ss[2] IS NOT NULL AND NOT contains(lower(ss[2]), '{BRANDS[0]}')),
best AS (SELECT * FROM cloud WHERE rank <= 50 AND document_frequency >= 2 AND length(term) >= 4 AND NOT list_contains({_list([*ARTIFACTS, BRANDS[0]])}, term) ORDER BY rank LIMIT {MOST_HOOKS}),
shown AS (SELECT term, count(*) AS k FROM phrases WHERE pos <= 3 GROUP BY term),
every AS (SELECT * FROM told UNION ALL SELECT 2, rank, term, 'tagcloud', document_frequency, coalesce(k, 0), '' FROM best LEFT JOIN shown USING (term)),
once AS (SELECT *, row_number() OVER (PARTITION BY hook ORDER BY part, n, u) AS again FROM every)
SELECT row_number() OVER (ORDER BY part, n, hook) AS ord, hook, source, document_frequency::BIGINT AS document_frequency, evidence::BIGINT AS evidence FROM once WHERE again = 1"""
