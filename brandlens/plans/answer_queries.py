"""Queries of model answers: the log of calls, mentions by table function and by automaton, nested and sorted results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as T
from ..operators import clusters, needles, nested, questions, tagcloud
from ..operators.numbering import number
from ..sources.call_log import CallLog
from ..sources.scratch import new_folder
from . import oracles
from .catalog import BRANDS, THEMES, _kept, _one_site, _order_mentions, _runs, _site_pages, _t

#: Names looked for at once.
NAMES = 300
PAGE = 2


def call_log_replay(spark, sf):
    """User turns as prompts asked twice; the assistant's next turn is on record as the first answer. A first sitting asks
    for half of the conversations, a second one, after a restart, for all: only what is not in the log is asked."""
    turns = _t(spark, sf, "conversations")
    key = lambda shift: F.concat_ws("-", "conv_id", F.col("turn") - shift)
    prompts = turns.where("role = 'user' AND text IS NOT NULL").select(key(0).alias("id"), "text", "conv_id")
    said = turns.where("role = 'assistant' AND text IS NOT NULL").select(key(1).alias("prompt_id"), F.lit(1).alias("rep"), "text")
    path = f"{new_folder(spark, 'calls')}/log"
    answer = lambda prompt: f"{len(prompt)} characters"
    CallLog(spark, path).record(said.join(prompts.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi"))
    for asked in (prompts.where("conv_id % 2 = 0"), prompts):
        CallLog(spark, path).ask(asked, answer, runs=2, calls=1000, tasks=8)
    return CallLog(spark, path).read().select("prompt_id", "rep", "text", (F.col("batch") == "recorded").alias("recorded"))


def mention_positions(spark, sf):
    """Every place of the 300 best terms of all documents in the assistant's answers."""
    names = [r["term"] for r in tagcloud.site_tagcloud(_one_site(spark, sf), NAMES).collect()]
    found = needles.find_all(_runs(spark, sf), names)
    return found.select("run_id", "name", F.size("positions").cast("long").alias("places"), F.array_join("positions", ",").alias("positions"))


def mentions_of_many(spark, sf):
    """The mentions of ``mentions_text`` by the automaton."""
    return needles.extract_mentions_of_many(_runs(spark, sf), BRANDS)


def mentions_sql(spark, sf):
    """The mentions of ``mentions_text`` by the table function."""
    sql.register(spark)
    listed = ", ".join(f"'{b}'" for b in BRANDS)
    return spark.sql(f"SELECT run_id, m.* FROM {{runs}}, LATERAL mentions(text, array({listed})) m", runs=_runs(spark, sf))


def _prompts(spark, sf):
    return _t(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt")).withColumnRenamed("conv_id", "prompt_id")


def _said(spark, sf):
    return _t(spark, sf, "conversations").where("role = 'assistant' AND text IS NOT NULL")


def prompt_runs_nested(spark, sf):
    """Each conversation's first question with all answers, two on a page."""
    runs = _said(spark, sf).select(F.col("conv_id").alias("prompt_id"), F.format_string("%06d", "turn").alias("run_id"), "text")
    found = nested.prompt_runs(_prompts(spark, sf), runs, PAGE)
    return found.select("prompt_id", "prompt", "page", F.col("n").alias("n_runs"), F.array_join(F.transform("runs", lambda r: F.concat_ws(": ", r["run_id"], r["text"])), " | ").alias("runs"))


def grouped_runs_nested(spark, sf):
    """Answers grouped by the document language of the same number, as runs of one prompt a language: attributes of the
    first run, all runs in order by pages."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.coalesce("lang", F.lit("none")).alias("prompt_id"), "source")
    runs = _said(spark, sf).join(docs, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "prompt_id", F.concat_ws("-", "conv_id", "turn").alias("run_id"), "text", "source")
    found = nested.grouped_runs(runs, ["source"], PAGE)
    return found.select("prompt_id", "source", "place", "page", F.col("n").alias("n_runs"), F.array_join(F.transform("runs", lambda r: F.concat_ws(": ", r["run_id"], r["text"])), " | ").alias("runs"))


def hook_questions_nested(spark, sf):
    """The hooks of all sites, each with its questions in order."""
    hooks = questions.site_hooks(tagcloud.site_tagcloud(_site_pages(spark, sf)))
    # A term that is a hook of many sites is one hook here, with the questions of all.
    asked = questions.hook_questions(hooks).select("hook", "ord", "text")
    once = hooks.groupBy("hook").agg(F.min("ord").alias("ord"))
    return nested.with_questions(once, asked, "hook", 4).select("hook", "ord", "page", "n", F.array_join("questions", " | ").alias("questions"))


def cooccurrence_lists(spark, sf):
    """Brands of orders with those ordered beside them, most first, then first met."""
    found = _order_mentions(spark, sf).select(F.col("run_id").alias("run_ord"), "position", "brand")
    brands = _t(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    out = nested.co_occurrence_lists(found, brands)
    return out.select("brand", F.array_join(F.transform("others", lambda o: F.concat_ws(":", o["brand"], o["count"])), ",").alias("others"))


def theme_lists(spark, sf):
    """Themes of all documents' terms by falling score, with their terms in order."""
    cloud = tagcloud.site_tagcloud(_one_site(spark, sf))
    found = cloud.join(clusters.taxonomy_table(spark, THEMES), "term", "left").select("theme", "term", "score", "rank")
    return nested.theme_lists(found).withColumn("terms", F.array_join("terms", " "))


def cluster_comparison(spark, sf):
    """Totals of the taxonomy's themes beside those of a model that groups the same terms by their first letter, leaving
    out the vowels."""
    runs = _runs(spark, sf)
    cloud = _kept(spark, tagcloud.site_tagcloud(_one_site(spark, sf)), "cloud")
    found = clusters.cluster_terms(cloud, clusters.taxonomy_table(spark, THEMES))
    asked = _t(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    theme = F.struct(F.col("letter").alias("name"), F.array_sort(F.collect_list("term")).alias("terms"))
    grouped = cloud.withColumn("letter", F.substring("term", 1, 1)).where("letter NOT IN ('a', 'e', 'i', 'o', 'u')").groupBy("letter").agg(theme.alias("theme"))
    said = grouped.agg(F.to_json(F.struct(F.array_sort(F.collect_list("theme")).alias("themes"), F.array().cast("array<string>").alias("unclustered"))).alias("json"))
    other = clusters.cluster_terms_by_model(cloud, said.first()["json"])
    return nested.cluster_totals(found, other, clusters.theme_questions(found, asked), clusters.theme_answers(found, runs))


def theme_clusters_by_models(spark, sf):
    """The themes that a model finds for each site: terms by their first letter, all of them once more under a last theme,
    words that are no terms; the answers for sites whose names end in 5 are no JSON."""
    clouds = tagcloud.site_tagcloud(_site_pages(spark, sf))
    theme = lambda name, terms: F.struct(name.alias("name"), terms.alias("terms"))
    letters = clouds.withColumn("letter", F.substring("term", 1, 1)).where("letter NOT IN ('a', 'e', 'i', 'o', 'u')")
    grouped = letters.groupBy("site", "letter").agg(F.concat(F.array_sort(F.collect_list("term")), F.array(F.lit("made up"))).alias("terms"))
    again = F.array(theme(F.lit("again"), F.flatten(F.collect_list("terms"))))
    themes = F.concat(F.array_sort(F.collect_list(theme(F.col("letter"), F.col("terms")))), again)
    json = F.to_json(F.struct(themes.alias("themes"), F.array().cast("array<string>").alias("unclustered")))
    fenced = F.concat(F.lit("Here you are:\n```json\n"), json, F.lit("\n```"))
    said = grouped.groupBy("site").agg(fenced.alias("json")).select("site", F.when(F.col("site").endswith("5"), "I cannot do that.").otherwise(F.col("json")).alias("text"))
    return clusters.cluster_terms_by_models(clouds, said)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        call_log_replay, mention_positions, mentions_of_many, mentions_sql, prompt_runs_nested, grouped_runs_nested, hook_questions_nested,
        cooccurrence_lists, theme_lists, cluster_comparison, theme_clusters_by_models,
    )
}

_SHOWN = f"CASE WHEN length(text) > {nested.SHOWN} THEN substring(text, 1, {nested.SHOWN}) || '…' ELSE text END"
ORACLE = {
    "call_log_replay": """WITH prompts AS (SELECT conv_id, turn, conv_id || '-' || turn AS prompt_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
said AS (SELECT conv_id || '-' || (turn - 1) AS prompt_id, text AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT prompt_id, rep, CASE WHEN rep = 1 AND answer IS NOT NULL THEN answer ELSE length(text) || ' characters' END AS text, rep = 1 AND answer IS NOT NULL AS recorded
FROM prompts LEFT JOIN said USING (prompt_id) CROSS JOIN (SELECT unnest([1, 2])::INT AS rep)""",
    "mention_positions": f"""WITH {oracles.cloud("'all'")}, names AS (SELECT term FROM cloud WHERE rank <= {NAMES}),
hits AS (SELECT conv_id || '-' || turn AS run_id, term, string_split(lower(text), term) AS parts FROM conversations JOIN names ON contains(lower(text), term) WHERE role = 'assistant'),
spots AS (SELECT run_id, term, list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(term) + 1) AS found FROM hits)
SELECT run_id, term AS name, len(found) AS places, array_to_string(found, ',') AS positions FROM spots""",
    "mentions_of_many": oracles.ORACLE["mentions_text"],
    "mentions_sql": oracles.ORACLE["mentions_text"],
    "prompt_runs_nested": f"""WITH prompts AS (SELECT conv_id AS prompt_id, min_by(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id),
runs AS (SELECT conv_id AS prompt_id, printf('%06d', turn) || ': ' || {_SHOWN} AS r, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // {PAGE} AS page,
         count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
paged AS (SELECT prompt_id, page, max(n) AS n, string_agg(r, ' | ' ORDER BY turn) AS runs FROM runs GROUP BY prompt_id, page)
SELECT prompt_id, prompt, coalesce(page, 0) AS page, coalesce(n, 0) AS n_runs, coalesce(runs, '') AS runs FROM prompts LEFT JOIN paged USING (prompt_id)""",
    "grouped_runs_nested": f"""WITH said AS (SELECT c.conv_id * 1000 + turn AS ord, coalesce(lang, 'none') AS prompt_id, c.conv_id || '-' || turn AS run_id, c.text AS text, source
  FROM conversations c JOIN documents d ON c.conv_id = d.doc_id WHERE role = 'assistant' AND c.text IS NOT NULL),
firsts AS (SELECT prompt_id, min(ord) AS o, min_by(source, ord) AS source FROM said GROUP BY prompt_id),
placed AS (SELECT prompt_id, source, row_number() OVER (ORDER BY o) AS place FROM firsts),
runs AS (SELECT prompt_id, ord, run_id || ': ' || {_SHOWN} AS r, (row_number() OVER (PARTITION BY prompt_id ORDER BY ord) - 1) // {PAGE} AS page, count(*) OVER (PARTITION BY prompt_id) AS n FROM said),
paged AS (SELECT prompt_id, page, max(n) AS n_runs, string_agg(r, ' | ' ORDER BY ord) AS runs FROM runs GROUP BY prompt_id, page)
SELECT prompt_id, source, place, page, n_runs, runs FROM placed JOIN paged USING (prompt_id)""",
    "hook_questions_nested": f"""WITH asked AS ({oracles.ORACLE["hook_question_set_full"]}),
hooks AS (SELECT hook, min(ord) // 4 + 1 AS ord FROM asked GROUP BY hook),
runs AS (SELECT hook, text, ord, (row_number() OVER (PARTITION BY hook ORDER BY ord) - 1) // 4 AS page, count(*) OVER (PARTITION BY hook) AS n FROM asked),
paged AS (SELECT hook, page, max(n) AS n, string_agg(text, ' | ' ORDER BY ord) AS questions FROM runs GROUP BY hook, page)
SELECT hook, ord, page, n, questions FROM hooks JOIN paged USING (hook)""",
    "cooccurrence_lists": f"""WITH {oracles.ORDERS}, pairs AS (SELECT a.brand, b.brand AS other, count(*) AS n, min({{'r': a.run_id, 'p': b.position}}) AS met FROM mentions a JOIN mentions b ON a.run_id = b.run_id AND a.brand <> b.brand GROUP BY ALL),
listed AS (SELECT brand, string_agg(other || ':' || n, ',' ORDER BY n DESC, met) AS others FROM pairs GROUP BY brand)
SELECT brand, coalesce(others, '') AS others FROM (SELECT DISTINCT p_brand AS brand FROM part) LEFT JOIN listed USING (brand)""",
    "theme_lists": f"""WITH {oracles.cloud("'all'")}, taxonomy AS ({oracles._THEMES}), found AS (SELECT theme, term, score, rank FROM cloud JOIN taxonomy USING (term) WHERE rank <= 50),
themes AS (SELECT theme, sum(score) AS t, min(rank) AS f, string_agg(term, ' ' ORDER BY score DESC, rank) AS terms FROM found GROUP BY theme)
SELECT row_number() OVER (ORDER BY round(t, 6) DESC, f) AS place, theme, round(t, 6) AS total_score, terms FROM themes""",
    "cluster_comparison": oracles._CLUSTERED + oracles._STATS + f""", asked AS (SELECT DISTINCT theme, conv_id || '-' || turn AS id FROM (SELECT conv_id, turn, unnest({oracles.TOKENS}) AS term FROM conversations WHERE role = 'user') JOIN clustered USING (term) WHERE theme IS NOT NULL),
other AS (SELECT CASE WHEN substring(term, 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN substring(term, 1, 1) END AS theme FROM clustered)
SELECT (SELECT count(DISTINCT theme) FROM clustered) AS themes, (SELECT count(*) FROM clustered WHERE theme IS NULL) AS unclustered,
 (SELECT count(DISTINCT theme) FROM other) AS themes_other, (SELECT count(*) FROM other WHERE theme IS NULL) AS unclustered_other,
 (SELECT count(*) FROM asked) AS questions, (SELECT coalesce(sum(n), 0)::BIGINT FROM told) AS answer_mentions""",
    "theme_clusters_by_models": f"""WITH {oracles.cloud("source")}
SELECT site, CASE WHEN substring(term, 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') AND NOT ends_with(site, '5') THEN substring(term, 1, 1) END AS theme, term, score FROM cloud WHERE rank <= 50""",
}
