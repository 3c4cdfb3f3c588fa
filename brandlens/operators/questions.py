"""Prompts, hooks, problem claims and the questions made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import number

# Personas as (role, team size, English phrase, Spanish phrase).
PERSONAS = [
    ("startup founder", "solo", "a startup founder working solo", "un fundador de startup que trabaja solo"),
    ("engineering lead", "large team", "an engineering lead managing a large team", "un líder de ingeniería que gestiona un equipo grande"),
    ("product manager", "large company", "a product manager at a large company", "un product manager en una empresa grande"),
    ("freelancer", "solo", "a freelancer working alone", "un freelancer que trabaja solo"),
    ("marketing team", "small team", "a small marketing team", "un equipo de marketing pequeño"),
]
# Attribute anchors as (name, English phrase, Spanish phrase).
ATTRIBUTES = [
    ("price", "a free or affordable option", "una opción gratis o económica"),
    ("speed_ux", "something fast and simple to use", "algo rápido y simple de usar"),
    ("integrations", "solid integrations with GitHub and Slack", "buenas integraciones con GitHub y Slack"),
    ("methodology", "support for sprints and kanban boards", "soporte para sprints y tableros kanban"),
    ("none", "that fits their workflow", "que se adapte a su flujo de trabajo"),
]
# Intents in order, with the specificity and the English and Spanish texts.
INTENTS = [
    ("discovery", "generic", "What {category} tools exist for {persona}?", "¿Qué herramientas de {category} existen para {persona}?"),
    ("direct_comparison", "specific", "{brandA} vs {brandB}, which one should I choose?", "{brandA} vs {brandB}, ¿cuál elijo?"),
    ("recommendation_constraint", "generic", "What's the best {category} tool for {persona} that needs {attribute}?", "¿Cuál es la mejor herramienta de {category} para {persona} que necesita {attribute}?"),
    ("troubleshooting_replacement", "semi_specific", "What are some alternatives to {brandA} that offer {attribute}?", "¿Qué alternativas a {brandA} ofrecen {attribute}?"),
    ("final_decision", "specific", "Between {brandA}, {brandB}, and {brandC}, which one do you recommend?", "Entre {brandA}, {brandB} y {brandC}, ¿cuál recomiendas?"),
]
CONTROL = ("adversarial_control", "generic", "How should {persona} organize their team's work?", "¿Cómo debería organizar el trabajo {persona}?")
NO_COMPETITOR = "the competition"

# Question templates.
SHORT = [
    ("direct-differentiator", 'What tool would you recommend for a team that wants "{hook}"?'),
    ("problem-framed", "I need something that helps with {hook} -- what should my team use?"),
    ("comparison-anchor", "Which tool in this space is known for {hook}?"),
    ("persona-specific", "As {persona}, I want a tool that focuses on {hook} instead of doing everything. Any recommendations?"),
]
LONG = [
    ("long-form-quote-match", 'What tool matches this description: "{hook}"?'),
    ("long-form-as-need", "As {persona}, I'm looking for a tool where: {hook} Any suggestions?"),
]
ASKERS = ["an engineering lead", "a startup founder", "a product manager at a large company", "a freelancer"]
#: (id, stage, pattern, needs an audience, replaces by audience, needs competitors), in order.
PAIN, PROBLEM, COMPARING = "pain_only", "problem_framed", "comparing_with_criteria"
INFERENTIAL = [
    ("pain-vent", PAIN, "As {persona}, my team keeps struggling to {problem}.", "any", False),
    ("pain-frustration", PAIN, "We can never seem to {problem} -- it's honestly exhausting.", "any", False),
    ("pain-recurring", PAIN, "Every week it's the same story: we just can't {problem}.", "any", False),
    ("pain-vent-audience", PAIN, "For {audience}, it's a constant challenge to {problem}.", "with", False),
    ("problem-best-way", PROBLEM, "What's the best way to {problem}?", "any", False),
    ("problem-how-to", PROBLEM, "How do most teams manage to {problem}?", "any", False),
    ("problem-advice", PROBLEM, "We know we need to {problem}, but we're not sure how. Any advice?", "any", False),
    ("problem-audience-way", PROBLEM, "What's the best way for {audience} to {problem}?", "with", False),
    ("comparison-criteria-generic", COMPARING, "What criteria matter most when picking a tool to help {problem}?", "without", False),
    ("comparison-criteria-audience", COMPARING, "What should I prioritize when choosing a tool for {audience} that need to {problem}?", "with", False),
    ("comparison-named", COMPARING, "Between {competitorA} and {competitorB}, which is better suited to help {problem}?", "without", True),
    ("comparison-named-audience", COMPARING, "Between {competitorA} and {competitorB}, which is better for {audience} that need to {problem}?", "with", True),
]
# Scrape artifacts that are no hooks.
ARTIFACTS = ["contextreply", "americalearn", "syncstatus"]
#: Tag-cloud hooks of a site.
MOST_HOOKS = 20

# A claim's verbs, what they may address, and the audiences looked for; all may be replaced.
DROPPED_VERBS = ("help", "helps", "helping")
KEPT_VERBS = {
    "enable": "enable",
    "enables": "enable",
    "improve": "improve",
    "improves": "improve",
    "remove": "remove",
    "removes": "remove",
    "restore": "restore",
    "restores": "restore",
    "streamline": "streamline",
    "streamlines": "streamline",
    "give": "give",
    "gives": "give",
    "reduce": "reduce",
    "reduces": "reduce",
}
OBJECTS = ("teams", "team", "you", "us", "people", "users", "companies", "everyone")
ORG_TYPES = ("startups", "startup", "enterprises", "enterprise", "agencies", "agency")
USER_TYPES = ("engineering teams", "engineering team", "product teams", "product team", "founders", "founder", "developers", "developer")


def _pick(values: Sequence[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int") + 1)


def fill(pattern: Column, **values: Column) -> Column:
    for k, v in values.items():
        pattern = F.replace(pattern, F.lit("{" + k + "}"), v)
    return pattern


def generate_prompts(spark: SparkSession, brand: str, competitors: Sequence[str], category: str, count: int) -> DataFrame:
    """(ord, id, text, intent, persona_role, team_size, specificity, attribute, language, brands_named) of one product."""
    product = spark.createDataFrame([(brand, list(competitors), category)], "brand string, competitors array<string>, category string")
    return prompts_of_products(product, count).drop("brand", "competitors", "category")


def prompts_of_products(products: DataFrame, count: int) -> DataFrame:
    """The prompts of every product (brand, competitors array, category, ...), ``count`` a product, with its columns."""
    control = max(2, int(count * 0.15 + 0.5))
    normal = max(0, count - control)
    i = F.when(F.col("ord") < normal, F.col("ord")).otherwise(F.col("ord") - normal)
    own = F.col("ord") < normal
    english = i % 2 == 0
    side = lambda a, b: F.when(english, a).otherwise(b)
    kinds = [r[0] for r in INTENTS]
    intent = F.when(own, _pick(kinds, i)).otherwise(F.lit(CONTROL[0]))
    # The intent's own number turns with i, so an anchor moves two steps a prompt.
    anchor = i + i % len(INTENTS)
    rivals = F.when(F.size("competitors") > 0, F.col("competitors")).otherwise(F.array(F.lit(NO_COMPETITOR)))
    rival, second = (F.element_at(rivals, ((i + k) % F.size(rivals)).cast("int") + 1) for k in (0, 1))
    first = F.when((intent == "troubleshooting_replacement") & english, rival).otherwise(F.col("brand"))
    text = F.when(own, side(_pick([r[2] for r in INTENTS], i), _pick([r[3] for r in INTENTS], i))).otherwise(side(F.lit(CONTROL[2]), F.lit(CONTROL[3])))
    text = fill(
        text,
        category=F.col("category"),
        persona=side(_pick([p[2] for p in PERSONAS], i), _pick([p[3] for p in PERSONAS], i)),
        attribute=side(_pick([a[1] for a in ATTRIBUTES], anchor), _pick([a[2] for a in ATTRIBUTES], anchor)),
        brandA=first,
        brandB=rival,
        brandC=second,
    )
    named = (
        F.when(intent == "direct_comparison", F.array(F.col("brand"), rival))
        .when(intent == "troubleshooting_replacement", F.array(first))
        .when(intent == "final_decision", F.array(F.col("brand"), rival, second))
        .otherwise(F.array().cast("array<string>"))
    )
    return products.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(normal + control - 1).cast("long")))).select(
        *products.columns,
        "ord",
        F.concat_ws("-", intent, F.col("ord").cast("string")).alias("id"),
        text.alias("text"),
        intent.alias("intent"),
        _pick([p[0] for p in PERSONAS], i).alias("persona_role"),
        _pick([p[1] for p in PERSONAS], i).alias("team_size"),
        F.when(own, _pick([r[1] for r in INTENTS], i)).otherwise(F.lit("generic")).alias("specificity"),
        F.when(own, _pick([a[0] for a in ATTRIBUTES], anchor)).otherwise(F.lit("none")).alias("attribute"),
        side(F.lit("en"), F.lit("es")).alias("language"),
        named.alias("brands_named"),
    )


def hook_terms(tagcloud: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The terms of a tag cloud that may be hooks."""
    return tagcloud.where((F.col("document_frequency") >= 2) & (F.length("term") >= 4) & ~F.col("term").isin([*ARTIFACTS, *[e.lower() for e in exclude]]))


def site_hooks(tagcloud: DataFrame, exclude: Sequence[str] = (), most: int = MOST_HOOKS) -> DataFrame:
    """(ord, hook, source) of many sites: the tag-cloud hooks that scan_hooks finds for each, by site and rank."""
    place = F.row_number().over(W.partitionBy("site").orderBy("rank"))
    top = hook_terms(tagcloud, exclude).withColumn("place", place).where(F.col("place") <= most)
    named = top.select("site", "rank", F.col("term").alias("hook"), F.lit("tagcloud").alias("source"))
    return number(named, "site", "rank").select("ord", "hook", "source")


def scan_hooks(seo: DataFrame, geo: DataFrame, tagcloud: DataFrame, phrases: DataFrame, exclude: Sequence[str] = (), most: int = MOST_HOOKS) -> DataFrame:
    """(ord, hook, source, document_frequency, evidence): meta descriptions, definitions, tag cloud; the first of
    equal hooks counts, by the pages' ``ord`` where they have one, then by page. phrases is (term, pos, page, snippet)."""
    proof = "array<struct<url:string,snippet:string>>"
    alone = lambda c: F.array(F.struct(F.col("url"), F.col(c).alias("snippet"))).cast(proof)
    row = lambda df, c, source, k: df.select(F.lit(k).alias("part"), (F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")).alias("n"), F.col(c).alias("hook"), F.lit(source).alias("source"), F.lit(1).cast("long").alias("document_frequency"), alone(c).alias("evidence"))
    keep = lambda c: ~T.contains_excluded(F.col(c), exclude)
    meta = row(seo.where((F.length("meta_description") >= 20) & keep("meta_description")), "meta_description", "meta_description", 0)
    told = row(geo.where(F.col("definition").isNotNull() & keep("definition")), "definition", "definition", 1)
    seen = phrases.where("pos <= 3").groupBy("term").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("page").alias("url"), "snippet"))).alias("hits"))
    top = hook_terms(tagcloud, exclude).orderBy("rank").limit(most).join(seen, "term", "left")
    shown = F.coalesce(F.transform("hits", lambda h: F.struct(h["url"].cast("string").alias("url"), h["snippet"].alias("snippet"))), F.array().cast(proof))
    cloud = top.select(F.lit(2).alias("part"), F.col("rank").alias("n"), F.col("term").alias("hook"), F.lit("tagcloud").alias("source"), "document_frequency", shown.alias("evidence"))
    every = meta.unionByName(told).unionByName(cloud)
    once = every.withColumn("k", F.row_number().over(W.partitionBy("hook").orderBy("part", "n", "evidence"))).where("k = 1")
    return number(once, "part", "n", "hook").select("ord", "hook", "source", "document_frequency", "evidence")


def hook_questions(hooks: DataFrame) -> DataFrame:
    """(ord, id, text, template_id, hook, hook_source): four short or two long templates a hook."""
    rows = lambda ts: F.array(*[F.struct(F.lit(i).alias("t"), F.lit(a).alias("template_id"), F.lit(p).alias("pattern")) for i, (a, p) in enumerate(ts)])
    wide = hooks.withColumn("t", F.explode(F.when(T.is_long_form(F.col("hook")), rows(LONG)).otherwise(rows(SHORT))))
    out = number(wide, "ord", "t.t", name="n", start=0)
    text = fill(F.col("t.pattern"), persona=_pick(ASKERS, F.col("n")), hook=F.col("hook"))
    return out.select(F.col("n").cast("long").alias("ord"), F.concat_ws("-", "t.template_id", F.col("n").cast("string")).alias("id"), text.alias("text"), F.col("t.template_id").alias("template_id"), "hook", F.col("source").alias("hook_source"))


def inferential_questions(claims: DataFrame, competitors: Sequence[str]) -> DataFrame:
    """(ord, id, text, template_id, stage, problem) from claims (ord, problem, audience array, most general first)."""
    pairs = [(a, b) for i, a in enumerate(competitors) for b in competitors[i + 1 :]]
    table = [r for r in INFERENTIAL if pairs or not r[4]]
    rows = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(r[0]).alias("template_id"), F.lit(r[1]).alias("stage"), F.lit(r[2]).alias("pattern"), F.lit(r[3]).alias("audience")) for i, r in enumerate(table)])
    has = F.size("audience") > 0
    fits = F.filter(rows, lambda r: (r["audience"] == "any") | ((r["audience"] == "with") == has))
    wide = number(claims, "ord", name="claim", start=0).withColumn("t", F.explode(fits))
    wide = number(wide, "ord", "t.t", name="n", start=0)
    values = {"persona": _pick(ASKERS, F.col("n")), "problem": F.col("problem"), "audience": F.coalesce(F.get("audience", F.lit(0)), F.lit(""))}
    if pairs:
        values |= {"competitorA": _pick([a for a, _ in pairs], F.col("claim")), "competitorB": _pick([b for _, b in pairs], F.col("claim"))}
    return wide.select(F.col("n").cast("long").alias("ord"), F.concat_ws("-", "t.template_id", F.col("n").cast("string")).alias("id"), fill(F.col("t.pattern"), **values).alias("text"), F.col("t.template_id").alias("template_id"), F.col("t.stage").alias("stage"), "problem")


def scan_claims(texts: DataFrame, exclude: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(ord, problem, audience, evidence) from (ord, url, text), in order: what a text says it helps to do.

    A claim runs from a verb of the lists to the end of its sentence, and another verb within it begins no claim of its
    own; ``help`` and what it addresses are dropped, other verbs stay in their base form. Fragments of fewer than
    ``least`` words, or that name an excluded term, go.
    """
    verbs = "|".join([*DROPPED_VERBS, *KEPT_VERBS])
    lines = texts.select("ord", "url", "text", F.posexplode(T.split_sentences(F.col("text"))).alias("at", "line"))
    found = lines.select("*", F.posexplode(F.regexp_extract_all("line", F.lit(rf"(?i)\b(?:{verbs})\b\s+[^.!?]+"), F.lit(0))).alias("nth", "said"))
    found = found.withColumn("verb", F.lower(F.regexp_extract("said", rf"(?i)^({verbs})\b", 1)))
    own = F.regexp_extract("said", r"(?i)^\w+\s+((?:" + "|".join(OBJECTS) + r")\b\s+)?([^.!?]+)", 2)
    base = F.create_map(*[F.lit(x) for kv in KEPT_VERBS.items() for x in kv])[F.col("verb")]
    problem = F.trim(F.when(base.isNull(), own).otherwise(F.concat_ws(" ", base, own)))
    rows = found.select("ord", "at", "nth", "url", "text", problem.alias("problem"), F.col("line").alias("snippet"))
    rows = rows.where((F.size(F.split("problem", r"\s+")) >= least) & ~T.contains_excluded(F.col("problem"), exclude))
    low = F.lower("text")
    heard = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), F.lit(a)) for a in (*USER_TYPES, *ORG_TYPES)]))
    grouped = rows.groupBy(F.lower("problem").alias("key")).agg(
        F.min(F.struct("ord", "at", "nth", "problem", heard.alias("audience"))).alias("first"), F.array_sort(F.collect_set(F.struct("url", "snippet"))).alias("evidence")
    )
    return number(grouped, "first.ord", "first.at", "first.nth", "key").select("ord", "first.problem", "first.audience", "evidence").orderBy("ord")


def question_prompts(hook_questions: DataFrame | None, inferential: DataFrame | None, limit: int | None = None) -> DataFrame:
    """(ord, id, text, source, template_id, stage): written questions as prompts that name the site's own claims.

    Hook questions come first, then inferential ones, each in its order (their ``ord`` counts from 0). With both and a
    limit each gets half and what the other lacks; with one, the first ``limit``.
    """
    sides = [(df, source) for df, source in ((hook_questions, "hook"), (inferential, "inferential")) if df is not None]
    sizes = [df.count() for df, _ in sides]
    if limit is not None:
        sizes = list(question_quota(limit, *sizes)) if len(sides) == 2 else [min(limit, n) for n in sizes]
    out, before = None, 0
    for (df, source), n in zip(sides, sizes):
        stage = F.col("stage") if "stage" in df.columns else F.lit(None).cast("string")
        part = df.where(F.col("ord") < n).select((F.col("ord") + before).alias("ord"), "id", "text", F.lit(source).alias("source"), "template_id", stage.alias("stage"))
        out, before = part if out is None else out.unionByName(part), before + n
    return out


def question_quota(limit: int, n_hooks: int, n_inferential: int) -> tuple[int, int]:
    """How many of each source a limit takes: half and half, either filling what the other lacks."""
    hooks = min(n_hooks, max((limit + 1) // 2, limit - n_inferential))
    return hooks, min(n_inferential, limit - hooks)


def quotas(limit: Column, n_hooks: Column, n_inferential: Column) -> tuple[Column, Column]:
    """``question_quota`` as columns, for tables of many products."""
    hooks = F.least(n_hooks, F.greatest(F.floor((limit + 1) / 2), limit - n_inferential))
    return hooks.alias("hooks"), F.least(n_inferential, limit - hooks).alias("inferential")
