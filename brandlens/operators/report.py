"""Report rows and their Markdown."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMOJI = {"good": "🟢", "needs_work": "🟡", "critical": "🔴"}


#: Keywords and gap terms that the report names; evidence of a claim, and characters of a snippet.
KEYWORDS, GAP_TERMS, CLAIM_EVIDENCE, SNIPPET = 15, 10, 3, 160


# The sentences of the findings and actions.
def aeo_findings(metrics: DataFrame, brand: str, gaps: DataFrame) -> DataFrame:
    """From brand metrics (one row a brand) and the site terms that the model never uses."""
    rivals = metrics.where(F.col("brand") != brand).agg(F.coalesce(F.avg("share_of_voice"), F.lit(0.0)).alias("rival"))
    missing = gaps.where(~F.col("mentioned_by_model")).select(F.struct((-F.col("site_score")).alias("s"), "term").alias("g"))
    terms = missing.agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("g")), 1, 5), lambda g: g["term"]), ", ").alias("terms"))
    one = F.lit(1).alias("one")
    # One row each: the brand's, the rivals' mean, the missing terms.
    row = metrics.where(F.col("brand") == brand).select("*", one).join(rivals.select("*", one), "one").join(terms.select("*", one), "one")
    name, percent = F.lit(brand), lambda c: F.format_string("%.0f", F.floor(F.col(c) * 100 + 0.5).cast("double"))
    rule = lambda when, text, impact, effort, action: F.when(when, F.struct(F.lit("aeo").alias("dimension"), text.alias("finding"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"), F.lit(action).alias("suggested_action")))
    rules = [
        rule(F.col("share_of_voice") < F.col("rival"), F.format_string("%s's Share of Voice (%s%%) is below the competitor average (%s%%)", name, percent("share_of_voice"), percent("rival")), "high", "high", "Publish more citable, comparison-ready content (see GEO findings) to increase how often the model surfaces the brand."),
        rule(F.col("sentiment_score") < 0, F.format_string("%s is mentioned with net-negative sentiment (%.2f)", name, "sentiment_score"), "high", "high", "Investigate and address the specific negative associations found in the raw AEO runs."),
        rule((F.col("first_mention_rate") < 0.2) & (F.col("share_of_voice") > 0), F.format_string("%s is rarely the first brand mentioned (%s%% of runs)", name, percent("first_mention_rate")), "medium", "high", "Strengthen category-defining content to be the default recommendation, not an afterthought."),
        rule(F.col("terms") != "", F.format_string("Top site keywords the model never uses when describing %s: %s", name, "terms"), "medium", "medium", "Reinforce these terms in citable, structured site content so the model picks them up."),
    ]
    return row.select(F.explode(F.array_compact(F.array(*rules))).alias("f")).select("f.*")


def label(score: float) -> str:
    return "good" if score >= 70 else "needs_work" if score >= 40 else "critical"


def badge(score: float) -> str:
    return EMOJI[label(score)]


def report_facts(seo: DataFrame, geo: DataFrame, broken: DataFrame, tagcloud: DataFrame, gaps: DataFrame) -> dict:
    """What the report says of the site: page counts, averages (0 without pages), keywords and gap terms."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    geo_row = geo.agg(F.count("*").alias("n"), mean("factual_density"), mean("structure_score")).first()
    n_gaps = gaps.agg(F.count("*").alias("n"), F.count(F.when(~F.col("mentioned_by_model"), 1)).alias("open")).first()
    missing = gaps.where("NOT mentioned_by_model").orderBy(F.desc("site_score"), "term").limit(GAP_TERMS).collect()
    return {
        "seo_pages": seo.count(),
        "broken": broken.count(),
        "keywords": [r["term"] for r in tagcloud.where(F.col("rank") <= KEYWORDS).orderBy("rank").collect()],
        "geo_pages": geo_row["n"],
        "factual_density": geo_row["factual_density"],
        "structure_score": geo_row["structure_score"],
        "gap_terms": n_gaps["n"],
        "open_gaps": n_gaps["open"],
        "missing": [r["term"] for r in missing],
    }


def fixed(x: float | None, digits: int = 0, factor: int = 1) -> str:
    """A number with so many digits, halves up; a dash for none."""
    if x is None:
        return "—"
    return str((Decimal(repr(float(x))) * factor).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def _table(head: Sequence[str], rows: Iterable[Sequence[str]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(r) + " |" for r in rows], ""]


# The columns of the metric tables.
METRIC_HEAD = ("Brand", "Share of Voice", "Relative SoV", "Avg Position", "First-Mention Rate", "Sentiment")


def _metric_rows(metrics: Iterable) -> list[tuple[str, ...]]:
    return [
        (
            m["brand"],
            fixed(m["share_of_voice"], 0, 100) + "%",
            fixed(m["relative_share_of_voice"], 2) + "x",
            fixed(m["average_position"], 1),
            fixed(m["first_mention_rate"], 0, 100) + "%",
            fixed(m["sentiment_score"], 2),
        )
        for m in metrics
    ]


def _grounded_section(brand: str, grounded: dict) -> list[str]:
    """Runs of the site's own questions: metrics, and the brand's share by source and stage."""
    out = ["## Brand-grounded question performance (not neutral -- see caveat)", ""]
    out += [f"These prompts quote or paraphrase what {brand}'s own site says. They show how the brand does on its best case and cannot be held against the neutral table above.", ""]
    out += [f"Total runs: {grounded['total']}", "", *_table(METRIC_HEAD, _metric_rows(grounded["metrics"]))]
    own = [b for d in ("source", "stage") for b in grounded["breakdown"] if b["dimension"] == d and b["brand"] == brand]
    if own:
        out.append(f"{brand}'s Share of Voice by breakdown:")
        for b in own:
            runs = "1 run" if b["run_count"] == 1 else f"{b['run_count']} runs"
            out.append(f"- {b['dimension']} = {b['value']}: {fixed(b['share_of_voice'], 0, 100)}% ({runs})")
        out.append("")
    return out


def render_report(brand: str, competitors: Sequence[str], scores: dict[str, int], facts: dict, total_runs: int, metrics: Iterable, priorities: Iterable, grounded: dict | None = None, generated: str = "") -> str:
    """Markdown from small collected rows: summary, SEO, GEO, AEO, gaps, brand-grounded runs if any, all priorities."""
    out = [f"# Brand Visibility Audit: {brand}", "", f"Generated {generated} · Competitors: {', '.join(competitors)}", "", "## Executive summary", ""]
    out += [f"- {badge(s)} **{k.upper()}**: {s}/100 ({label(s)})" for k, s in scores.items()]
    out += ["", "## SEO", "", f"- Pages analyzed: {facts['seo_pages']}", f"- Broken sitemap URLs: {facts['broken']}", f"- Top keywords: {', '.join(facts['keywords'])}"]
    out += ["", "## GEO", "", f"- Avg factual density score: {fixed(facts['factual_density'], 2)}", f"- Avg extractable structure score: {fixed(facts['structure_score'], 2)}"]
    out += ["", "## AEO", "", f"Total runs: {total_runs}", "", *_table(METRIC_HEAD, _metric_rows(metrics))]
    if facts["open_gaps"]:
        out += [f"**GEO/AEO gap**: {facts['open_gaps']} of the site's top {facts['gap_terms']} keywords never show up in how the model describes {brand}: {', '.join(facts['missing'])}.", ""]
    if grounded and grounded["total"] > 0:
        out += _grounded_section(brand, grounded)
    rows = [(p["dimension"].upper(), p["finding"], p["impact"], p["effort"], p["suggested_action"]) for p in priorities]
    out += ["## Priority matrix (impact × effort)", "", *_table(("Dimension", "Finding", "Impact", "Effort", "Suggested action"), rows)]
    return "\n".join(out)


# Headings of the stages, in order.
STAGES = {
    "pain_only": "Pain-only (no solution ask)",
    "problem_framed": "Problem-framed (solution-unaware)",
    "comparing_with_criteria": "Comparing with criteria (solution-aware)",
}


def _evidence(found: Iterable, most: int | None = None) -> list[str]:
    shown = [f'- [{e["url"]}]({e["url"]}): "{e["snippet"][:SNIPPET]}"' for e in list(found or [])[:most]]
    return ["", "Evidence:", *shown] if shown else []


def render_questions(brand: str, hooks: Sequence, hook_questions: Sequence, claims: Sequence, inferential: Sequence) -> str:
    """Markdown of all questions: by hook, then by problem and stage, each with its evidence. Rows are the tables' own."""
    out = [f"# Candidate user questions grounded in {brand}'s own site content", ""]
    out += [f"{len(hooks)} hooks and {len(claims)} problem/audience claims, {len(hook_questions) + len(inferential)} questions.", "", "## Part 1: Direct hook-grounded questions", ""]
    by_hook, by_problem = defaultdict(list), defaultdict(list)
    for q in hook_questions:
        by_hook[q["hook"]].append(q["text"])
    for q in inferential:
        by_problem[q["problem"], q["stage"]].append(q["text"])
    for h in hooks:
        out += [f'### Hook: "{h["hook"]}"', "", f"Source: `{h['source']}` (document frequency: {h['document_frequency']})", *_evidence(h["evidence"])]
        out += ["", "Candidate questions:", *[f"- {t}" for t in by_hook[h["hook"]]], ""]
    out += ["## Part 2: Inferential questions (paraphrased, no site quoting)", ""]
    for c in claims:
        out += [f'### Problem: "{c["problem"]}"', "", "Audience detected: " + (", ".join(c["audience"]) or "(none detected)"), *_evidence(c["evidence"], CLAIM_EVIDENCE), ""]
        for stage, heading in STAGES.items():
            if asked := by_problem[c["problem"], stage]:
                out += [f"**{heading}:**", *[f"- {t}" for t in asked], ""]
    return "\n".join(out)
