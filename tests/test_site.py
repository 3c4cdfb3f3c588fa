from pyspark.sql import functions as F

from brandlens.plans import catalog
from brandlens.functions import text as T
from brandlens.functions import urls as U
from brandlens.functions.html import parse_page
from brandlens.operators import clusters, questions, site, tagcloud
from brandlens.shipping import ship
from brandlens.sources import clients, lake, sitemap

PAGE = """<html><head><title> Tool </title><meta name="description" content="A tool that is the best way to plan your work.">
<script type="application/ld+json">{"@graph": [{"@type": "Product"}, {"@type": ["A", "B"]}]}</script></head>
<body><nav><a href="/nav">n</a></nav><main><h1>One</h1><h3>Three</h3><p>It is a tool by Ann Lee<p>More <b>text
<img src=x alt=""><img src=y alt="y"><a href="https://other.org/x">out</a><a href="mailto:a@b.c">m</a><ul><li>1<li>2</ul>
<script>var x = "</p>";</script></main></body></html>"""


def test_page_signals(spark):
    got = parse_page("https://site.org/a", PAGE)
    assert got["title"] == "Tool" and got["schema_types"] == ["Product", "A", "B"]
    assert (got["internal_links"], got["external_links"], got["outbound_citations"]) == (1, 1, 2)
    assert (got["images_total"], got["images_missing_alt"], got["lists"]) == (2, 1, 1)
    assert got["has_author"] and "var x" not in got["text"]
    ship(spark)
    pages = spark.createDataFrame([(1, "https://site.org/a", PAGE), (2, "u", None)], "page_id long, url string, html string")
    parsed = site.parsed(pages)
    seo = {r["url"]: r for r in site.seo_signals(parsed).collect()}
    assert seo["https://site.org/a"]["heading_order_issues"] == ['heading level skipped: h1 -> h3 ("Three")']
    assert seo["u"]["heading_order_issues"] == ["missing h1"]
    found = site.prioritised(site.seo_findings(site.seo_signals(parsed), pages.select(F.lit("dead").alias("url")).limit(1)).unionByName(site.geo_findings(site.geo_signals(parsed)))).collect()
    assert found[0]["impact"] == "high" and {"Missing H1 on u", "Broken/unreachable sitemap URL: dead"} <= {r["finding"] for r in found}


def test_url_functions(spark):
    rows = [("https://a.b", "home", False), ("https://a.b/pricing", "pricing", False), ("https://a.b/es-es/blog/", "blog", True), ("https://a.b/en-gb/x", "other", False), ("https://a.b/docs", "docs", False)]
    got = spark.createDataFrame([(u,) for u, *_ in rows], "url string").select(U.page_type(F.col("url")), U.is_localized(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [(t, loc) for _, t, loc in rows]


def test_robots(spark):
    rules = site.robots_rules(spark.createDataFrame([("s", "User-agent: *\nDisallow: /blog # x\nAllow: /blog/public\nDisallow:\nUser-agent: bot\nDisallow: /")], "site string, content string"))
    urls = spark.createDataFrame([("s", "https://a.b/blog/x"), ("s", "https://a.b/blog/public/1"), ("s", "https://a.b/z"), ("s", "not a url")], "site string, url string")
    assert [r["allowed"] for r in site.robots_allowed(urls, rules).collect()] == [False, True, True, False]


def test_quick_selection_prefers_types(spark):
    rows = [(0, "https://a.b/x", 0.9), (1, "https://a.b/es-es/pricing", 0.5), (2, "https://a.b/pricing", None), (3, "https://a.b/", 0.1), (4, "https://a.b/x", 0.9)]
    got = site.quick_urls(spark.createDataFrame(rows, "ord long, url string, priority double"), 3).orderBy("pick").collect()
    assert [r["url"] for r in got] == ["https://a.b/", "https://a.b/pricing", "https://a.b/es-es/pricing"]


def test_text_functions(spark):
    df = spark.createDataFrame([("10,000 3x 40% 3.5 is faster than x. Best tool! así ve mejoría",)], "t string")
    r = df.select(T.numbers(F.col("t")), T.comparatives(F.col("t")), T.promotional(F.col("t")), T.split_sentences(F.col("t")), T.word_count(F.col("t")), T.has_word(F.col("t"), F.lit("best"))).first()
    assert (r[0], r[1], r[2], r[4], r[5]) == (3, 1, 2, 13, True) and len(r[3]) == 3


def test_tagcloud(spark):
    pages = spark.createDataFrame([("s", 1, "alpha alpha issue tracker fast software."), ("s", 2, "beta project manager slow software.")], "site string, page long, text string")
    got = {r["term"]: r for r in tagcloud.site_tagcloud(pages).collect()}
    assert got["software"]["document_frequency"] == 2 and got["alpha"]["occurrences"] == 2 and got["alpha"]["rank"] == 1
    hits = tagcloud.phrase_cloud(pages, tagcloud.site_tagcloud(pages).where("term = 'software'")).collect()
    assert [h["page"] for h in hits] == [1, 2]


def test_prompts_and_questions(spark):
    got = questions.generate_prompts(spark, "Mine", ["A", "B"], "c", 10).orderBy("ord").collect()
    assert len(got) == 10 and [r["intent"] for r in got].count("adversarial_control") == 2
    assert got[1]["text"] == "Mine vs B, ¿cuál elijo?" and got[3]["brands_named"] == ["Mine"]
    hooks = spark.createDataFrame([(1, "short", "t"), (2, "a sentence of more than six words here", "m")], "ord int, hook string, source string")
    assert [r["template_id"] for r in questions.hook_questions(hooks).orderBy("ord").collect()][-2:] == ["long-form-quote-match", "long-form-as-need"]
    claims = spark.createDataFrame([(1, "reduce noise", ["teams"]), (2, "plan work", [])], "ord int, problem string, audience array<string>")
    assert questions.inferential_questions(claims, ["A", "B"]).count() == 10 + 8
    assert questions.inferential_questions(claims, []).count() == 9 + 7
    assert questions.question_quota(4, 10, 1) == (3, 1)
    found = questions.scan_claims(spark.createDataFrame([(1, "u", "It helps teams plan and track work. This helps us go. It reduces noise for engineering teams.")], "ord int, url string, text string")).collect()
    assert [r["problem"] for r in found] == ["plan and track work", "reduce noise for engineering teams"]


def test_clusters(spark):
    cloud = spark.createDataFrame([("agent", 3.0), ("agents", 2.0), ("banana", 1.0), ("contextreply", 9.0)], "term string, score double")
    got = clusters.cluster_terms(cloud, clusters.taxonomy_table(spark))
    assert {(r["term"], r["theme"]) for r in got.collect()} == {("agent", "AI & Automation"), ("agents", "AI & Automation"), ("banana", None)}
    runs = spark.createDataFrame([("1", "an agent works"), ("2", None), ("3", "nothing")], "run_id string, text string")
    row = clusters.theme_answers(got, runs).first()
    assert (row["runs_scanned"], row["runs_mentioning"]) == (2, 1)
    answer = '```json\n{"themes": [{"name": "F", "terms": ["banana", "made up"]}, {"name": "G", "terms": ["banana"]}], "unclustered": []}\n```'
    assert {r["theme"] for r in clusters.cluster_terms_by_model(cloud, answer).where("term = 'banana'").collect()} == {"F"}
    assert clusters.parse_themes('[{"name": "F", "terms": ["banana"]}]') == [] and clusters.parse_themes('{"themes": []}') == []
    assert clusters.parse_themes("no json") == [] and clusters.parse_themes(None) == []


def test_sitemap_and_clients(spark, tmp_path):
    docs = spark.createDataFrame([(0, "<urlset><url><loc>https://a.b/</loc><priority>0.8</priority></url><url><x/></url></urlset>")], "ord int, xml string")
    assert [(r["loc"], r["priority"]) for r in sitemap.entries(docs).collect()] == [("https://a.b/", 0.8)]
    tries = iter([(503, ""), (200, "ok")])
    assert clients.fetch_page("u", lambda _: next(tries), wait=lambda _: None)[:3] == (200, "ok", None)
    assert clients.fetch_page("u", lambda _: (404, "x"), wait=lambda _: None)[2] == "HTTP 404"
    store = lake.Lake(spark, str(tmp_path))
    assert store.read("raw", "page") is None and store.products().count() == 0
    store.write("raw", "page", spark.createDataFrame([("p", "u")], "product string, url string"))
    assert [r[0] for r in store.products().collect()] == ["p"]


def test_jobs_end_to_end(spark, tmp_path):
    from brandlens.plans import jobs

    store = lake.Lake(spark, str(tmp_path / "lake"))
    entries = spark.createDataFrame([(0, "https://site.org/", None), (1, "https://site.org/pricing", None), (2, "https://site.org/gone", None)], "ord long, url string, priority double")
    jobs.scrape(store, "p", entries, "User-agent: *\n", lambda u: (404, "") if u.endswith("gone") else (200, PAGE))
    cover = store.read("extracted", "sitemap_coverage").first()
    assert (cover["total_urls"], cover["fetched_urls"], cover["broken_urls"]) == (3, 2, 1)
    jobs.make_questions(store, "p", "Zed", ["A", "B"])
    assert store.read("questions", "hook_question").count() > 0
    text = jobs.audit(store, "p", "Mine", ["Other"], "planning", lambda prompt: "Mine is the best, Other is slow." if "Mine" in prompt else None)
    assert "| Mine | 100% |" in text and "## Priority matrix" in text and "Brand-grounded" not in text
    both = jobs.audit(store, "p", "Mine", ["Other"], "planning", lambda prompt: "Mine is the best.", include="both", question_runs=1, question_limit=4)
    assert "Total runs: 4" in both and "source = hook: 100%" in both and store.read("aeo", "brand_grounded_run").count() == 4
    assert jobs.cluster(store, "p").count() > 0 and store.read("clusters", "theme_answer") is not None


def test_audience_puts_users_first(spark):
    text = "It helps startups and engineering teams plan and track work."
    found = questions.scan_claims(spark.createDataFrame([(1, "u", text)], "ord int, url string, text string")).collect()
    assert [r["audience"][0] for r in found] == ["engineering teams"] and "startup" in found[0]["audience"]


def test_dates_links_and_names_of_meta_tags():
    got = parse_page("https://a.b/", '<meta property="article:published_time"><meta property="author" content="x"><script>{"dateModified" : "1"}</script><a href=""></a><a href="/x"></a>')
    assert (got["has_publish_date"], got["has_update_date"], got["has_author"], got["internal_links"]) == (True, True, False, 1)
    assert parse_page("https://a.b/", '<script>{"datePublished" : "1"}</script>')["has_publish_date"]


def test_site_entries_follow_an_index(spark):
    pages = {
        "https://a.b/sitemap.xml": "<sitemapindex><sitemap><loc>https://a.b/1.xml</loc></sitemap><sitemap><loc>https://a.b/none.xml</loc></sitemap><sitemap><loc>https://a.b/2.xml</loc></sitemap></sitemapindex>",
        "https://a.b/1.xml": "<urlset><url><loc>https://a.b/x</loc></url><url><loc>https://a.b/y</loc><priority>0.9</priority></url></urlset>",
        "https://a.b/2.xml": "<urlset><url><loc>https://a.b/x</loc></url><url><loc>https://a.b/z</loc></url></urlset>",
    }
    fetch = lambda url: (200, pages[url]) if url in pages else (404, "")
    entries, xml = sitemap.site_entries(spark, "https://a.b/sitemap.xml", fetch)
    assert [(r["url"], r["priority"]) for r in entries.orderBy("ord").collect()] == [("https://a.b/x", None), ("https://a.b/y", 0.9), ("https://a.b/z", None)]
    assert "<sitemapindex>" in xml and sitemap.site_entries(spark, "https://a.b/gone.xml", fetch)[0].count() == 0


def test_clients_give_up_where_it_is_no_use():
    calls = []

    def refuse(prompt):
        calls.append(prompt)
        raise clients.ApiError(int(prompt), "no")

    quiet = lambda _: None
    assert clients.ask_model("400", refuse, wait=quiet) == (None, None, "no") and len(calls) == 1
    assert clients.ask_model("429", refuse, wait=quiet)[2] == "no" and len(calls) == 4
    assert clients.ask_model("p", lambda p: ("text", "STOP")) == ("text", "STOP", None)
    import time

    assert clients.fetch_page("u", lambda u: time.sleep(2) or (200, "x"), retries=0, timeout=0.05)[0] is None
    assert clients.robots_text("https://a.b/", lambda u: 1 / 0) == "" and clients.robots_text("https://a.b/", lambda u: (200, u)) == "https://a.b/robots.txt"


def test_lake_documents(spark, tmp_path):
    store = lake.Lake(spark, str(tmp_path))
    path = store.write_text("report", "markdown/p.md", "# é\n")
    assert open(path, encoding="utf-8").read() == "# é\n"
    assert lake.read_json(store, f"{tmp_path}/none.json", "a int") is None and lake.read_all_json(store, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "runs").mkdir()
    for k, text in (("b", None), ("a", "said")):
        (tmp_path / "runs" / f"{k}.json").write_text(__import__("json").dumps({"runId": k, "promptId": "q", "rawText": text}))
    runs = lake.recorded_runs(store, f"{tmp_path}/runs")
    assert [(r["run_id"], r["text"]) for r in runs.collect()] == [("a", "said"), ("b", None)]
    prompts = spark.createDataFrame([("q", "what", "intent")], "id string, text string, intent string")
    assert clients.replay(runs, prompts).where("intent = 'intent'").count() == 2


def test_a_verb_within_a_claim_begins_no_other(spark):
    text = "It reduces erin and restores order for product teams. It helps you Remove all old noise, v2.Improves speed for everyone here."
    found = questions.scan_claims(spark.createDataFrame([(1, "u", text)], "ord int, url string, text string")).collect()
    assert [r["problem"] for r in found] == ["reduce erin and restores order for product teams", "Remove all old noise, v2", "improve speed for everyone here"]


def test_html_signals_leaves_open_references(spark, tmp_path):
    html = '<title>Auf &amp; ab &amp;&amp</title><h1>x</h1><a href="/y?a=1&ref=2">&copy &#39;</a>'
    spark.createDataFrame([(1, "https://a.b/", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    row = catalog.html_signals(spark, str(tmp_path)).first()
    assert row["title"] == "Auf & ab &&amp" and row["internal_link_count"] == 1
    assert parse_page("https://a.b/", html)["title"] == "Auf & ab &&"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_terms_are_counted_on_their_pages_row(spark):
    rows = [("s", 1, "Alpha beta alpha of the beta alpha gamma"), ("s", 2, "beta"), ("t", 1, "beta"), ("s", 3, ""), (None, None, "alpha")]
    counts = tagcloud.term_counts(spark.createDataFrame(rows, "site string, page long, text string"))
    # No page has several rows, so nothing is dealt out to count them.
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    once = [("s", 1, "alpha", 3), ("s", 1, "beta", 2), ("s", 1, "gamma", 1), ("s", 2, "beta", 1), ("t", 1, "beta", 1)]
    assert sorted(tuple(r) for r in counts.where("page IS NOT NULL").collect()) == once and counts.count() == 6
    again = tagcloud.term_counts(spark.createDataFrame([*rows, ("s", 2, "beta delta"), (None, None, "alpha")], "site string, page long, text string"))
    assert _rows(again.where("page = 2")) == [("s", 2, "beta", 2), ("s", 2, "delta", 1)] and again.where("page IS NULL").first()["tf"] == 2


def test_keyword_density_puts_a_pages_rows_together(spark):
    pages = spark.createDataFrame([(1, "beta alpha beta"), (1, "alpha alpha gamma"), (2, "one beta delta")], "page long, text string")
    assert _rows(tagcloud.keyword_density(pages, 2)) == [(1, 1, "alpha", 3, 0.5), (1, 2, "beta", 2, 0.333333), (2, 1, "beta", 1, 0.5), (2, 2, "delta", 1, 0.5)]
    single = tagcloud.keyword_density(pages.where("page = 2"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_phrase_cloud_looks_for_plain_terms_in_one_pass(spark):
    text = "A mask here. No masked one. MASK_x no. MasK no. The café is. Cafés no! mask-up yes."
    pages = spark.createDataFrame([("s", 1, text)], "site string, page long, text string")
    terms = spark.createDataFrame([("s", "mask"), ("s", "cafés"), ("s", "maña")], "site string, term string")
    found = tagcloud.phrase_cloud(pages, terms)
    assert _rows(found.select("term", "pos", "snippet")) == [("cafés", 1, "Cafés no!"), ("mask", 1, "A mask here."), ("mask", 2, "mask-up yes.")]
    assert "rlike(line" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_findings_parse_each_page_once(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.b/", PAGE), (2, "https://a.b/c", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = catalog.findings_priorities(spark, str(tmp_path))
    # Parsing and matching are done when the order is made.
    assert found.count() == 11 and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_keyword_density_sorts_by_what_terms_are_and_not_by_comparing_calls(spark):
    pages = spark.createDataFrame([(1, "beta alpha beta gamma alpha beta"), (2, ""), (3, "solo"), (4, "yes"), (5, "same same same")], "page long, text string")
    found = tagcloud.keyword_density(pages, 2)
    assert "array_sort(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(found) == [(1, 1, "beta", 3, 0.5), (1, 2, "alpha", 2, 0.333333), (3, 1, "solo", 1, 1.0), (5, 1, "same", 3, 1.0)]
    assert [tuple(map(tuple, r["c"])) for r in pages.select(T.counted(T.tokenize("text")).alias("c"), "page").orderBy("page").collect()] == [(("alpha", 2), ("beta", 3), ("gamma", 1)), (), (("solo", 1),), (), (("same", 3),)]
