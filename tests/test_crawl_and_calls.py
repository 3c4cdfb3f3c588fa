"""The crawl frontier, the log of calls, numbering, robots rules by prefix, many names at once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brandlens.operators import metrics, needles, site
from brandlens.operators.numbering import number
from brandlens.plans import jobs
from brandlens.sources import clients, sitemap
from brandlens.sources.call_log import CallLog
from brandlens.sources.lake import Lake


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


SITE = {
    "r": index("b", "a", "r", "gone", "a"),
    "a": index("deep", "c"),
    "b": urlset("p1", "p2"),
    "c": urlset("p2", "p3"),
    "deep": index("deeper", "b"),
    "deeper": index("too-deep"),
    "too-deep": urlset("never"),
}


def counting(folder):
    """A client over SITE that leaves a file a call: tasks run in processes of their own."""

    def fetch(url):
        import uuid

        with open(f"{folder}/{url}-{uuid.uuid4().hex}", "w"):
            pass
        return (200, SITE[url]) if url in SITE else (404, "")

    return fetch


def calls(folder):
    return Counter(p.name.rsplit("-", 1)[0] for p in folder.iterdir())


def test_each_sitemap_is_fetched_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    entries, xml = sitemap.site_entries(spark, "r", counting(f"{tmp_path}/calls"), f"{tmp_path}/crawl")
    assert [r["url"] for r in entries.orderBy("ord").collect()] == ["p1", "p2", "p3"] and xml == SITE["r"]
    assert [r["ord"] for r in entries.orderBy("ord").collect()] == [0, 1, 2]
    entries.count()
    # Four levels: what the last index names is not read; a URL that fails is tried once, as a 404 is final.
    assert calls(tmp_path / "calls") == Counter(["r", "a", "b", "gone", "c", "deep", "deeper"])
    again, _ = sitemap.site_entries(spark, "r", counting(f"{tmp_path}/calls"), f"{tmp_path}/crawl")
    assert again.count() == 3 and sum(calls(tmp_path / "calls").values()) == 7


def test_a_crawl_goes_on_where_it_ended(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    roots = spark.createDataFrame([([0], "r")], "path array<int>, url string")
    fetch = lambda urls: clients.documents(urls, counting(f"{tmp_path}/calls"))
    levels = []

    def broken(urls):
        levels.append(1)
        if len(levels) == 3:
            raise RuntimeError("stopped")
        return fetch(urls)

    with pytest.raises(RuntimeError, match="stopped"):
        sitemap.crawl_index(roots, broken, f"{tmp_path}/crawl")
    found = sitemap.crawl_index(roots, fetch, f"{tmp_path}/crawl")
    assert sitemap.index_entries(found).count() == 3 and set(calls(tmp_path / "calls").values()) == {1}
    nothing = sitemap.crawl_index(roots.limit(0), fetch, f"{tmp_path}/nothing")
    assert sitemap.index_entries(nothing).count() == 0


PROMPTS = [(f"q{k}", f"What of {k}?", "intent") for k in range(20)]


def asking(folder, fail=()):
    def ask(prompt):
        import uuid

        with open(f"{folder}/{prompt.split()[-1][:-1]}-{uuid.uuid4().hex}", "w"):
            pass
        if prompt in fail:
            raise clients.ApiError(400, "no")
        return "said " + prompt

    return ask


def test_recorded_calls_are_not_made_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame(PROMPTS, "id string, text string, intent string")
    log = CallLog(spark, f"{tmp_path}/log")
    log.record(spark.createDataFrame([("q0", 1, "known")], "prompt_id string, rep int, text string"))
    assert log.ask(prompts.limit(5), asking(f"{tmp_path}/calls"), runs=2, calls=3) == 9

    # A job killed halfway: some batches are written, then the driver ends.
    made, record = [], CallLog.record

    class Killed(CallLog):
        def record(self, runs, batch="recorded"):
            made.append(batch)
            if len(made) == 3:
                raise KeyboardInterrupt
            record(self, runs, batch)

    with pytest.raises(KeyboardInterrupt):
        Killed(spark, f"{tmp_path}/log").ask(prompts, asking(f"{tmp_path}/calls"), runs=2, calls=6)
    left = CallLog(spark, f"{tmp_path}/log").pending(prompts, 2).count()
    assert 0 < left < 30
    assert CallLog(spark, f"{tmp_path}/log").ask(prompts, asking(f"{tmp_path}/calls"), runs=2, calls=6) == left
    assert calls(tmp_path / "calls") == Counter({str(k): 1 if k == 0 else 2 for k in range(20)})
    runs = log.runs(prompts)
    assert runs.columns == ["prompt_id", "prompt_text", "intent", "run_id", "temperature", "timestamp", "finish_reason", "text", "error"]
    assert runs.count() == 40 and runs.where("run_id = 'q0#1'").first()["text"] == "known"
    assert log.ask(prompts, asking(f"{tmp_path}/calls"), runs=2) == 0


def test_failed_calls_can_be_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame(PROMPTS[:3], "id string, text string, intent string")
    log = CallLog(spark, f"{tmp_path}/log")
    log.ask(prompts, asking(f"{tmp_path}/calls", fail=["What of 1?"]), runs=1)
    assert {r["prompt_id"]: r["error"] for r in log.read().collect()} == {"q0": None, "q1": "no", "q2": None}
    assert log.ask(prompts, asking(f"{tmp_path}/calls"), runs=1) == 0
    assert log.ask(prompts, asking(f"{tmp_path}/calls"), runs=1, failed_again=True) == 1
    assert log.read().where("text IS NULL").count() == 0 and log.read().count() == 3


def test_an_audit_is_taken_up_by_its_log(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    lake = Lake(spark, f"{tmp_path}/lake")
    entries = spark.createDataFrame([(0, "https://site.org/", 0.5)], "ord long, url string, priority double")
    jobs.scrape(lake, "p", entries, "", lambda url: (200, "<html><body><h1>A</h1><p>Words.</p></body></html>"), cap=None)
    audit = lambda log: jobs.audit(lake, "p", "What", ["Beta"], "tracking", asking(f"{tmp_path}/calls"), prompts=4, runs=2, log=log, tasks=2)
    audit("one")
    first = calls(tmp_path / "calls")
    audit("one")
    assert calls(tmp_path / "calls") == first and sum(first.values()) == 8 and lake.read("aeo", "run").count() == 8
    audit(None)
    assert sum(calls(tmp_path / "calls").values()) == 16


def test_numbers_follow_the_order(spark):
    draw = random.Random(3)
    rows = [(draw.randint(0, 40), f"t{k}") for k in range(3000)] + [(None, f"n{k}") for k in range(5)] + [(7, f"hot{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = number(df, F.col("a").desc_nulls_last(), "b").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["ord"])] == want and sorted(r["ord"] for r in got) == list(range(1, len(rows) + 1))
    assert number(df.limit(0), "a", name="n").collect() == []
    dotted = number(df.limit(3).withColumnRenamed("b", "b.c"), "a", "`b.c`", name="a")
    assert dotted.columns == ["a", "b.c"] and sorted(r["a"] for r in dotted.collect()) == [1, 2, 3]
    plan = number(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_rules_by_prefix_agree_with_rules_by_list(spark):
    draw = random.Random(4)
    part = lambda: "/" + "".join(draw.choice("ab/") for _ in range(draw.randint(0, 6)))
    files = [(s, "User-agent: *\n" + "".join(f"{draw.choice(['Allow', 'Disallow'])}: {part()}\n" for _ in range(80))) for s in "xy"] + [("z", "")]
    urls = [(k, draw.choice(["x", "y", "z", "none", None]), f"https://h.org{part()}") for k in range(400)] + [(900, "x", "no url"), (901, "x", None), (902, "y", "https://h.org")]
    rules = site.robots_rules(spark.createDataFrame(files, "site string, content string"))
    df = spark.createDataFrame(urls, "id long, site string, url string").repartition(3)
    by_list, by_prefix = (Counter(map(tuple, f(df, rules).select("id", "site", "url", "allowed").collect())) for f in (site.robots_allowed, site.robots_allowed_by_prefix))
    assert by_list == by_prefix and len(by_list) == 403
    assert 0 < sum(r[3] for r in by_prefix) < 400
    assert site.robots_allowed_by_prefix(df, rules.limit(0)).where("allowed").count() == 401


def every_place(text, needle):
    found, at = [], text.lower().find(needle.lower()) if needle else -1
    while at >= 0:
        found.append(at + 1)
        at = text.lower().find(needle.lower(), at + len(needle))
    return found


def test_all_places_of_many_names(spark):
    draw = random.Random(5)
    names = ["aa", "a", "ab", "BA", "b😀", "ñ", "", "zz"] + [f"x{k}" for k in range(300)]
    texts = [(k, "".join(draw.choice(["a", "B", "b😀", "Ñ", "x1", " ", "2"]) for _ in range(draw.randint(0, 60)))) for k in range(200)] + [(500, None), (501, ""), (502, "aa" * 5000)]
    got = needles.find_all(spark.createDataFrame(texts, "run_id long, text string").repartition(3), names).collect()
    want = {(i, n): every_place(t, n) for i, t in texts if t for n in names if every_place(t, n)}
    assert {(r["run_id"], r["name"]): r["positions"] for r in got} == want and len(got) == len(want)
    assert needles.find_all(spark.createDataFrame(texts, "run_id long, text string"), []).count() == 0


def test_mentions_by_automaton_are_those_by_search(spark):
    rows = [(1, "Beta is best. alpha is slow"), (2, None), (3, "gamma " * 40 + "vs Alpha"), (4, "none")]
    runs, brands = spark.createDataFrame(rows, "run_id long, text string"), ["Alpha", "Beta", "Gamma", "Beta", ""]
    one, other = (Counter(map(tuple, f(runs, brands).collect())) for f in (metrics.extract_mentions, needles.extract_mentions_of_many))
    assert one == other and sum(one.values()) == 4
