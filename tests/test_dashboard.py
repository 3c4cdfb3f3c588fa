"""Product facts and picks, bars, nested and ordered results, the SQL table function."""

from collections import Counter

from pyspark.sql import functions as F

from brandlens.functions import sql
from brandlens.operators import clusters, dashboard, metrics, nested

BRANDS = ["Alpha", "Beta"]


def facts_of(spark, rows):
    """Facts of products whose runs are (product, run_id, text, specificity)."""
    runs = spark.createDataFrame(rows, "product string, run_id string, text string, specificity string")
    owners = spark.createDataFrame([("p", "Alpha"), ("q", "Beta"), ("r", "Beta")], "product string, brand string")
    return dashboard.product_facts(runs, metrics.extract_mentions(runs, BRANDS), metrics.brand_table(spark, BRANDS), owners)


def test_facts_are_replaced_by_product(spark, tmp_path):
    path = f"{tmp_path}/fact"
    first = [("p", "1", "alpha", "generic"), ("p", "2", "beta", "specific"), ("q", "3", "none", "specific"), ("q", "4", "alpha beta", "generic")]
    dashboard.replace_facts(facts_of(spark, first), path)
    rows = {r["product"]: r for r in dashboard.read_facts(spark, path).collect()}
    assert (rows["p"]["share_of_voice"], rows["p"]["runs"], rows["q"]["mention_count"]) == (0.5, 2, 1) and "r" not in rows
    assert [tuple(g) for g in rows["p"]["generic"]] == [("Alpha", 1.0), ("Beta", 0.0)]
    dashboard.replace_facts(facts_of(spark, [("q", "5", "beta", "specific")]), path)
    now = dashboard.read_facts(spark, path)
    rows = {r["product"]: r for r in now.collect()}
    assert rows["p"]["runs"] == 2 and rows["q"]["share_of_voice"] == 1.0 and [g["share_of_voice"] for g in rows["q"]["generic"]] == [0.0, 0.0]
    products = spark.createDataFrame([("p", 3), ("q", 1), ("r", 9)], "product string, pages int")
    told = {r["product"]: (r["reported"], r["runs"]) for r in dashboard.product_summary(products, now).collect()}
    assert told == {"p": (True, 2), "q": (True, 1), "r": (False, None)}
    audit = dashboard.cross_audit(now, "p")
    assert {(r["label"], r["value"], r["highlighted"]) for r in audit.collect()} == {("Alpha", 1.0, True), ("Beta", 0.0, False)}
    assert dashboard.cross_audit(now, "r").count() == 0


def test_bars_are_sorted_before_rounding(spark):
    data = spark.createDataFrame([("a", 0.104), ("b", 0.1), ("c", 0.995), ("d", 0.104), ("e", 0.005)], "label string, value double")
    got = [tuple(r) for r in dashboard.bars(data, "label").orderBy("place").select("label", "place", "percent").collect()]
    assert got == [("c", 1, 100), ("a", 2, 10), ("d", 3, 10), ("b", 4, 10), ("e", 5, 1)]


def test_priorities_that_a_dashboard_shows(spark):
    rows = [("geo", "g", "high", "low", "x"), ("seo", "s", "medium", "low", "x"), ("seo", "t", "low", "low", "x"), ("aeo", "a", "high", "high", "x"), ("seo", "h", "high", "low", "x")]
    found = spark.createDataFrame(rows, "dimension string, finding string, impact string, effort string, suggested_action string")
    assert [r["finding"] for r in dashboard.top_priorities(found).orderBy("place").collect()] == ["h", "g", "a", "s"]


def test_prompts_with_pages_of_runs(spark):
    prompts = spark.createDataFrame([("a", "A?"), ("b", "B?"), ("c", "C?")], "prompt_id string, prompt string")
    runs = spark.createDataFrame([("a", f"r{k:03}", "t" * (k * 50)) for k in range(7)] + [("b", "x", None)], "prompt_id string, run_id string, text string").repartition(4)
    got = sorted(nested.prompt_runs(prompts, runs, page=3).collect(), key=lambda r: (r["prompt_id"], r["page"]))
    assert [(r["prompt_id"], r["page"], r["n"], len(r["runs"])) for r in got] == [("a", 0, 7, 3), ("a", 1, 7, 3), ("a", 2, 7, 1), ("b", 0, 1, 1), ("c", 0, 0, 0)]
    assert [x["run_id"] for r in got for x in r["runs"]] == [f"r{k:03}" for k in range(7)] + ["x"]
    assert got[2]["runs"][0]["text"] == "t" * nested.SHOWN + "…" and got[3]["runs"][0]["text"] is None


def test_grouped_runs_keep_the_first_attributes(spark):
    rows = [(3, "b", "r3", "x", "late"), (1, "b", "r1", "x", "early"), (2, "a", "r2", "x", None), (4, "a", "r4", "x", "other")]
    got = nested.grouped_runs(spark.createDataFrame(rows, "ord long, prompt_id string, run_id string, text string, stage string"), ["stage"]).orderBy("place").collect()
    assert [(r["prompt_id"], r["stage"], [x["run_id"] for x in r["runs"]]) for r in got] == [("b", "early", ["r1", "r3"]), ("a", None, ["r2", "r4"])]


def test_ties_go_by_first_appearance(spark):
    rows = [(1, 1, "A"), (1, 2, "C"), (1, 3, "B"), (2, 1, "B"), (2, 2, "A"), (3, 1, "D"), (4, 1, "A"), (4, 2, "C")]
    brands = spark.createDataFrame([(b,) for b in "ABCDE"], "brand string")
    got = {r["brand"]: [tuple(o) for o in r["others"]] for r in nested.co_occurrence_lists(spark.createDataFrame(rows, "run_ord long, position int, brand string"), brands).collect()}
    assert got == {"A": [("C", 2), ("B", 2)], "B": [("A", 2), ("C", 1)], "C": [("A", 2), ("B", 1)], "D": [], "E": []}


def test_themes_in_order(spark):
    rows = [("x", "t1", 2.0, 3), ("x", "t2", 2.0, 1), ("y", "t3", 4.0, 2), (None, "t4", 9.0, 4), ("z", "t5", 1.0, 5)]
    found = spark.createDataFrame(rows, "theme string, term string, score double, rank int")
    got = [(r["place"], r["theme"], r["terms"]) for r in nested.theme_lists(found).orderBy("place").collect()]
    assert got == [(1, "x", ["t2", "t1"]), (2, "y", ["t3"]), (3, "z", ["t5"])]
    asked = spark.createDataFrame([("x", "q1"), ("y", "q1")], "theme string, id string")
    answers = clusters.theme_answers(found, spark.createDataFrame([("1", "only t3 here"), ("2", "x")], "run_id string, text string"))
    total = nested.cluster_totals(found, found.limit(0), asked, answers).first()
    assert tuple(total) == (3, 1, 0, 0, 2, 0)


def test_table_function_in_sql(spark):
    rows = [(1, "Beta is the best. I would not recommend alpha, it's slow."), (2, None), (3, "alpha vs BETA"), (4, "nothing")]
    runs = spark.createDataFrame(rows, "run_id int, text string")
    sql.register(spark)
    got = spark.sql("SELECT run_id, m.* FROM {runs}, LATERAL mentions(text, array('Alpha', 'Beta', 'Alpha', '')) m", runs=runs)
    want = metrics.extract_mentions(runs, ["Alpha", "Beta", "Alpha", ""])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.columns == want.columns
    assert got.where(F.col("role") == "discarded").count() > 0


def test_theme_answers_do_not_copy_texts_or_ship_the_runs(spark):
    found = spark.createDataFrame([("a", "alpha", 3.0), ("a", "beta", 2.0), ("b", "gamma", 1.0), (None, "delta", 1.0)], "theme string, term string, score double")
    texts = [("r1", "Here beta, then alpha"), ("r2", "gamma Alpha"), ("r3", None), ("r4", "none of them"), ("r5", "x alpha"), ("r6", "y alpha")]
    out = clusters.theme_answers(found, spark.createDataFrame(texts, "run_id string, text string"))
    assert {r["theme"]: tuple(r)[1:] for r in out.collect()} == {"a": (5, 4, ["Here beta, then alpha", "gamma Alpha", "x alpha"]), "b": (5, 1, ["gamma Alpha"])}
    asked = clusters.theme_questions(found, spark.createDataFrame(texts, "id string, text string"))
    assert sorted(map(tuple, asked.collect())) == [("a", "r1"), ("a", "r2"), ("a", "r5"), ("a", "r6"), ("b", "r2")]
    # The runs are a small file here; what is broadcast must be the list of terms all the same.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(" not in plan and "Join Inner, rightHint=(strategy=broadcast)" in plan


def test_order_mentions_with_nulls_as_in_sql_and_in_bounded_tasks(spark, tmp_path, monkeypatch):
    import duckdb

    from brandlens.plans import answer_queries, catalog, oracles

    lines = [(k // 4, k * 7 % 11, None if k % 13 == 5 else k % 3, None if k % 17 == 3 else "ANRZMP"[k % 6]) for k in range(400)]
    lines += [(None, 1, 1, "N"), (None, 2, 2, "R"), (200, 1, 5, None), (200, 1, 5, "R"), (201, 1, None, "R"), (201, 1, None, "A"), (201, 2, 3, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 7}") for k in range(11)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(102).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(catalog, "LINES", 40)
    # Tasks grow in number with the lines, not in size.
    assert catalog._order_mentions(spark, str(tmp_path)).rdd.getNumPartitions() == len(lines) // 40 + 1
    base = duckdb.connect()
    for table in ("lineitem", "part", "orders"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    every = answer_queries.ORACLE | oracles.ORACLE
    key = lambda row: [str(x) for x in row]
    for name, query in (("cooccurrence_lists", answer_queries.cooccurrence_lists), ("brand_metrics_orders", catalog.brand_metrics_orders)):
        got = sorted((tuple(r) for r in query(spark, str(tmp_path)).collect()), key=key)
        names = ", ".join(query(spark, str(tmp_path)).columns)
        want = sorted((tuple(r) for r in base.execute(f"SELECT {names} FROM ({every[name]})").fetchall()), key=key)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert all(abs(x - y) < 1e-5 if isinstance(x, float) else x == y for x, y in zip(a, b)), (name, a, b)
    plan = answer_queries.cooccurrence_lists(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
