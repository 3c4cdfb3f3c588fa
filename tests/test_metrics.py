from brandlens.operators import metrics

BRANDS = ["Alpha", "Beta"]


def mentions_of(spark, text):
    runs = spark.createDataFrame([("r", text)], "run_id string, text string")
    return metrics.extract_mentions(runs, BRANDS).orderBy("position").collect()


def test_order_and_role(spark):
    got = mentions_of(spark, "Beta is the best choice, and some like alpha.")
    assert [(r["brand"], r["position"], r["role"]) for r in got] == [("Beta", 1, "recommended_first"), ("Alpha", 2, "mentioned")]
    assert got[0]["sentiment"] == "positive"


def test_discarded_is_negative(spark):
    (row,) = mentions_of(spark, "I would not recommend Alpha, though it is great.")
    assert (row["role"], row["sentiment"]) == ("discarded", "negative")


def test_comparison_and_repeats(spark):
    (row,) = mentions_of(spark, "Alpha vs others. Alpha again.")
    assert row["role"] == "compared"


def test_nothing_found(spark):
    assert mentions_of(spark, "") == [] and mentions_of(spark, None) == []


def test_metrics_of_four_runs(spark):
    rows = [("1", "Alpha", 1, "positive"), ("1", "Beta", 2, "negative"), ("2", "Alpha", 2, "positive"), ("2", "Beta", 1, "neutral"), ("3", "Alpha", 1, "neutral")]
    found = spark.createDataFrame(rows, "run_id string, brand string, position long, sentiment string")
    got = {r["brand"]: r for r in metrics.brand_metrics(found, 4, metrics.brand_table(spark, BRANDS)).collect()}
    a, b = got["Alpha"], got["Beta"]
    assert (a["share_of_voice"], b["share_of_voice"]) == (0.75, 0.5)
    assert a["relative_share_of_voice"] == 1.5 and abs(b["relative_share_of_voice"] - 2 / 3) < 1e-9
    assert abs(a["average_position"] - 4 / 3) < 1e-9 and b["average_position"] == 1.5
    assert (a["first_mention_rate"], b["first_mention_rate"]) == (0.5, 0.25)
    assert abs(a["sentiment_score"] - 2 / 3) < 1e-9 and b["sentiment_score"] == -0.5
    assert (a["mention_count"], b["mention_count"]) == (3, 2)
    pairs = {(r["brand"], r["other_brand"]): r["count"] for r in metrics.co_occurrence(found).collect()}
    assert pairs == {("Alpha", "Beta"): 2, ("Beta", "Alpha"): 2}


def test_no_runs(spark):
    none = spark.createDataFrame([], "run_id string, brand string, position long, sentiment string")
    got = metrics.brand_metrics(none, 0, metrics.brand_table(spark, BRANDS)).collect()
    assert [(r["share_of_voice"], r["average_position"], r["sentiment_score"]) for r in got] == [(0.0, None, 0.0)] * 2


def test_breakdown_is_dense(spark):
    runs = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", None)], "run_id string, stage string")
    found = spark.createDataFrame([("1", "Alpha"), ("3", "Alpha"), ("3", "Beta")], "run_id string, brand string")
    got = {(r["value"], r["brand"]): (r["share_of_voice"], r["run_count"]) for r in metrics.dimension_breakdown(runs, found, metrics.brand_table(spark, BRANDS), ["stage"]).collect()}
    assert got == {("x", "Alpha"): (0.5, 2), ("x", "Beta"): (0.0, 2), ("y", "Alpha"): (1.0, 1), ("y", "Beta"): (1.0, 1)}
