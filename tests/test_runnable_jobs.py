"""The runnable jobs: growing input, runs again, failures halfway, odd rows, the command line."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import answer_mentions, site_vocabulary

ROOT = Path(__file__).resolve().parent.parent
BRANDS = ["Alpha", "Beta", "Gamma"]
TURNS = "conv_id long, turn long, role string, text string, extra string, batch int"
FIRST = [(1, 0, "user", "Alpha?", "x", 1), (1, 1, "assistant", "Alpha is the best. Beta is slow.", "x", 1), (2, 1, "assistant", None, "x", 1), (3, 1, "assistant", "", None, None)]
SECOND = [(4, 1, "assistant", "Beta, not Alpha.", "x", 1), (5, 1, "assistant", "Nothing here.", None, None), (None, 1, "assistant", "Alpha", None, None), (6, None, "assistant", "Alpha", None, None)]
AGAIN = [(1, 1, "assistant", "Alpha is the best. Beta is slow.", "x", 1), (7, 1, "assistant", "gamma and ALPHA", None, None), (7, 1, "assistant", "gamma and ALPHA", None, None)]


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(folder)


def rows(df):
    return Counter(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def places(tmp_path):
    return tuple(f"{tmp_path}/{name}" for name in ("turns", "out", "checkpoint"))


def at_once(spark, given, tmp_path):
    turns, out, checkpoint = (f"{tmp_path}/once/{name}" for name in ("turns", "out", "checkpoint"))
    arrive(spark, given, turns)
    answer_mentions.run(spark, turns, out, checkpoint, BRANDS)
    return rows(answer_mentions.output(spark, out))


def test_only_new_files_are_taken(spark, places, tmp_path):
    turns, out, checkpoint = places
    arrive(spark, FIRST, turns)
    assert answer_mentions.run(spark, *places, BRANDS) == {"batches": 1, "read": 4, "runs": 2, "mentions": 2, "all_runs": 2}
    arrive(spark, SECOND, turns)
    assert answer_mentions.run(spark, *places, BRANDS) == {"batches": 1, "read": 4, "runs": 2, "mentions": 2, "all_runs": 4}
    got = rows(answer_mentions.output(spark, out))
    assert got == at_once(spark, FIRST + SECOND, tmp_path) and sum(got.values()) == 4
    arrive(spark, AGAIN, turns)
    assert answer_mentions.run(spark, *places, BRANDS)["all_runs"] == 5
    numbers = {r["brand"]: r for r in spark.read.parquet(f"{out}/metric").collect()}
    assert {b: (r["mention_count"], r["run_count"]) for b, r in numbers.items()} == {"Alpha": (3, 5), "Beta": (2, 5), "Gamma": (1, 5)}
    assert abs(numbers["Alpha"]["share_of_voice"] - 0.6) < 1e-9
    before = rows(answer_mentions.output(spark, out))
    assert answer_mentions.run(spark, *places, BRANDS)["batches"] == 0
    assert rows(answer_mentions.output(spark, out)) == before


def test_a_batch_that_failed_halfway_is_taken_again(spark, places, tmp_path, monkeypatch):
    turns, out, checkpoint = places
    arrive(spark, FIRST, turns)
    answer_mentions.run(spark, *places, BRANDS)
    arrive(spark, SECOND, turns)
    with monkeypatch.context() as broken:
        broken.setattr(answer_mentions, "mentions", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision"):
            answer_mentions.run(spark, *places, BRANDS)
    answer_mentions.run(spark, *places, BRANDS)
    assert rows(answer_mentions.output(spark, out)) == at_once(spark, FIRST + SECOND, tmp_path)


def test_small_micro_batches_give_the_same(spark, places, tmp_path):
    turns, out, checkpoint = places
    for part in (FIRST, SECOND, AGAIN):
        arrive(spark, part, turns)
    kept = dict(spark.sparkContext.getConf().getAll())
    assert answer_mentions.run(spark, *places, BRANDS, files=1)["batches"] >= 3
    assert rows(answer_mentions.output(spark, out)) == at_once(spark, FIRST + SECOND + AGAIN, tmp_path)
    assert dict(spark.sparkContext.getConf().getAll()) == kept


def test_no_answers_at_all(spark, places):
    turns, out, checkpoint = places
    arrive(spark, [], turns)
    assert answer_mentions.run(spark, *places, BRANDS)["all_runs"] == 0
    assert answer_mentions.output(spark, out).count() == 0


PAGES = "doc_id long, text string, source string, site string, rank int"
GIVEN = [(1, "apples apples pears", "a", "x", 1), (2, "plums", "a", "x", 1), (3, None, "b", None, None), (4, "figs plums", None, None, None), (4, "figs plums", None, None, None)]


def vocabulary(spark, tmp_path, given, **more):
    documents, turns = f"{tmp_path}/documents", f"{tmp_path}/turns"
    spark.createDataFrame(given, PAGES).write.mode("overwrite").parquet(documents)
    arrive_once = spark.createDataFrame([(1, 1, "assistant", "Apples, apples and figs.", None, None), (2, 1, "assistant", None, None, None), (3, 0, "user", "pears", None, None)], TURNS)
    arrive_once.write.mode("overwrite").parquet(turns)
    counts = site_vocabulary.run(spark, documents, turns, f"{tmp_path}/out", **more)
    return counts, rows(site_vocabulary.output(spark, f"{tmp_path}/out")), {r["site"]: r for r in spark.read.schema(site_vocabulary.SUMMARY).parquet(f"{tmp_path}/out/summary").collect()}


def test_vocabulary_of_sites(spark, tmp_path):
    counts, got, sites = vocabulary(spark, tmp_path, GIVEN)
    assert counts == {"sites": 3, "pages": 5, "terms": 5}
    assert (sites["a"]["gap_terms"], sites["a"]["covered_terms"], sites["a"]["words"]) == (["plums", "pears"], 1, 4) or sites["a"]["gap_terms"] == ["pears", "plums"]
    assert (sites["b"]["pages"], sites["b"]["terms"], sites["b"]["gap_terms"]) == (1, 0, [])
    assert sites["(none)"]["pages"] == 2 and sites["(none)"]["gap_terms"] == ["plums"]
    assert vocabulary(spark, tmp_path, GIVEN)[:2] == (counts, got)


def test_a_run_over_one_site_leaves_the_others(spark, tmp_path):
    _, before, _ = vocabulary(spark, tmp_path, GIVEN)
    grown = [*GIVEN, (9, "melons", "a", None, None), (10, "melons", "b", None, None)]
    counts, _, sites = vocabulary(spark, tmp_path, grown, sites=["b"])
    assert counts == {"sites": 1, "pages": 2, "terms": 1} and sites["b"]["gap_terms"] == ["melons"]
    assert sites["a"]["pages"] == 2 and sites["(none)"]["pages"] == 2
    _, whole, _ = vocabulary(spark, tmp_path, grown)
    assert whole != before and vocabulary(spark, tmp_path, grown)[1] == whole
    assert vocabulary(spark, f"{tmp_path}/empty", [])[0] == {"sites": 0, "pages": 0, "terms": 0}


def test_command_line(spark, tmp_path):
    arrive(spark, FIRST, f"{tmp_path}/turns")
    (tmp_path / "mine.json").write_text(json.dumps({"brands": BRANDS}))
    words = ["--turns", f"{tmp_path}/turns", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/mine.json"]
    for want in (1, 0):
        done = subprocess.run([sys.executable, "-m", "jobs.answer_mentions", *words], cwd=ROOT, capture_output=True, text=True, check=True)
        assert json.loads(done.stdout.strip().splitlines()[-1])["batches"] == want
        assert "metrics of 3 brands" in done.stderr
