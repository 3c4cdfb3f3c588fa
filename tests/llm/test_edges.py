"""Rows that repeat, null ids, hot keys, clashing names, empty tables, long texts, and quality on the given tables."""

import json
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from brandlens.llm import op01_mixing, op02_likelihood, op03_tokens, op04_lattice_hash, op05_sharding, op06_weak_labels, op07_near_dedup, op08_language, op09_rules, textnum  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GIVEN = Path("/root/testdata/sf0.01")


def test_mix_meets_the_target_where_all_rows_share_an_id(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * draw.randint(1, 30)) + f" {k}", None, s, 0) for k, (i, s) in enumerate([(None, "hot")] * 600 + [(7, "b")] * 300)]
    rows += [(None, "same text of six words here", None, "hot", 0)] * 400
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    taken, target, most = Counter(), {}, defaultdict(int)
    for r in op01_mixing.mix(df).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]], most[r["source"]] = r["target"], max(most[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in target)
    mixed = op01_mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    assert words == taken


def test_inclusion_probabilities_expect_the_rest(spark):
    draw = random.Random(2)
    rows = [(k, " ".join(["w"] * draw.choice([1, 5, 9, 400])), None, "ab"[k % 2], 0) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    from brandlens.llm.storage import Stash

    stash = Stash(spark, "test")
    sized = stash.put("s", docs.select("doc_id", "source", op01_mixing.n_words().alias("size"), op01_mixing.uniform(F.col("doc_id"), F.col("text")).alias("u"), F.col("doc_id").alias("row")))
    found = op01_mixing._Cuts(stash, sized, (5, 2, 1), 1.5, 2, 64).ranked(sized).collect()
    for s in "ab":
        mine = [r for r in found if r["source"] == s]
        if mine[0]["rest"] > 0:
            assert abs(sum(r["inclusion"] * r["size"] for r in mine) - mine[0]["rest"]) < 1e-6 * mine[0]["rest"] + 1e-6
            assert all(0 < r["inclusion"] <= 1 for r in mine)


def test_lattice_beats_the_base_on_unseen_compounds(spark):
    draw = random.Random(3)
    parts = ["th", "ing", "er", "on", "an", "re", "ed", "tion", "es", "in", "st", "ly"]
    rows = [(k, " ".join("".join(draw.choice(parts) for _ in range(4)) for _ in range(draw.randint(20, 200))), "en", "a", 0) for k in range(300)]
    rows += [(5000 + k, None, None, None, None) for k in range(3)] + [(1, "equal rows", "en", "a", 0)] * 40 + [(6000, "long " * 900_000, "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = op02_likelihood.score(df, P.path("piece_bpe_32k.model"), group_bytes=100_000).collect()
    assert len(got) == len(rows)
    own = [r for r in got if r["held_out"] and 20 < r["n_tokens"] < 1000]
    assert len(own) > 20 and sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
    assert {r["n_tokens"] for r in got if r["doc_id"] == 6000} == {900_001} and len({r["score"] for r in got if r["doc_id"] == 1 and r["n_tokens"] == 3}) == 1


def test_segments_cut_long_texts_at_white_space():
    texts = ["ab cd", "x" * 50 + " " + "yy " * 100, None, ""]
    found = Counter()
    for low, high, buf, offsets in textnum.segments(pa.array(texts), 32):
        starts, ends, rows = textnum.words(buf, offsets)
        for s, e, r in zip(starts, ends, rows):
            found[low + r, bytes(buf[s:e])] += 1
    assert found == Counter({(0, b"ab"): 1, (0, b"cd"): 1, (1, b"x" * 50): 1, (1, b"yy"): 100})


def test_tokens_of_pieces_of_many_chunks():
    path, draw = P.path("byte_bpe_50k.json"), random.Random(4)
    library = tokenizers.Tokenizer.from_file(path)
    syllables = "".join(draw.choice(["th", "er", "ing", "tion", "ou", "ABC", "Q"]) for _ in range(600_000))
    given = ["a" * 100_000, "ab" * 50_000, "".join(draw.choice("abcdefghij") for _ in range(20_000)), "!" * 3000 + "é" * 3000, syllables, "q "]
    for most in (1 << 17, 300):
        machine = op03_tokens.Transducer(json.load(open(path)), most_states=most)
        some = given if most > 300 else [g[:2000] for g in given]
        (_, _, buf, offsets), = textnum.groups(pa.array(some), 1 << 30)
        assert machine.counts(buf, offsets).tolist() == [len(library.encode(t).ids) for t in some]


def test_vectors_with_labels_of_any_type(spark):
    rows = [(k, [1.0, 0.001 * k], "a" if k % 2 else "b") for k in range(20)] + [(50, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op04_lattice_hash.near_vectors(df).collect()}
    assert got[50] == (0, 50) and all(got[k] == (9, 1 if k % 2 else 0) for k in range(20))
    split = df.withColumn("label", F.when(F.col("label") == "a", 1.25).otherwise(1.5))
    assert {r["component_id"] for r in op04_lattice_hash.near_vectors(split.where("vec_id < 20")).collect()} == {0, 1}
    assert op04_lattice_hash.near_vectors(df.limit(0)).count() == 0


def test_shards_hold_equal_bytes_and_equal_texts(spark):
    draw = random.Random(5)
    rows = [(k, "word " * draw.randint(0, 60), None, None, None) for k in range(1500)] + [(9, "hot row", None, None, None)] * 700 + [(9000 + k, "hot text of many", None, None, None) for k in range(700)]
    got = op05_sharding.shard(spark.createDataFrame(rows, DOCS), ranges=32).collect()
    total, largest, by, of = sum(r["size"] for r in got), max(r["size"] for r in got), Counter(), defaultdict(set)
    for r in got:
        by[r["shard"]] += r["size"]
        of[r["text_crc32"]].add(r["shard"])
    assert sorted(by) == list(range(16)) and all(abs(b - total / 16) <= largest for b in by.values())
    # Equal texts lie side by side: only those of a group longer than what is left of a shard are in more than one.
    share = Counter(r["text_crc32"] for r in got)
    size = {r["text_crc32"]: r["size"] for r in got}
    assert all(max(s) - min(s) <= share[c] * size[c] // (total // 16) + 1 for c, s in of.items())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_language_sample_is_bounded_for_any_ids(spark):
    rows = [(None, f"the row {k}", "en", "a", 0) for k in range(5000)] + [(None, "one text", "de", "a", 0)] * 3000 + [(k, f"la fila {k}", "es", "a", 0) for k in range(50)]
    got = op08_language.sample(spark.createDataFrame(rows, DOCS).repartition(4))
    assert Counter(lang for _, lang in got) == {"en": op08_language.ROWS, "de": op08_language.ROWS, "es": 50}


def test_every_language_is_learned(spark):
    names = ["en", *[f"l{k}" for k in range(400)]]
    rows = [(k, f"text {names[k % 401]} {k}", names[k % 401], "a", 0) for k in range(401 * 4)] + [(9000 + k, "the only rows " * 2000 + str(k), "xx", "a", 0) for k in range(3)]
    got = Counter(lang for _, lang in op08_language.sample(spark.createDataFrame(rows, DOCS).repartition(3), all_rows=900))
    assert set(got) == {*names, "xx"} and max(got.values()) == 2


def test_weak_label_sample_takes_repeated_rows_once(spark):
    good = "the river and the house of the old town was in the blue light that is for all to see on a day " * 3
    rows = [(1, good, None, None, None)] * 3000 + [(k, good + str(k), None, None, None) for k in range(2, 60)] + [(100 + k, "$$$$ **** ### zzz " * 20 + str(k), None, None, None) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = op06_weak_labels.classify(df).collect()
    assert len(got) == len(rows)
    assert min(r["score"] for r in got if r["doc_id"] < 100) > max(r["score"] for r in got if r["doc_id"] >= 100)
    assert all(r["kept"] == (r["doc_id"] < 100) for r in got)


@pytest.mark.parametrize(
    "keep", [op01_mixing.mix_documents, op07_near_dedup.keep_documents, op08_language.keep_documents, op09_rules.keep_documents], ids=["mix", "near", "language", "rules"]
)
def test_stages_leave_columns_of_clashing_names_alone(spark, keep):
    names = ["_hash", "_k_id", "_own_hash", "_id_lang_pred", "_id_score", "_read", "_m_copy", "_m_id", "_rule_once", "_rule_kept", "row", "own", "copies", "size", "score", "a.b", "c`d", "lang.x"]
    text = "the river and the house of the old town was in the blue light that is for all to see on a day by "
    rows = [(k, text + " ".join(f"w{k}x{j} and the" for j in range(40)), "en", "a", 5, *[f"{n}{k}" for n in names]) for k in range(12)]
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    rows += [(None, None, None, None, None, *[None] * len(names)), (50, "", None, None, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, DOCS + "".join(f", {quoted(n)} string" for n in names))
    out = keep(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) >= 8 and all(r[n] == (None if r["doc_id"] in (None, 50) else f"{n}{r['doc_id']}") for r in got for n in names)
    assert keep(df.limit(0)).count() == 0


def test_every_stage_takes_an_empty_table_and_nulls(spark):
    nothing = spark.createDataFrame([], DOCS)
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "", None, "a", 0), (2, "one", "en", None, 1)], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
        assert stage(spark, nulls, "").count() <= 2 * 5


@pytest.mark.skipif(not GIVEN.exists(), reason="tables are not here")
def test_quality_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    said = op08_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in said]) > 0.98
    judged = op06_weak_labels.classify(docs).join(spark.read.parquet(f"{GIVEN}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["score"] for r in judged if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in said)


def test_pairs_at_the_threshold_and_a_crowd_below_it(spark):
    draw = random.Random(11)
    rows, want = [], {}
    for pair in range(150):
        base = [f"p{pair}w{k}" for k in range(181)]
        # Ten words apart from each other change 20 of 180 word pairs: 160 of 200 are shared. Nine leave 162 of 198.
        for many, first in ((10, 10_000), (9, 20_000)):
            other = list(base)
            for at in draw.sample(range(1, 179, 2), many):
                other[at] = f"q{pair}x{at}n{many}"
            rows.append((first + pair, " ".join(other), None, None, None))
            want[first + pair] = pair
        rows.append((pair, " ".join(base), None, None, None))
        want[pair] = pair
    # Many different texts with a common part: alike, but no two of them enough.
    shared = [f"c{k}" for k in range(100)]
    for n in range(300):
        rows.append((50_000 + n, " ".join(shared + [f"own{n}w{k}" for k in range(28)]), None, None, None))
        want[50_000 + n] = 50_000 + n
    got = op07_near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_classes_are_fitted_on_all_training_texts(spark):
    texts = ["abra abri"] * 30 + ["zorn zung"] * 10 + ["zorn " * 9000] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    seeds = op02_likelihood.fit_classes(np.eye(2, op02_likelihood.FEATURES, dtype=np.float32))
    begin = [op02_likelihood.features(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0][0] for w in (b"abra", b"zorn")]
    seeds.logs[begin[0]], seeds.logs[begin[1]] = (0, -9), (-9, 0)
    got = op02_likelihood.refine_classes(docs, seeds)
    # The long text is above the sample's bound of characters; all of it counts.
    assert got.logs[begin[1], 1] > got.logs[begin[0], 1] + 8 and got.logs[begin[0], 0] > got.logs[begin[1], 0] + 5
    assert np.isclose(np.exp(got.prior).sum(), 1) and np.isclose(np.exp(got.prior[0]) + 0, (30 + 1 + 2 * np.exp(got.prior[0])) / 45, atol=0.03)
