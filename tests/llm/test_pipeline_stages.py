import math
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")
import duckdb  # noqa: E402
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from brandlens.llm import lattice, op07_near_dedup, op08_language, op10_pieces, oracles  # noqa: E402
from tests.llm.conftest import SCHEMA, texts  # noqa: E402
from tests.llm.test_operators import lower, words  # noqa: E402

GIVEN = Path("/root/testdata/sf0.001")


def kept_ids(rows, size):
    """The least id of each group that is linked at 0.8, by comparing all pairs."""
    sets = [(i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if (w := words(lower(t))) else set()) for i, t, *_ in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if group[a] != group[b] and x and 100 * len(x & y) >= 80 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(sets, group):
        low[g] = min(low.get(g, i), i)
    return sorted(set(low.values()))


def test_near_dedup_stage_takes_five_words(spark):
    rows = [r for r in texts(3, 60) if r[0] is not None]
    # Two words exchanged far apart leave 55 of 63 word pairs and 46 of 66 five-word shingles.
    base = [f"q{k}" for k in range(60)]
    for n in range(8):
        base[20], base[40] = f"x{n}", f"y{n}"
        rows.append((8000 + n, " ".join(base), "en", "a", None, None, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = kept_ids(rows, 5)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want
    assert want != kept_ids(rows, op07_near_dedup.SHINGLE) and op07_near_dedup.SHINGLE == 2


def plain_language(model, text):
    """(language, score) of one text: margins of its n-gram counts, then votes, one after the other."""
    if text is None or not any(c.isalpha() for c in text):
        return op08_language.UNKNOWN, 0.0
    values = op08_language.features([text])[0].astype(float) @ model.weights + model.bias
    sure = lambda m: 1 / (1 + math.exp(-model.scale * max(-30.0, min(30.0, m))))
    kin = max(range(len(model.names)), key=lambda k: (values[k], -k)) if len(model.names) > 1 else 0
    score = sure(values[kin]) if len(model.names) > 1 else 1.0
    members = model.families[model.names[kin]]
    votes, least = dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
    for a, b, line in model.pairs:
        if a in members:
            p = sure(values[line])
            for name, q, won in ((a, p, p >= 0.5), (b, 1 - p, p < 0.5)):
                votes[name] += won + 1e-3 * q
                least[name] = min(least[name], q)
    best = max(members, key=lambda m: (votes[m], -members.index(m)))
    return best, score * least[best]


def by_sql(sql, rows):
    con = duckdb.connect()
    table = pa.table({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "text": pa.array([r["text"] for r in rows], pa.string()), "source": pa.array([r["source"] for r in rows], pa.string())})
    con.register("documents", table)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def best_score(text, scores, longest, low):
    """The score of the best segmentation of a text with a space in front, by the plain recursion over characters."""
    text = " " + text if text else ""
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - longest), end):
            if (s := scores.get(text[begin:end], low if begin == end - 1 else None)) is not None:
                best[end] = max(best[end], best[begin] + s)
    return best[-1]


@pytest.mark.skipif(not GIVEN.exists(), reason="tables are not here")
def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "near_dedup", "mix_sources", "encode_pieces"]
    ids = lambda rows: Counter(r["doc_id"] for r in rows)
    given = docs.collect()
    model = op08_language.train(op08_language.sample(docs.where(~op08_language.held_out())))
    said = {r["doc_id"]: plain_language(model, r["text"]) for r in given}
    told = stages["language_id"](spark, docs, "").cache()
    want = [r for r in given if said[r["doc_id"]][0] != op08_language.UNKNOWN and said[r["doc_id"]][1] >= op08_language.LEAST_SCORE]
    assert ids(told.collect()) == ids(want) and len(want) > 100
    for r in op08_language.identify(docs).collect():
        assert r["lang_pred"] == said[r["doc_id"]][0] and abs(r["score"] - said[r["doc_id"]][1]) < 1e-4

    good = [r["doc_id"] for r in by_sql(oracles.rules_sql(), want) if r["kept"]]
    ruled = stages["quality_rules"](spark, told, "").cache()
    assert sorted(r["doc_id"] for r in ruled.collect()) == sorted(good) and len(good) > 50

    texts_ = [(r["doc_id"], r["text"]) for r in ruled.collect()]
    single = stages["near_dedup"](spark, ruled, "").cache()
    rest = single.collect()
    assert sorted(r["doc_id"] for r in rest) == kept_ids(texts_, corpus_pipeline.SHINGLE)

    mixed = stages["mix_sources"](spark, single, "").cache()
    copies = Counter({r["doc_id"]: r["taken"] // r["size"] for r in by_sql(oracles.mix_sql(), rest) if r["taken"]})
    assert ids(mixed.collect()) == copies and set(copies.values()) <= {1, 2} and mixed.columns == docs.columns

    vocabulary = lattice.load_vocabulary(public_tokenizers.path(corpus_pipeline.PIECES))
    scores = {p.decode(): s for p, s in zip(vocabulary.pieces, vocabulary.scores) if p}
    low = min(scores.values()) - op10_pieces.UNKNOWN_BELOW
    spelled = stages["encode_pieces"](spark, mixed, "").collect()
    assert ids(spelled) == copies
    own = {r["doc_id"]: r["text"] for r in rest}
    lost = {int(i) for i in vocabulary.byte_ids if i >= 0} | {vocabulary.unknown}
    for r in spelled[:60]:
        if not lost & set(r["pieces"]):
            assert abs(sum(vocabulary.scores[i] for i in r["pieces"]) - best_score(own[r["doc_id"]], scores, 40, low)) < 1e-6
    assert ids(corpus_pipeline.run(spark, str(GIVEN)).collect()) == copies
