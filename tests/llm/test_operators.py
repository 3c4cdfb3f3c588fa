import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers as P  # noqa: E402

from brandlens.llm import (  # noqa: E402
    lattice, op01_mixing, op02_likelihood, op03_tokens, op04_lattice_hash, op05_sharding, op06_weak_labels, op07_near_dedup,
    op08_language, op09_rules, op10_pieces, textnum,
)
from tests.llm.conftest import texts  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORD, t or "")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_mix(docs, none):
    got = op01_mixing.mix(docs).collect()
    rows = texts()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((False, i, len(words(t))) for i, t, *_ in rows if i is not None)
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: share * weight[s] for s in open_}
    taken, big = Counter(), defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
        big[r["source"]] = max(big[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= big[s] for s in target)
    assert sorted(map(repr, op01_mixing.mix(docs).collect())) == sorted(map(repr, got))
    assert op01_mixing.mix(none).count() == 0 and op01_mixing.mix_documents(docs).columns == docs.columns


def test_likelihood(docs, none):
    path = P.path("piece_bpe_32k.model")
    got = op02_likelihood.score(docs, path).collect()
    rows = texts()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = [(i, [*words(lower(t)), 0]) for i, t, *_ in rows]
    c = Counter(w for i, ws in toks if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4), out(i)) for i, ws in toks)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 4), r["held_out"]) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert op02_likelihood.score(none, path).count() == 0


def test_marginals_sum_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ", b" ab"]
    scores = np.log(np.array([0.1, 0.2, 0.15, 0.25, 0.05, 0.25]))
    texts_ = [b" ab", b" aab", b" b"]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts_])])
    found = lattice.Lattice(lattice.DoubleArray(pieces), np.frombuffer(b"".join(texts_), np.uint8), bounds)

    def total(t):
        return 1.0 if not t else sum(math.exp(s) * total(t[len(p) :]) for p, s in zip(pieces, scores) if t.startswith(p))

    assert np.allclose(np.exp(found.marginals(scores)), [total(t) for t in texts_])
    assert np.isclose(found.expected(scores, np.ones(3)) @ [len(p) for p in pieces], sum(map(len, texts_)))


def test_words_of_many_batches_are_walked_at_once(monkeypatch):
    draw = random.Random(3)
    pieces = op02_likelihood.Pieces(P.path("piece_bpe_32k.model"))
    words_ = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 30))).encode() for _ in range(600)]
    rows = pa.RecordBatch.from_arrays([pa.array(words_), pa.array([i % 2 for i in range(600)], pa.int32()), pa.array(range(600)), pa.array(range(600))], names=["word", "kind", "hk", "h"])
    made = []
    monkeypatch.setattr(op02_likelihood, "lattice_of", lambda *a: made.append(1) or lattice.lattice_of(*a))

    class Sent:
        def __init__(self, value):
            self.value = value

    run = op02_likelihood._value(Sent(pieces.trie), Sent(pieces.scores(np.zeros((2, 2 * pieces.n)))), pieces.n)
    found = pa.Table.from_batches(run(rows.slice(i, 10) for i in range(0, 600, 10)))
    assert len(made) == 1
    alone = pa.Table.from_batches([b for i in range(600) for b in run(iter([rows.slice(i, 1)]))])
    assert found.equals(alone)
    large = [b.num_rows for b in op02_likelihood._walked((rows.slice(i, 10) for i in range(0, 600, 10)), 10_000, 2_000)]
    assert sum(large) == 600 and max(large) < 600


def test_levels_by_sorted_numbers():
    draw = np.random.default_rng(2)
    level, node = draw.integers(1, 9, 500), draw.integers(0, 40, 500)
    for far in (0, 1 << 40):
        order, bounds = lattice.Lattice._levels(level, node + far)
        assert order.tolist() == np.lexsort((node, level)).tolist()
        assert bounds.tolist() == [0, *(np.flatnonzero(np.diff(level[order])) + 1).tolist(), 500]
    assert [x.tolist() for x in lattice.Lattice._levels(level[:0], node[:0])] == [[], [0]]


def test_tokens(docs, none):
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in texts())
    got = op03_tokens.count_tokens(docs, path).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got) and op03_tokens.count_tokens(none, path).count() == 0


def test_tokens_where_the_table_starts_anew():
    import json

    machine = op03_tokens.Transducer(json.load(open(P.path("byte_bpe_50k.json"))), most_states=300)
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    given = [t or "" for _, t, *_ in texts(5, 60)] + ["a" * 700, "'s't  x"]
    (_, _, buf, offsets), = textnum.groups(pa.array(given), 1 << 30)
    assert machine.counts(buf, offsets).tolist() == [len(library.encode(t).ids) for t in given]


def test_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((12, 64))
    rows = []
    for i in range(300):
        x = base[i % 12] + draw.standard_normal(64) * (0.12 if i % 2 else 1.0)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 3))
    rows += [(400 + k, rows[0][1], 0) for k in range(5)] + [(500, None, 0), (501, [0.0] * 64, 0), (502, [float("nan")] * 64, 0), (503, [], 0), (504, rows[0][1], None), (505, [None, *rows[0][1][1:]], 0), (506, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", __import__("pyspark").sql.functions.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op04_lattice_hash.near_vectors(df).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 64 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in good], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.98) & np.equal.outer([r[2] for r in good], [r[2] for r in good])
    np.fill_diagonal(link, False)
    want = link.sum()
    assert len(got) == len(rows) and sum(n for n, _, _ in got.values()) >= 0.9 * want > 0
    assert all(got[r[0]][0] <= link[k].sum() for k, r in enumerate(good))
    for odd in (500, 501, 502, 503, 504, 505, 506):
        assert got[odd] == (0, odd, True)


def test_e8_decoding():
    x = np.random.default_rng(0).standard_normal((200, 8)) * 2
    near = op04_lattice_hash.decode(x)
    best = ((x - near / 2) ** 2).sum(axis=1)
    for root in op04_lattice_hash.roots():
        assert (((x - (near + root) / 2) ** 2).sum(axis=1) >= best - 1e-9).all()


def test_shards(docs, none):
    got = op05_sharding.shard(docs, shards=4).collect()
    want = sorted((len((t or "").encode()) + 1, -1 if t is None else zlib.crc32(t.encode())) for _, t, *_ in texts())
    assert sorted((r["size"], -1 if r["text_crc32"] is None else r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(4))
    assert op05_sharding.shard(none).count() == 0


def test_weak_labels(docs, none):
    got = op06_weak_labels.classify(docs).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert op06_weak_labels.classify(none).count() == 0


def test_em_finds_accuracies():
    draw = np.random.default_rng(2)
    truth = draw.random(20_000) < 0.7
    right = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(draw.random(len(truth)) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) * (draw.random(len(truth)) < 0.8) for a in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = op06_weak_labels.fit(patterns, counts.astype(float))
    assert np.allclose(model.accuracy(), right, atol=0.03) and abs(model.prior - 0.7) < 0.03


def brute_groups(rows):
    sets = []
    for i, t, *_ in rows:
        w = words(lower(t))
        sets.append((i, set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(s), low.get(find(k))) for k, (i, s) in enumerate(sets))


def test_near_duplicates(docs, none, monkeypatch):
    want = brute_groups(texts())
    for pairs in (5_000, 0):  # row by row, then block by block
        monkeypatch.setattr(op07_near_dedup, "BLOCK_PAIRS", pairs)
        got = op07_near_dedup.near_duplicates(docs).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = op07_near_dedup.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in want})
    assert op07_near_dedup.near_duplicates(none).count() == 0


def test_language(spark, none):
    rows = []
    for k in range(160):
        for lang, stem in (("en", "the thing with that"), ("de", "der größte straße und"), ("fr", "l'été où ça être"), ("es", "el niño años qué")):
            rows.append((len(rows), f"{stem} {k} " * (1 + k % 3), lang, "s"))
    rows += [(5000, None, "en", "s"), (5001, "123 !!", "en", "s"), (5002, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", __import__("pyspark").sql.functions.lit("x"))
    got = {r["doc_id"]: r for r in op08_language.identify(df).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:-3]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[i]["lang_pred"] for i in (5000, 5001, 5002)} == {"und"}
    assert op08_language.identify(none).count() == 0


def test_rules(docs, none):
    def count(t):
        t = t or ""
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        spots = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(spots)

    got = op09_rules.apply_rules(docs).collect()
    assert Counter((r["doc_id"], *(r[c] for c in op09_rules.BASE)) for r in got) == Counter((i, *count(t)) for i, t, *_ in texts())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert op09_rules.keep_documents(docs).columns == docs.columns and op09_rules.apply_rules(none).count() == 0


def test_pieces(docs, none):
    path = P.path("piece_bpe_32k.model")
    encoded = op10_pieces.encode(docs, path)
    assert Counter((r["doc_id"], r["text"]) for r in op10_pieces.decode(encoded, path).collect()) == Counter((i, t or "") for i, t, *_ in texts())
    assert all(r["exact"] for r in encoded.collect()) and op10_pieces.encode(none, path).count() == 0


def test_pieces_score_as_the_library_finds():
    spm = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    path = P.path("piece_bpe_32k.model")
    vocabulary = lattice.load_vocabulary(path)
    proto.ParseFromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        piece.score = float(vocabulary.scores[i])
    library, machine = spm.SentencePieceProcessor(model_proto=proto.SerializeToString()), op10_pieces.Encoder(vocabulary)
    given = [t or "" for _, t, *_ in texts(9, 80)]
    (_, _, buf, offsets), = textnum.groups(pa.array(given), 1 << 30)
    ids, bounds = machine.encode(buf, offsets)
    for k, t in enumerate(given):
        mine, other = ids[bounds[k] : bounds[k + 1]], library.encode(t)
        assert abs(vocabulary.scores[mine].sum() - vocabulary.scores[other].sum()) < 1e-3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in texts(3, 60)] + [(7000 + k, " ".join(f"the word and{j} of{k}" for j in range(40)), "en", "a", None, None, None) for k in range(12)]
    df = spark.createDataFrame([r[:4] + (None if r[1] is None else len(r[1]),) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_long_strings_are_walked_as_short_ones(monkeypatch):
    draw = random.Random(8)
    pieces = [b"a", b"b", b"ab", b"aba", b"bb", b" a", "é".encode(), b"abab" * 3, None, b"c"]
    trie, scores = lattice.DoubleArray(pieces), np.array([-draw.random() * 3 for _ in range(4 * (len(pieces) + 1))])
    monkeypatch.setattr(lattice, "STRETCH", 7)
    for turn in range(60):
        odd = turn % 2
        text = " a" + "".join(draw.choice(["a", "b", "ab", "é", "c", "z", "😀"] if odd else ["a", "b", "é"]) for _ in range(draw.randint(1, 60)))
        buf = np.frombuffer(text.encode(), np.uint8)
        unknown = len(pieces) if odd else None
        short, long = lattice.Lattice(trie, buf, np.array([0, len(buf)]), unknown), lattice.LongString(trie, buf, unknown)
        if not odd:
            short.number(len(pieces) + 1, np.array([1]))
            long.number(len(pieces) + 1, np.array([1]))
        assert np.allclose(short.marginals(scores), long.marginals(scores), rtol=1e-12)
        assert np.allclose(short.expected(scores, np.array([3.0])), long.expected(scores, np.array([3.0])))
        for a, b in zip(short.spelled(scores), long.spelled(scores)):
            assert a.tolist() == b.tolist()


def test_a_word_of_two_megabytes(spark):
    import time

    word = "".join(random.Random(9).choice(["ab", "thing", "Ünd", "x", "7"]) for _ in range(700_000))[:2_000_000]
    machine = op10_pieces.encoder(P.path("piece_bpe_32k.model"))
    buf = np.frombuffer(word.encode(), np.uint8)
    start = time.perf_counter()
    ids, bounds = machine.encode(buf, np.array([0, len(buf)]))
    again, _ = machine.decode(ids, bounds)
    assert again.tobytes() == buf.tobytes() and time.perf_counter() - start < 30
    sums = [0.0]
    for low in range(0, len(word), 100_000):
        part = np.frombuffer(word[low : low + 100_000].encode(), np.uint8)
        sums.append(lattice.LongString(machine.trie, part, machine.lost).marginals(machine.scores)[0])
    whole = lattice.LongString(machine.trie, buf, machine.lost).marginals(machine.scores)[0]
    # Cutting a word takes away the segmentations across the cuts, and nothing else.
    assert sum(sums) <= whole <= sum(sums) + 20 * 40
