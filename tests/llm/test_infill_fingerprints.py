"""Fill-in-middle ropes and weighted-sampling fingerprints against plain versions of both."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brandlens.llm import op11_rope_infill as fim
from brandlens.llm import op12_weighted_sampling as cws
from brandlens.llm import textnum

ODD = "doc_id long, text string, `a.b` string, output string, form int, fingerprint string, part int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_infill(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), sha(out), sha(text)


def odd_rows():
    draw = random.Random(5)
    parts = ["ab", "Z", " ", "\n", "é", "😀", "<", "<P", ">", "S>", "<M>", "x" * 40, "\r\n", "1", "ß", "\x00", "K"]
    rows = [(i, "".join(draw.choice(parts[: 8 + i % 9]) for _ in range(draw.randint(0, 60))), "x", "y", 3, "z", 9) for i in range(400)]
    rows += [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows + [(903, "same text", "q", None, None, None, None)] * 3 + [(904, "w" * 300_000 + " end", None, None, None, None, None), (905, "some words " * 20_000, None, None, None, None, None)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 2048])
def test_rope_equals_lists_of_units(monkeypatch, size):
    monkeypatch.setattr(fim, "LEAF", size)
    draw = random.Random(size)
    for _ in range(300):
        text = "".join(draw.choice(["a", "Bc", " ", "é", "<", "P", ">", "\n", "😀", "ddd"]) for _ in range(draw.randint(0, 40)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        tree = fim.rope(text)
        assert (tree.units if tree else 0) == len(units) and (tree.chars if tree else 0) == len(text)
        for k in {0, len(units), draw.randint(0, len(units))}:
            left, right = fim.split_units(tree, k)
            assert (fim.flat(left), fim.flat(right)) == ("".join(units[:k]), "".join(units[k:]))
            assert (left.units if left else 0) == k
            again = fim.join(left, right)
            j = draw.randint(0, len(units))
            assert fim.flat(fim.split_units(again, j)[0]) == "".join(units[:j])
        at = draw.randint(0, len(text))
        assert fim.flat(fim.split_chars(tree, at)[1]) == text[at:]
        found = text.find("<P>")
        assert fim.find(tree, "<P>") == (found if found >= 0 else None)
        h = [draw.getrandbits(32) for _ in range(4)]
        _, form, _, _, out = fim.rearrange(text, *h)
        assert fim.restore_text(out, form) == text


def test_infill_on_odd_rows(spark):
    rows = odd_rows()
    got = fim.digest(spark.createDataFrame(rows, ODD).repartition(3))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = Counter((r[0], *plain_infill(r[0], r[1])) for r in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.digest(spark.createDataFrame([], ODD)).count() == 0
    texts = fim.restore(fim.transform(spark.createDataFrame(rows[:50], ODD))).collect()
    assert {r["doc_id"]: r["restored"] for r in texts} == {r[0]: r[1] for r in rows[:50]}


def test_long_texts_split_fast():
    text = "word and more, " * 200_000 + "z" * 2_000_000
    start = time.perf_counter()
    n, form, _, _, out = fim.rearrange(text, 3_000_000_000, 1_234_567, 5, 50)
    assert form == "psm" and fim.restore_text(out, form) == text and n == 200_000 * 7 + 1
    assert time.perf_counter() - start < 20


def words(text):
    found = (w for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())))
    return Counter(w[k : k + cws.LONG] for w in found for k in range(0, len(w), cws.LONG))


def likeness(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def plain_samples(bag):
    """The definition, term by term and sample by sample."""
    out = []
    for k in range(cws.SAMPLES):
        best = []
        for word, weight in bag.items():
            buf = np.frombuffer(word, np.uint8)
            term = int(textnum.hash_spans(buf, np.array([0]), np.array([len(buf)]))[0]) >> 24
            r, b, c, _ = (float(x[0]) for x in cws.draws(np.array([term], np.uint64), k))
            t = math.floor(math.log(weight) / r + b)
            best.append((c * math.exp(-r * (t - b + 1)), word, t))
        out.append(min(best)[1:] if best else None)
    return out


def test_samples_are_those_of_the_definition():
    draw = random.Random(6)
    vocabulary = [f"w{k}" for k in range(50)]
    texts = [" ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(50)], k=draw.randint(1, 200))) for _ in range(25)]
    found = cws.signatures(texts)
    plain = [plain_samples(words(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = np.array([a == b for a, b in zip(plain[i], plain[j])])
            assert (same == (found[i] == found[j])).mean() > 0.98


def test_collision_rate_is_generalised_jaccard():
    draw = np.random.default_rng(7)
    for _ in range(6):
        a = draw.integers(0, 30, 400)
        b = np.where(draw.random(400) < 0.5, a, draw.integers(0, 30, 400))
        n = 120  # so many independent pairs of the same weights: the terms are named anew for each
        rates = []
        for part in range(n):
            ids = np.sort(draw.choice(1 << 40, 400, replace=False)).astype(np.uint64)
            keys = np.concatenate([ids[a > 0], ids[b > 0] | np.uint64(1 << 40)])
            s = cws.weighted_signatures(keys, np.concatenate([a[a > 0], b[b > 0]]), 2)
            rates.append((s[0] == s[1]).mean())
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(np.mean(rates) - want) < 4 * math.sqrt(want * (1 - want) / (n * cws.SAMPLES)) + 0.004


def test_edited_fingerprints_on_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ODD).repartition(5)
    got = cws.edited_fingerprints(df)
    found = got.collect()
    assert got.columns == ["doc_id", *cws.DIGEST] and len(found) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    order = sorted(texts, reverse=True)
    follow = {a: texts[b] for a, b in zip(order, order[1:])}
    near, far = [], []
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        # The last id's follower is one of the two rows without id; of equal ids, one is followed by the other.
        if r["doc_id"] in (None, order[-1], 903):
            continue
        text, after = texts[r["doc_id"]], follow[r["doc_id"]]
        edited = cws.edit(text, after)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(edited)
        near.append(r["near_edited"] - likeness(words(text), words(edited)))
        far.append(r["near_next"] - likeness(words(text), words(after)))
    assert abs(np.mean(near)) < 0.02 and abs(np.mean(far)) < 0.02 and np.abs(near + far).max() < 0.25
    assert Counter(tuple(r) for r in cws.fingerprints(df).collect()) == Counter((r["doc_id"], r["fingerprint"]) for r in found)
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 903}) == 1
    assert cws.edited_fingerprints(spark.createDataFrame([], ODD)).count() == 0
    (alone,) = cws.edited_fingerprints(spark.createDataFrame([(1, "one two three", None, None, None, None, None)], ODD)).collect()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == sha(cws.edit("one two three", "one two three"))


def test_likeness_of_columns(spark):
    a, b, none = cws.written(cws.signatures(["a b c d e f g h", "a b c d e f x y", ""]))
    row = spark.createDataFrame([(a, b, none)], "a string, b string, n string").select(cws.likeness(F.col("a"), F.col("b")), cws.likeness(F.col("a"), F.col("a")), cws.likeness(F.col("n"), F.col("n"))).first()
    assert 0.3 < row[0] < 0.9 and row[1] == 1.0 and row[2] == 1.0


def test_equal_texts_and_long_words():
    start = time.perf_counter()
    a, b, c = cws.signatures(["q" * 10 + "Ab" * 1_000_000, "Q" * 10 + "ab" * 1_000_000, "q" * 10 + "ab" * 600_000 + "".join(chr(97 + k % 26) + chr(98 + k % 23) for k in range(400_000))])
    assert (a == b).all() and (a == c).mean() > 0.2
    assert time.perf_counter() - start < 20
