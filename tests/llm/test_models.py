"""Vectors, language model and language identification against brute force and planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyhall.llm import langid, lm, vectors


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 24))
    for i in range(100, 220):
        x[i] = x[i % 10] + rng.standard_normal(24) * 0.05 * math.sqrt(1 + i % 5)
    x[230] = x[3]
    x[231] = x[3] * 2.0
    x = x.astype(np.float32)
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    odd = [(1001, None), (1003, []), (1005, [0.0] * 24), (1007, [float("nan")] * 24), (1009, [None] + [1.0] * 23),
           (1011, [float("inf")] + [1.0] * 23), (1013, [1.0] * 5), (1015, [1.0] * 5), (1017, [1.0] * 5)]
    docs = spark.createDataFrame(rows + odd, "id long, vec array<float>")
    got = {r["id"]: (r["n_links"], r["component"]) for r in vectors.near_vectors(docs, slab_rows=60).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    of = list(range(400))
    for _ in range(400):
        new = [min([of[i]] + [of[j] for j in np.flatnonzero(link[i])]) for i in range(400)]
        if new == of:
            break
        of = new
    assert all(got[i * 2] == (int(link[i].sum()), of[i] * 2) for i in range(400))
    assert all(got[i] == (0, i) for i in (1001, 1003, 1005, 1007, 1009, 1011))
    assert got[1013] == got[1015] == got[1017] == (2, 1013)
    assert vectors.near_vectors(docs.limit(0)).count() == 0


def test_collision_threshold_is_calibrated():
    p, count = vectors.within(vectors.DEVIATIONS), vectors.threshold()
    assert sum(math.comb(vectors.LINES, c) * p ** c * (1 - p) ** (vectors.LINES - c)
               for c in range(count, vectors.LINES + 1)) >= vectors.RECALL


def grammar(rng, n):
    """Sentences whose words follow each other in a fixed cycle of classes."""
    classes = [[f"{c}{i}" for i in range(4)] for c in "abcdefgh"]
    k = rng.randrange(8)
    return " ".join(rng.choice(classes[(k + i) % 8]) for i in range(n))


def test_language_model_prefers_the_corpus_order(spark):
    rng = random.Random(3)
    rows = [(i, grammar(rng, 200)) for i in range(150)]
    shuffled = []
    for i, t in rows[:20]:
        words = t.split()
        rng.shuffle(words)
        shuffled.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows + shuffled + [(2000, None), (2001, "  "), (2002, "a0"), (2002, "a0")],
                                 "id long, text string")
    p = lm.Params(batch=256, masked=0.5, rounds=2)
    got = {r["id"]: r for r in lm.pseudo_likelihood(docs, p).collect()}
    assert all(got[i]["mean_log_prob"] > got[1000 + i]["mean_log_prob"] + 0.3 for i in range(20))
    assert got[0]["n_words"] == 200 and got[0]["log_prob"] == pytest.approx(200 * got[0]["mean_log_prob"])
    for i in (2000, 2001):
        assert (got[i]["n_words"], got[i]["log_prob"], got[i]["mean_log_prob"]) == (0, 0.0, None)
    assert lm.pseudo_likelihood(docs.limit(0), p).count() == 0


def test_language_model_scores_equal_a_loop(spark):
    p = lm.Params(bits=8, classes=8, own=4, hidden=5)
    rng = random.Random(4)
    texts = [grammar(rng, n) for n in (1, 2, 3, 30, 0, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vocabulary = lm.Vocabulary.from_counts(lm.count_words(docs, p), p)
    flat = lm.Network(p).flat()
    got = {r["id"]: r["log_prob"] for r in lm.score(docs, vocabulary, flat, p).collect()}
    a, b, c, d = (w.astype(float) for w in lm.Network(p, flat).w)
    for i, t in enumerate(texts):
        ids, _ = lm._words([t.encode()], p)
        cls, total = vocabulary.of[ids], 0.0
        for k in range(len(ids)):
            h = b.copy()
            for slot, step in enumerate((-2, -1, 1, 2)):
                j = k + step
                h += a[slot * 9 + (cls[j] if 0 <= j < len(ids) else 8)]
            z = np.tanh(h) @ c + d
            total += z[cls[k]] - math.log(np.exp(z).sum()) + vocabulary.log_share[ids[k]]
        assert got[i] == pytest.approx(total, rel=1e-3, abs=1e-3)


EN = "the quick brown fox jumps over the lazy dog while the children are watching from the window"
DE = "der schnelle braune fuchs springt ueber den faulen hund waehrend die kinder vom fenster aus zusehen"


def page(text, lang=None):
    head = f'<html lang="{lang}">' if lang else "<html>"
    return f"<!DOCTYPE html>{head}<head><script>var t='zeile und die';</script></head><body><p>{text}</p></body></html>"


def test_language_evidence(spark):
    rng = random.Random(2)

    def words(s, n):
        return " ".join(rng.choice(s.split()) for _ in range(n))
    labelled = spark.createDataFrame([(words(EN, 60), "en") for _ in range(40)] + [(words(DE, 60), "DE") for _ in range(40)]
                                     + [(None, "en"), ("x", None), ("y", "")], "text string, lang string")
    rows = []
    for i in range(60):
        rows.append((i, "https://www.a.example.com/x", page(words(EN, 40), "en")))
        rows.append((100 + i, "http://b.example.de/x", page(words(DE, 40), "de-AT")))
    rows += [(500, "http://b.example.de/empty", page("")), (501, "http://c.example.de/", ""), (502, None, None),
             (503, "not a url", page(words(DE, 40))), (504, "http://www.a.example.com/", page("12 34")),
             (505, "http://b.example.de/", page(words(EN, 60), "en")), (None, "http://b.example.de/", None),
             (None, "http://b.example.de/", None)]
    pages = spark.createDataFrame(rows, "id long, url string, html string").withColumn("lang", F.lit("clash"))
    out = langid.identify(pages, labelled).collect()
    assert len(out) == len(rows)
    got = {r["id"]: r for r in out}
    assert all(got[i]["lang"] == "en" and got[100 + i]["lang"] == "de" for i in range(60))
    assert got[500]["lang"] == got[501]["lang"] == got[503]["lang"] == got[None]["lang"] == "de"
    assert got[504]["lang"] == got[505]["lang"] == "en" and got[504]["text_lang"] is None
    assert got[502]["host"] is None and got[502]["declared"] is None and got[502]["lang"] in ("de", "en")
    assert all(0.0 < r["posterior"] <= 1.0 for r in out)
    assert langid.identify(pages.limit(0), labelled).count() == 0
    assert {r["lang"] for r in langid.identify(pages, labelled.limit(0)).collect()} == {None}


def test_every_label_value_can_be_predicted(spark):
    rng = random.Random(9)

    def words(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    labelled = [(words("abcdefgh", 3), f"a{i:03d}") for i in range(300)]
    labelled += [(words("xyzwv", 60), "vi") for _ in range(5)] + [(words("klmno", 60), "zh") for _ in range(5)]
    langs, table = langid.trigram_counts(spark.createDataFrame(labelled, "text string, lang string"))
    assert langs == sorted({x for _, x in labelled}) and table.shape == (302, 1 << langid.BITS)
    rows = [(i, f"http://h{i % 2}.example.com/", page(words("xyzwv" if i % 2 else "klmno", 40))) for i in range(20)]
    found = langid.identify(spark.createDataFrame(rows, "id long, url string, html string"),
                            spark.createDataFrame(labelled, "text string, lang string")).collect()
    assert len(found) == 20
    assert all(r["lang"] == r["text_lang"] == ("vi" if r["id"] % 2 else "zh") for r in found)


def test_trigram_model_equals_a_loop():
    texts = ["Ab, cd", "", "x", "éa b1b"]
    slots, at = langid._trigrams([t.encode() for t in texts])
    clean = [" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " " for t in texts]
    for t, (a, b) in zip(clean, langid._ranges(at)):
        assert b - a == max(0, len(t.encode()) - 2) or not t.strip()


@pytest.mark.parametrize("held", [1 << 17, 3, 0])
def test_language_model_tells_words_of_one_bucket_apart(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    monkeypatch.setattr(lm, "TASK_WORDS", 8)
    p = lm.Params(bits=2, classes=4, own=2, hidden=3, batch=16)
    texts = [" ".join(f"w{k}" for k in range(12) for _ in range(1 + k * (i + 1))) for i in range(3)] + ["", None, "w3 w7 w11 w1"]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "id long, text string")
    count = {}
    for w in " ".join(t or "" for t in texts).split():
        count[w] = count.get(w, 0) + 1
    bucket = {w: lm._words([w.encode()], p)[0][0] for w in count}
    size = [sum(count[w] for w in count if bucket[w] == b) for b in range(4)]
    words = lm.word_table(docs)
    counts, distinct = lm.bucket_counts(words, p)
    assert counts.tolist() == size == lm.count_words(docs, p).tolist()
    vocabulary, flat = lm.Vocabulary.from_counts(counts, p), lm.Network(p).flat()
    shares = lm.Shares.from_words(words, distinct, p)
    assert (shares.rest is None) == (held > 12)
    plain = sorted((r.n_words, r.log_prob) for r in lm.score(docs, vocabulary, flat, p).collect())
    exact = sorted((r.n_words, r.log_prob) for r in lm.score(docs, vocabulary, flat, p, shares).collect())
    share = {len((t or "").split()): sum(math.log(count[w] / size[bucket[w]]) for w in (t or "").split()) for t in texts}
    for (n, a), (m, b) in zip(plain, exact, strict=True):
        assert n == m and b == pytest.approx(a + share[n], abs=1e-6)
    assert any(share.values())
