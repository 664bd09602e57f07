"""Fitted models against plain versions: FTRL with dictionaries, segmentations by enumeration, posteriors from their formula."""

import math
import random

import numpy as np
import pytest

from studyhall.llm import langid, pii, toxicity


def test_ftrl_equals_a_plain_version():
    p = toxicity.Params(bits=10, l1=0.7, epochs=2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 15))) for _ in range(60)]
    labels = [int("w3" in t.split()) for t in texts]
    got = toxicity.fit((t.encode() for t in texts), labels, p)

    z, n, bias = {}, {}, 1 << p.bits

    def weight(i):
        l1 = 0.0 if i == bias else p.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)
    scale = {y: math.sqrt(len(labels) / (2 * labels.count(y))) for y in (0, 1)}
    seen = [(list(map(int, f)) + [bias], y) for f, y in zip(toxicity.features((t.encode() for t in texts), p), labels)]
    for _ in range(p.epochs):
        for idx, y in seen:
            w = {i: weight(i) for i in idx}
            g = scale[y] * (1 / (1 + math.exp(-sum(w.values()))) - y)
            for i in idx:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / p.alpha * w[i]
                n[i] = old + g * g
    want = np.array([weight(i) for i in range(bias + 1)])
    assert np.allclose(got, want, atol=1e-9) and (want != 0).sum() > 5


def test_segmentation_is_the_best_of_all():
    model = pii.fit(pii.examples(seed=3, each=4), epochs=2)
    checked = 0
    for text, _ in pii.examples(seed=8, each=2):
        borders, segments = pii.candidates(text)
        if not segments or len(borders) > 40:
            continue
        gain = {}
        for i, j, f in segments:
            best = max(model.scores(f)) - pii.MARGIN
            if best > 0:
                gain[i, j] = max(gain.get((i, j), 0.0), best)

        def total(at):
            """The best sum of segments from token ``at`` on, over all choices of disjoint segments."""
            options = [(j, v) for (i, j), v in gain.items() if i >= at]
            return max([0.0] + [v + total(j) for j, v in options])
        if len(gain) > 14:
            continue
        spans = model.decode(text)
        token = {b: i for i, b in enumerate(borders)}
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
        assert abs(sum(gain[token[a], token[b]] for _, a, b in spans) - total(0)) < 1e-9
        checked += 1
    assert checked > 30


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def test_posterior_follows_its_formula(spark):
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(n))
    labelled = spark.createDataFrame([(text(k, 30), k) for k in letters for _ in range(4)], "text string, lang string")
    hosts = [None, "x.one.aa", "y.one.aa", "two.bb", "z.three.cc", "three.cc"]
    rows = []
    for i in range(40):
        host, lang = rng.choice(hosts), rng.choice(list(letters))
        told = rng.choice(["", "", f' lang="{rng.choice(list(letters))}"'])
        rows.append((i, f"https://{host}/p{i}" if host else None, f"<html{told}><body>{text(lang, rng.randrange(0, 4))}</body></html>"))
    pages = spark.createDataFrame(rows, "id long, url string, html string")
    langs, table = langid.trigram_counts(labelled)
    from pyspark.sql import functions as F
    seen = langid.text_evidence(pages.select("id", langid.host_of(F.col("url")).alias("host"),
                                             langid.declared_of(F.col("html")).alias("declared"), "html"), langs, table).collect()
    post = {r.id: softmax(r.ll) for r in seen}
    n = len(langs)

    def mass(of):
        out = {}
        for r in seen:
            for k in of(r):
                out[k] = out.get(k, np.zeros(n)) + post[r.id]
        return out
    site = lambda h: ".".join(h.split(".")[-2:])
    top = lambda h: h.split(".")[-1]
    root = sum(post.values()) + 1.0
    root = root / root.sum()

    def smooth(m, up):
        v = m + langid.STRENGTH * up
        return v / v.sum()
    by_top = {k: smooth(m, root) for k, m in mass(lambda r: [top(r.host)] if r.host else []).items()}
    by_site = {k: smooth(m, by_top[top(k)]) for k, m in mass(lambda r: [site(r.host)] if r.host else []).items()}
    by_host = {k: smooth(m, by_site[site(k)]) for k, m in mass(lambda r: [r.host] if r.host else []).items()}

    def likelihood(m):
        totals = sum(m.values())
        return {k: np.log((v + v.sum() / totals.sum()) / (totals + 1.0)) for k, v in m.items()}
    declared = likelihood(mass(lambda r: [r.declared] if r.declared else []))
    suffix = likelihood(mass(lambda r: [top(r.host)] if r.host else []))
    got = {r.id: r for r in langid.identify(pages, labelled).collect()}
    for r in seen:
        logs = np.log(by_host[r.host] if r.host else root) + np.array(r.ll)
        logs = logs + declared.get(r.declared, 0.0) + (suffix[top(r.host)] if r.host else 0.0)
        want = softmax(list(logs))
        assert got[r.id].posterior == pytest.approx(want.max(), abs=1e-6)
        assert got[r.id].lang == langs[int(want.argmax())]
