"""Quality rules, filter audit and phrase mining: brute force, SQL parity, edge cases."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from studyhall.llm import audit, phrases, quality

TABLES = "documents labels conversations".split()
SQL_KEYS = sorted(k for k in E.oracle_sql() if re.match(r"op\d+_", k))


@pytest.mark.parametrize("key", SQL_KEYS)
def test_operators_match_their_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[key](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(repr, (tuple(r[c] for c in sorted(names)) for r in df.collect()))) == Counter(
        map(repr, (tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cur.fetchall())))


# ---------------------------------------------------------------- audit
def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    rows = []
    for i, part, text in docs:
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and t == text for j, _, t in docs)}
        rows.append((part, {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[0] for r in mine) - len(gone),
                                                   sum(r[0] == {f} for r in mine), sum(r[1] for r in gone),
                                                   sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(7)
    pool = ["", "one two", "A B C", "x " * 300, " ".join(f"w{i}" for i in range(250)), "été #   z",
            " ".join(f"Wörd{i}" for i in range(260)) + " $", "\x0bq\x0cq", "UPPER " * 40]
    docs = [(rng.choice([None, *range(40)]) if rng.random() < 0.2 else i, rng.choice(["en", "de", ""]), rng.choice(pool))
            for i in range(90)]
    docs += docs[:10]
    labels = [(rng.choice([None, *range(90)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    got = audit.audit(spark.createDataFrame(docs, "id long, part string, text string").selectExpr("*", "1 AS mask", "2 AS n"),
                      spark.createDataFrame(labels, "id long, quality int, toxic int").selectExpr("*", "3 AS good")).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 1800
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                               r.shapley] for r in got} == want
    empty = spark.createDataFrame([], "id long, part string, text string")
    assert audit.audit(empty, spark.createDataFrame([], "id long, quality int, toxic int")).count() == 0


def test_gray_walk_visits_every_subset():
    counts = np.random.default_rng(1).integers(0, 50, (32, 3))
    states = audit.subset_survivors(counts)
    for subset in range(32):
        assert (states[subset] == sum(counts[m] for m in range(32) if not m & subset)).all()


# ---------------------------------------------------------------- phrases
def brute_phrases(docs, minimum, percent=100):
    f, out = {}, []
    for lang, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang or "und", Counter())[tuple(words[i:i + m])] += 1
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= minimum}
        rows = []
        for k, a in cand.items():
            if any(len(b) > len(k) and 100 * v >= percent * a and any(b[i:i + len(k)] == k for i in range(len(b)))
                   for b, v in cand.items()):
                continue
            score, _, left, right = min((int(Fraction(1000 * a * n, c[k[:j]] * c[k[j:]])), j, c[k[:j]], c[k[j:]])
                                        for j in range(1, len(k)))
            rows.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows), 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("percent", [100, 70])
def test_phrases_equal_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(phrases, "PARTITION", 200)
    rng = random.Random(3)
    vocab = ["The", "of", "état", "x y", "B", "c", "dd", "ÉE", "q\x1cq"]
    docs = []
    for i in range(120):
        words = [rng.choice(vocab[:rng.choice([3, 9])]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "; "]) for w in words)
        docs.append((rng.choice(["en", "en", "fr", None]), text))
    docs += [("en", "hot pair " * 3000), ("en", None), (None, ""), ("de", "..!  \n"), ("en", "A" * 5000)]
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS words", "2 AS n").repartition(3)
    got = phrases.collocations(df, minimum=12, inside_percent=percent, top=None).collect()
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(docs, 12, percent)


def test_phrases_of_empty_tables_and_top(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    docs = spark.createDataFrame([("en", "a b c d. " * 5)], "lang string, text string")
    assert [(r.rank, r.phrase) for r in phrases.collocations(docs, minimum=5, top=1).collect()] == [(1, "a b c d")]


def test_quicksort_abandons_light_parts_but_not_the_edges():
    keys = [np.array([1, 1, 1, 2, 3, 3, 9]), np.array([5, 5, 6, 7, 8, 8, phrases.END])]
    weight = np.array([2, 2, 1, 1, 3, 3, 1])
    got = {(tuple(int(k[at]) for k in keys[:depth + 1]), total) for at, depth, total in phrases.equal_parts(keys, weight, 4)}
    assert got == {((1,), 5), ((1, 5), 4), ((3,), 6), ((3, 8), 6), ((9,), 1)}
    assert list(phrases.equal_parts([np.array([], dtype=np.int64)], np.array([], dtype=np.int64), 1)) == []


# ---------------------------------------------------------------- quality
def prose(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))) + "."


def bad(rng):
    w = prose(rng).split()
    return rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[:6] for _ in range(12)),
                       " ".join(x + "$$$" for x in w), " | ".join(w)])


def test_rules_separate_held_out_texts_and_compile_exactly(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng) if i % 4 else bad(rng), int(i % 4 != 0)) for i in range(700)]
    docs = spark.createDataFrame(rows, "id long, text string, label int")
    model = quality.train(docs, docs.filter("id % 3 <> 0").select("id", "label"))
    assert 0 < len(model.rules) < 120
    got = {r.id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.97
    x = np.array([quality.text_statistics(t.encode()) for _, t, _ in rows])
    at = [[(quality.STATISTICS.index(k), above, cut) for k, above, cut in r.conditions] for r in model.rules]
    margin = model.intercept + sum(r.weight * quality.holds(c, x) for r, c in zip(model.rules, at))
    assert np.allclose([got[i] for i, _, _ in rows], 1 / (1 + np.exp(-margin)), atol=1e-12)


def test_lasso_reaches_the_optimum_and_is_sparse():
    rng = np.random.default_rng(2)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1])))).astype(float)
    b, w = quality.lasso(z, y, 0.02, 3000)
    g = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert (w == 0).sum() >= 6 and w[0] > 0 > w[1]
    assert np.all(np.abs(g[w == 0]) <= 0.02 + 1e-6) and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5)


def test_quality_edges(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "w" * 300000), (5, "a b " * 60000), (None, "x y"), (5, "other"), (5, "other")]
    docs = spark.createDataFrame(texts, "id long, text string").selectExpr("*", "'q' AS label", "1 AS n_words")
    none = spark.createDataFrame([], "id long, label int")
    scores = quality.score(docs, quality.train(docs, none)).collect()
    assert len(scores) == 8 and {r.score for r in scores} == {0.5}
    ones = spark.createDataFrame([(1, 1), (5, 1), (2, 1), (4, 0), (4, 1), (3, 7), (None, 1), (99, 1)], "id long, label int")
    model = quality.train(docs, ones)
    assert model.rules == () and model.intercept > 0
    assert quality.score(docs.limit(0), model).count() == 0
