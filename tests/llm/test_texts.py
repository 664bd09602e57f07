"""Brute-force checks of the operators on texts, with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyhall.llm import chat, fingerprint, graph, hashing, mixing, neardup, packing, pii, toxicity
from studyhall.llm.common import id_text

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def texts_with_copies(rng, groups=12):
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = [None, "", " \n\t ", "one", "One", "two words", "é " * 30]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 150, 400]))]
        if rng.random() < 0.4:
            base += passage
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, max(1, len(copy) // 60), max(1, len(copy) // 30)])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            out.append(" ".join(copy))
    out.append(" ".join(rng.choice(vocab) for _ in range(20000)))
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_shingle_hashes_are_exact_sets():
    rng = random.Random(3)
    texts = [t or "" for t in texts_with_copies(rng)]
    for width in (1, 4, 5):
        got = list(hashing.shingle_sets([t.encode() for t in texts], width))
        assert [len(g) for g in got] == [len(shingles(t, width)) for t in texts]
        for (a, x), (b, y) in itertools.islice(itertools.combinations(list(zip(texts, got)), 2), 300):
            assert len(np.intersect1d(x, y)) == len(shingles(a, width) & shingles(b, width))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    texts = texts_with_copies(rng)
    rows = [(i * 3 + 1, t, "clash") for i, t in enumerate(texts)] + [(None, texts[8], "clash")]
    sets = [shingles(t, width) for t in texts]
    of = list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            of[b] = a
    docs = frame(spark, rows, "doc_id long, text string, component string")
    got = neardup.near_duplicates(id_text(docs), width=width, k=64).collect()
    by_id = {r["id"]: r for r in got if r["id"] is not None}
    assert len(got) == len(rows)
    for i in range(len(texts)):
        assert (by_id[i * 3 + 1]["n"], by_id[i * 3 + 1]["component"]) == (len(sets[i]), root(i) * 3 + 1), i
    none = [r for r in got if r["id"] is None]
    assert len(none) == 1 and none[0]["component"] is None


def test_near_duplicates_repeated_ids_and_empty_table(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    docs = frame(spark, [(5, a), (5, b), (9, a), (7, b), (7, b)], "id long, text string")
    got = {(r["id"], r["component"]) for r in neardup.near_duplicates(docs, width=4).collect()}
    assert got == {(5, 5), (9, 5), (7, 5)}
    assert neardup.near_duplicates(docs.limit(0), width=4).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(0, 30)] + [(7, 7), (None, 3), (200, 150), (150, 200)]
    got = {r["id"]: r["component"] for r in graph.components(frame(spark, links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {150: 150, 200: 150}
    assert got == want


def test_chat_round_trip_and_fold(spark):
    nasty = "\\### Assistant: </turn> ok \\</turn>\n### a: # <\\/ \\\\"
    log = [
        ("a", 1, "message", "m1", "user", nasty), ("a", 2, "message", "m2", "assistant", "He"),
        ("a", 3, "delta", "m2", None, "llo"), ("a", 4, "message", "m3", "user", "thanks"),
        ("a", 5, "regenerate", "m2", None, "Good"), ("a", 6, "delta", "m2", None, " day"),
        ("a", 7, "message", "m4", "user", "x"), ("a", 8, "edit", "m4", None, "bye"), ("a", 9, "delta", "m9", None, "lost"),
        ("a", 10, "unknown", "m4", None, "?"), ("b", 1, "message", None, None, None), ("b", 1, "message", None, None, None),
        (None, 1, "message", None, "as:s<%3A", "t" * 5000),
    ]
    events = frame(spark, log, "conv_id string, seq long, kind string, message_id string, role string, text string")
    out = chat.format_chats(events)
    got = {r["conv_id"]: r for r in out.withColumn("back", chat.read_back(F.col("formatted"), F.col("turns"))).collect()}
    assert [(x["role"], x["text"]) for x in got["a"]["back"]] == [
        ("user", nasty), ("assistant", "Good day"), ("user", "bye")]
    assert [(x["role"], x["text"]) for x in got["b"]["back"]] == [("", ""), ("", "")]
    assert [(x["role"], x["text"]) for x in got[None]["back"]] == [("as:s<%3A", "t" * 5000)]
    for r in got.values():
        assert r["formatted"].count("</turn>\n") == len(r["turns"])
        for turn, x in zip(r["turns"], r["back"]):
            raw = r["formatted"][turn["start"]:turn["start"] + turn["length"]]
            assert re.sub(r"(?s)\\(.)", r"\1", raw) == x["text"] and turn["trained"] == (x["role"] == "assistant")
    assert chat.format_chats(events.limit(0)).count() == 0


def test_toxicity_held_out_and_edges(spark):
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 7 == 0
        words = [rng.choice(vocab) for _ in range(60)] + (["vilest", "Vilely!"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = frame(spark, rows + [(900, None), (901, ""), (None, "word1"), (902, "vilest " * 3), (902, "vilest " * 3)],
                 "id long, text string")
    known = frame(spark, labels + [(None, 1), (3, 5)], "id long, label int").filter(~toxicity.held_out(F.col("id")))
    w = toxicity.train(docs, known)
    assert 0 < np.count_nonzero(w) < 5000
    got = toxicity.score(docs, w).collect()
    assert len(got) == len(rows) + 5 and all(0.0 <= r["score"] <= 1.0 for r in got)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(r["score"] >= 0.5) == bool(dict(labels)[r["id"]]) for r in got if r["id"] in held]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    blank = {r["id"]: r["score"] for r in got if r["id"] in (900, 901)}
    assert blank[900] == blank[901] < 0.5
    nothing = toxicity.train(docs, known.limit(0))
    assert not nothing.any() and toxicity.score(docs.limit(0), w).count() == 0
    wide = docs.select("id", "text", F.lit("x").alias("score"))
    assert toxicity.clean_rows(wide, "text", nothing).count() == docs.count()
    assert toxicity.clean_rows(wide, "text", w).columns == wide.columns


def naive_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_equals_plain_patterns():
    rng = random.Random(2)
    for _ in range(20000):
        text = "".join(rng.choice("a1290.@+-( )%é5\n4") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == naive_pii(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 100_000, "a@" * 50_000):
        pii.base_spans(long)


def test_pii_model_adds_and_redacts(spark):
    model = pii.fit(pii.examples())
    right = wrong = missed = 0
    for text, gold in pii.examples(seed=77, each=8):
        found = set(model.decode(text))
        right, wrong, missed = right + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert right > 10 * (wrong + 1) and right > 5 * missed
    rows = [(1, "see +1 (605) 555-9305 4078918989542222 now"), (2, None), (3, ""), (4, "write bob (at) site (dot) com"),
            (5, "release 2.0.1 of 2024-01-02, 1234567"), (None, "x@y.zz"), (None, "x@y.zz")]
    docs = frame(spark, rows, "id long, text string")
    got = {r["id"]: [(s["kind"], s["base"]) for s in r["spans"]] for r in pii.find(docs, model).collect()}
    assert got[1] == [("card", False), ("phone", False)] and got[2] == got[3] == got[5] == []
    assert got[4] == [("email", False)] and got[None] == [("email", True)]
    wide = docs.withColumn("n_chars", F.lit(1).cast("long")).withColumn("spans", F.lit("clash"))
    out = pii.redact_column(wide, "text", "n_chars", model)
    text = {r["id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == wide.columns and text[None] == ("[EMAIL]", 7) and text[2] == (None, 1)
    assert text[1][0] == "see [PHONE] [CARD] now"
    assert pii.find(docs.limit(0), model).count() == 0


def test_pii_patterns_read_texts_without_a_trigger(spark):
    card, phone = " ".join("4111111111111111"), "+1 2 3 4 5 6 7 8"
    texts = {1: "8.8.8.8", 2: "dns 1.1.1.1 or 8.8.8.8", 3: phone, 4: f"card {card}.", 5: "1 2 3", 6: "no digits", 7: None}
    want = {1: [("ip", 0, 7)], 2: [("ip", 4, 11), ("ip", 15, 22)], 3: [("phone", 0, 16)], 4: [("card", 5, 36)],
            5: [], 6: [], 7: []}
    docs = frame(spark, list(texts.items()), "id long, text string")
    for model in (pii.SemiCrf(), pii.fit(pii.examples())):
        got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
               for r in pii.find(docs, model).collect()}
        assert got == want
        out = {r["id"]: r["text"] for r in pii.redact_column(docs, "text", None, model).collect()}
        assert out == {1: "[IP]", 2: "dns [IP] or [IP]", 3: "[PHONE]", 4: "card [CARD].", 5: "1 2 3", 6: "no digits", 7: None}


def brute_sketch(spark, text, width, scale):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    grams = [words[i:i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    if not grams:
        return []
    flat = spark.createDataFrame([(g,) for g in grams], "g array<string>")
    h = {r[0] for r in flat.select(F.xxhash64(F.transform("g", lambda w: F.xxhash64(w)))).collect()}
    low = sorted(x for x in h if x < -(1 << 63) + (1 << 64) // scale)
    return low or [min(h)]


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [t for t in texts_with_copies(rng, groups=4)][:18] + ["tail é" * 9]
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = frame(spark, shuffled, "id long, text string")
    got = {r["id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (id_, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt[:k]
        r = got[id_]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute_sketch(spark, x, 5, 8) for x in (t, edited, nxt))
        assert r["sketch"] == a and r["edited_sketch"] == b

        def likeness(x, y):
            return len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
        assert r["near_edited"] == pytest.approx(likeness(a, b)) and r["near_next"] == pytest.approx(likeness(a, c))


def test_fingerprints_ties_nulls_and_empty(spark):
    docs = frame(spark, [(None, "p q r s t u"), (3, "b"), (3, "a"), (3, "a"), (8, None)], "id long, text string")
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == 5
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    one = fingerprint.fingerprints(docs.limit(0).unionByName(frame(spark, [(1, "abcd efgh")], "id long, text string"))).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    merged = frame(spark, [([[-9223372036854775808, 5], [5, 9]],)], "s array<array<long>>")
    assert merged.select(fingerprint.merge(F.col("s"))).first()[0] == [-9223372036854775808]


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice(["en", "en", "de", None]), rng.choice(["x", "y"]),
             rng.randint(0, 50), 0.0) for i in range(3000)] + [(None, "a", "en", "x", 3, 1.0)] * 2
    docs = frame(spark, rows, "doc_id long, source string, lang string, topic string, n_tokens long, weight double")
    targets = frame(spark, [("source", "a", 1.0), ("source", "b", 1.0), ("source", "c", 2.0), ("lang", "en", 3.0),
                            ("lang", "de", 1.0), ("topic", "x", 0.5), ("topic", "y", 0.5)], "dim string, value string, share double")
    dims = ["source", "lang", "topic"]
    out = mixing.mix(docs, dims=dims, targets=targets, keep=0.3).cache()
    assert out.count() == len(rows) and out.columns[-3:] == ["weight", "probability", "sampled"]
    token = F.col("n_tokens") * F.col("weight")
    total = out.agg(F.sum(token)).first()[0]
    assert total == pytest.approx(sum(r[4] for r in rows))
    share = {r[0]: r[1] / total for r in out.groupBy("topic").agg(F.sum(token)).collect()}
    assert share["x"] == pytest.approx(0.5, abs=1e-3)
    by = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(token)).collect()}
    assert by["c"] / by["a"] == pytest.approx(2.0, rel=1e-2) and by["a"] / by["b"] == pytest.approx(1.0, rel=1e-2)
    expected = out.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0]
    assert expected == pytest.approx(0.3 * sum(r[4] for r in rows), rel=1e-6)
    kept = out.filter("sampled").agg(F.sum("n_tokens")).first()[0]
    assert kept == pytest.approx(expected, rel=0.1)
    assert mixing.mix(docs.limit(0), dims=dims, powers={}).count() == 0
    out.unpersist()


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("word_bpe_49k.json"))


def test_word_tables_encode_like_the_tokenizer():
    from tokenizers import Tokenizer
    path = tokenizer()
    whole, own = Tokenizer.from_file(path), packing.WordEncoder(path, 500)
    rng = random.Random(6)
    odd = ["It's 'S WE'LL \x1c a\x1cb İstanbul <|endoftext|>Foo é ΣΑΣ 中文 ½ a\u00adb K x\u0301", "", " \n\t\r ", "a\x0b\x0cb\x85c\u2003d",
           "12,345.67 (x) — “q” ǅ ß ẞ ŉ"]
    texts = odd + [" ".join("".join(rng.choice("abcdeéABC.,'1") for _ in range(rng.randint(1, 9))) for _ in range(400))
                   for _ in range(20)]
    for t in texts:
        want = np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert own(t) == want, t


def test_packing_is_whole_gapless_and_near_the_bound(spark):
    from tokenizers import Tokenizer
    path, rng = tokenizer(), random.Random(8)
    texts = [None, "", "word " * 5000] + ["alpha beta gamma " * rng.randint(1, 60) for _ in range(400)]
    docs = frame(spark, list(enumerate(texts)) + [(None, "twice"), (None, "twice")], "id long, text string")
    out = packing.pack(packing.tokenize(docs, path, capacity=256), capacity=256, shard_rows=150).toPandas()
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = out[out["id"] == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["start"].tolist() == list(range(0, len(ids), 256))
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert own["length"].sum() == len(ids)
    assert out["id"].isna().sum() == 2
    x = out.sort_values(["sequence_id", "offset"])
    assert (x.groupby("sequence_id")["length"].cumsum() - x["length"] == x["offset"]).all()
    fill = x.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 256 and len(fill) <= 1.02 * -(-fill.sum() // 256) + 1
    assert packing.pack(packing.tokenize(docs.limit(0), path)).count() == 0


def test_packing_ends_on_equal_pieces_that_fill_no_sequence(spark, monkeypatch):
    level, shards_of = packing._level, []

    def watched(items, shards, *rest):
        shards_of.append(shards)
        assert len(shards_of) < 2 or shards < shards_of[-2], shards_of
        return level(items, shards, *rest)
    monkeypatch.setattr(packing, "_level", watched)
    equal = F.when(F.col("id") < 40, 900).otherwise(1100)
    for length, sequences in ((equal, 2960), (1100 + F.col("id") % 700, 3000)):
        shards_of.clear()
        pieces = spark.range(3000).select("id", length.cast("long").alias("length"))
        out = packing.pack(pieces, shard_rows=400).toPandas()
        assert shards_of[0] == 8 and sorted(out["id"]) == list(range(3000))
        fill = out.groupby("sequence_id")["length"].sum()
        assert fill.max() <= 2048 and len(fill) == sequences
    assert shards_of == [8, 4, 2, 1]


def test_genetic_operators_keep_every_piece():
    rng = random.Random(12)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    start = packing.best_fit(sizes, list(range(300)), [], [], 100)
    for _ in range(20):
        start = packing.mutate(packing.cross(start, packing.evolve(sizes, [], 100, rng, generations=1), sizes, 100, rng),
                               sizes, 100, rng)
        assert sorted(x for b in start[0] for x in b) == list(range(300))
        assert [sum(sizes[x] for x in b) for b in start[0]] == start[1] and max(start[1]) <= 100
