"""Language identification of web pages by Bayesian evidence fusion.

Four pieces of evidence about a page's language L are combined into one posterior:

* the **text**: a naive Bayes model over hashed byte trigrams of the page's visible text, tempered
  (trigrams overlap, so their log-likelihood is divided by ``temper``) and with trigram counts per
  language from all labelled documents, by a grouped aggregate;
* the **declared markup language** (``<html lang=...>``), with P(declared | L) estimated from how
  pages whose text is clear declare themselves;
* the **address suffix** (last label of the host), with P(suffix | L) estimated the same way;
* the **host**: a prior smoothed along host -> site (last two labels) -> suffix -> all pages, each
  level adding its own counts to ``strength`` pseudo-pages of the level above.

All counts are weighted by the text posterior, so an unclear page says little. They are grouped
aggregates; each page is joined to its host's prior and its evidence rows, never gathered by host.

Defined results: null or empty html has no text evidence; a page without host, suffix or declared
language has none of that kind (likelihood one for all); a page without any evidence gets the
most common language; ties go to the alphabetically first; with no labelled document, languages are
unknown (null, posterior null); repeated rows count each time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyhall.llm.common import written
from studyhall.llm.hashing import U64, batches, mix

BITS = 14
TEMPER = 8.0
STRENGTH = 5.0

_HIDDEN = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^<>]*>")
_DIGITS_SIGNS = bytes(32 if b < 128 and not chr(b).isalpha() else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def visible_text(html: str | None) -> str:
    """The text between tags, without scripts, styles and comments."""
    return _TAG.sub(" ", _HIDDEN.sub(" ", html)) if html else ""


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each byte trigram, offsets per text); runs of non-letters count as one space."""
    clean = [b" ".join([b"", *t.translate(_DIGITS_SIGNS).split(), b""]) for t in texts]
    buf = np.frombuffer(b"".join(clean), dtype=np.uint8).astype(np.uint64)
    at = np.cumsum([0] + [len(c) for c in clean])
    if len(buf) < 3:
        return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    slots = (mix(buf[:-2] | (buf[1:-1] << U64(8)) | (buf[2:] << U64(16))) >> U64(64 - BITS)).astype(np.int32)
    # Trigrams that would run over a text's end are dropped by shortening each range.
    return slots, at


def _ranges(at: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in zip(at[:-1], at[1:]):
        yield int(a), max(int(a), int(b) - 2)


def trigram_counts(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)) from all rows of (text, lang): every label value has a row of
    2**BITS numbers, so the table grows with the number of label values."""
    known = labelled.filter("lang is not null and lang <> ''").select(F.lower("lang").alias("lang"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, g in f.groupby("lang"):
                if lang not in total:
                    total[lang] = np.zeros(1 << BITS, dtype=np.int64)
                for texts in batches(t.encode() if t else b"" for t in g["text"]):
                    slots, at = _trigrams(texts)
                    # Over all texts of one language the few trigrams across ends do no harm.
                    total[lang] += np.bincount(slots, minlength=1 << BITS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "slot": at, "n": n[at]})

    rows = (known.mapInPandas(run, "lang string, slot int, n long").groupBy("lang", "slot")
            .agg(F.sum("n").alias("n")).toPandas())
    code, langs = pd.factorize(rows["lang"], sort=True)
    langs = langs.tolist()
    table = np.zeros((len(langs), 1 << BITS))
    table[code, rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    table += 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if len(langs) else table


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(host, F.lit(""))


def declared_of(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute."""
    lang = F.regexp_extract(F.coalesce(html, F.lit("")), "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.nullif(F.lower(lang), F.lit(""))


def text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(id, host, declared, ll): tempered log-likelihood of the visible text per language, best at 0."""
    sent = pages.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = sent.value
        for f in frames:
            out = []
            for texts in batches(visible_text(h).encode() for h in f["html"]):
                slots, at = _trigrams(texts)
                for a, b in _ranges(at):
                    s = logs[:, slots[a:b]].sum(axis=1, dtype=np.float64) / TEMPER if b > a else np.zeros(len(langs))
                    out.append((s - s.max()).tolist() if len(s) else [])
            yield pd.DataFrame({"id": f["id"], "host": f["host"], "declared": f["declared"], "ll": out})
    return pages.select("id", "host", "declared", "html").mapInPandas(
        run, "id long, host string, declared string, ll array<double>")


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0.0)))


def _sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Posterior mass per language (array) of each group; partial sums before the shuffle."""
    return rows.groupBy(*by).agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(n)]).select(
        *by, F.array(*[f"s{i}" for i in range(n)]).alias("mass"))


def identify(pages: DataFrame, labelled: DataFrame, *, strength: float = STRENGTH) -> DataFrame:
    """(id, lang, posterior, text_lang, declared, host) per row of ``pages`` (id, url, html);
    ``labelled`` is (text, lang)."""
    langs, table = trigram_counts(labelled)
    n = len(langs)
    rows = pages.select("id", host_of(F.col("url")).alias("host"), declared_of(F.col("html")).alias("declared"), "html")
    if not n:
        return rows.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    names = F.array(*[F.lit(x) for x in langs])
    rows = text_evidence(rows, langs, table)
    rows = rows.withColumn("post", _posterior(F.col("ll")))
    rows = rows.withColumn("site", F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1)).withColumn(
        "suffix", F.regexp_extract("host", "([^.]+)$", 1))
    rows = written(rows, "pages")

    # Smoothed priors down the levels: all -> suffix -> site -> host.
    everything = _sums(rows, [], n).select(F.transform("mass", lambda m: F.coalesce(m, F.lit(0.0)) + 1.0).alias("mass"))
    share = F.transform("mass", lambda m: m / F.aggregate("mass", F.lit(0.0), lambda a, b: a + b))
    root = everything.select(share.alias("prior")).first()
    base = root["prior"]
    base_col = F.array(*[F.lit(float(x)) for x in base])

    def below(level: DataFrame, parent: DataFrame | None, key: str | None) -> DataFrame:
        if parent is None:
            joined = level.withColumn("up", base_col)
        else:
            joined = level.join(parent.select(F.col(key), F.col("prior").alias("up")), key, "left").withColumn(
                "up", F.coalesce("up", base_col))
        mixed = F.zip_with("mass", "up", lambda m, u: m + F.lit(strength) * u)
        total = F.aggregate(mixed, F.lit(0.0), lambda a, b: a + b)
        return joined.withColumn("prior", F.transform(mixed, lambda m: m / total)).drop("up", "mass")

    hosted = rows.filter("host is not null")
    hosts = _sums(hosted, ["host", "site", "suffix"], n)
    sites = hosts.groupBy("site", "suffix").agg(*[F.sum(F.col("mass")[i]).alias(f"s{i}") for i in range(n)]).select(
        "site", "suffix", F.array(*[f"s{i}" for i in range(n)]).alias("mass"))
    suffixes = sites.groupBy("suffix").agg(*[F.sum(F.col("mass")[i]).alias(f"s{i}") for i in range(n)]).select(
        "suffix", F.array(*[f"s{i}" for i in range(n)]).alias("mass"))
    top = below(suffixes, None, None)
    priors = below(hosts, below(sites, top, "suffix").drop("suffix"), "site").select("host", "prior")

    # P(value | language) of the declared languages and of the suffixes, smoothed to their overall share.
    def likelihood(by: str) -> DataFrame:
        mass = _sums(rows.filter(F.col(by).isNotNull() & (F.col(by) != "")), [by], n)
        sums = mass.agg(*[F.sum(F.col("mass")[i]).alias(f"t{i}") for i in range(n)]).first()
        totals = [float(x or 0.0) for x in sums]
        overall = F.aggregate("mass", F.lit(0.0), lambda a, b: a + b) / max(sum(totals), 1e-9)
        totals_col = F.array(*[F.lit(t) for t in totals])
        return mass.select(by, F.zip_with("mass", totals_col, lambda m, t: F.log((m + overall) / (t + 1.0))).alias(f"ll_{by}"))

    rows = (rows.join(priors, "host", "left").join(likelihood("declared"), "declared", "left")
            .join(likelihood("suffix"), "suffix", "left"))
    nothing = F.array(*[F.lit(0.0)] * n)
    logs = F.transform(F.coalesce("prior", base_col), lambda x: F.log(x))
    for part in ("ll", "ll_declared", "ll_suffix"):
        logs = _add(logs, F.coalesce(F.col(part), nothing))
    rows = rows.withColumn("logs", logs).withColumn("posteriors", _posterior(F.col("logs")))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    text_best = F.array_position("post", F.array_max("post")).cast("int")
    flat = F.array_max("ll") == F.array_min("ll")
    return rows.select("id", F.element_at(names, best).alias("lang"), F.array_max("posteriors").alias("posterior"),
                       F.when(~flat | F.lit(n == 1), F.element_at(names, text_best)).alias("text_lang"), "declared", "host")
