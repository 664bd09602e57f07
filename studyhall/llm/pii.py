"""Personal data: fixed patterns, joined by a semi-Markov conditional random field.

``base_spans`` finds the four kinds by their patterns, leftmost and non-overlapping per kind, in time
linear in the text. The semi-Markov model adds spans the patterns miss (other spellings of the same
kinds): it scores whole candidate segments of a region around digits and address signs, with
features of the whole span (shape, digit count, check sum, parts in range, cue word before it), and a
dynamic program over segments of at most ``LONGEST`` tokens chooses boundaries and kinds jointly.

Weights are fitted by stochastic gradient on the conditional log-likelihood (forward-backward over
segments) of a bounded sample: at most ``SAMPLE`` regions of the corpus, labelled by the base
patterns, and generated examples of other spellings and of look-alikes (see ``examples``). A region
the model would not change costs nothing but the regular expressions.

Defined results: null text is empty; a text without findings has an empty list; repeated rows are
scanned each; added spans never overlap base ones or each other. Positions are code points.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST = 22      # tokens of a segment
CONTEXT = 40      # characters of a region on either side of a trigger
SAMPLE = 500      # bound of the corpus regions that are fitted
SAMPLE_CHARS = 600
EPOCHS = 6
RATE = 0.2
MARGIN = 1.5      # an added span must beat leaving its tokens alone by this much

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def byte_parts(address: str) -> bool:
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in address.split(".")))


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) sorted by kind as listed, then start."""
    out = []
    at, end = text.find("@"), 0
    last = -1
    while at >= 0:
        low = max(end, last + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        last = at
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if byte_parts(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- segments -------------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9]{2,}|@|[\[({] ?(?i:at) ?[\])}]|\b(?i:at)\b(?= \S{1,40} (?i:dot) )")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.I)
_DOT = re.compile(r" ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot ", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,10}")
_CUE = re.compile(r"([^\W\d_]+)\W{0,3}$")
# Words that announce a kind (fixed values, in the corpus's languages).
CUES = {
    "email": ("email", "mail", "correo", "courriel", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "cc"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "telefono", "cell"),
}
_CUE_OF = {w: k for k, words in CUES.items() for w in words}


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and address signs, merged where they touch, cut at line ends."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a = max(0, m.start() - CONTEXT, text.rfind("\n", max(0, m.start() - CONTEXT), m.start()) + 1)
        b = min(len(text), m.end() + CONTEXT)
        line = text.find("\n", m.end(), b)
        b = line if line >= 0 else b
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _obfuscated(span: str) -> bool:
    """An address once bracketed or spelled-out signs are put back; a bare "at" needs a spelled dot."""
    plain = _DOT.sub(".", _AT.sub("@", span))
    if "@" not in plain and " dot " in span.lower():
        plain = re.sub(" at ", "@", plain, flags=re.I)
    return _ADDRESS.fullmatch(plain) is not None


def span_features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span text[a:b] and of its borders."""
    span = text[a:b]
    d = _digits(span)
    signs = sorted(set(re.sub(r"[^\W_]", "", span)))
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", lambda m: str(min(len(m[0]), 9)), span))
    groups = re.findall("[0-9]+", span)
    before = text[a - 1:a]
    after = text[b:b + 1]
    cue = _CUE.search(text[max(0, a - 24):a])
    letters = any(c.isalpha() for c in span)
    out = ["1", f"n{min(len(d), 20)}", f"l{letters}", f"s{''.join(signs)}"[:12], f"g{len(groups)}",
           f"b{'w' if before.isalnum() or before in '_-.@' and before else 's'}",
           f"e{'w' if after.isalnum() or after in '_-@' and after else 's'}"]
    if len(shape) <= 24:
        out.append(f"h{shape}")
    if not letters:
        if 13 <= len(d) <= 19:
            out.append(f"luhn{luhn(d)}{all(len(g) >= 4 for g in groups)}")
        dotted = re.sub(r"[\[({ ]*[.][\])} ]*", ".", span)
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", dotted):
            out.append(f"ip{byte_parts(dotted)}")
        lead = span[0] if span[0] in "+(" else "0"
        out.append(f"lead{lead}{min(len(groups[0]) if groups else 0, 4)}")
        out.append(f"tail{min(len(groups[-1]) if groups else 0, 5)}")
    elif _obfuscated(span):
        out.append("mail")
    if cue and cue[1].lower() in _CUE_OF:
        out.append(f"cue{_CUE_OF[cue[1].lower()]}")
    return out


def candidates(text: str) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """(token borders, segments (first token, token after the last, features)) of a region."""
    borders = [0, *(m.end() for m in _TOKEN.finditer(text))]
    out = []
    n = len(borders) - 1
    first = [text[borders[i]] for i in range(n)]
    for i in range(n):
        c = first[i]
        if not (c.isalnum() and c.isascii() or c in "+("):
            continue
        digits = 0
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            last = text[borders[j - 1]:borders[j]]
            if last == "\n":
                break
            digits += len(last) if last.isdigit() else 0
            if not (last.isalnum() and last.isascii()):
                continue
            if last.isdigit() or digits >= 7:
                span = text[borders[i]:borders[j]]
                if 7 <= digits <= 19 and not any(x.isalpha() for x in span):
                    out.append((i, j, span_features(text, borders[i], borders[j])))
                    continue
            if last.isalpha():
                span = text[borders[i]:borders[j]]
                if _obfuscated(span):
                    out.append((i, j, span_features(text, borders[i], borders[j])))
    return borders, out


class SemiCrf:
    """Zero-order semi-Markov field: a token outside entities scores 0, a segment w . features(kind)."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = dict(weights or {})

    def scores(self, features: list[str]) -> list[float]:
        get = self.w.get
        return [sum([get((k, f), 0.0) for f in features]) for k in KINDS]

    def learn(self, region: tuple[list[int], list[tuple[int, int, list[str]]]], gold: set, rate: float) -> None:
        """One gradient step; ``gold`` holds (first token, token after, kind)."""
        borders, segments = region
        n = len(borders) - 1
        scored = [(i, j, f, self.scores(f)) for i, j, f in segments]
        ends: dict[int, list] = {}
        starts: dict[int, list] = {}
        for s in scored:
            ends.setdefault(s[1], []).append(s)
            starts.setdefault(s[0], []).append(s)
        fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            fwd[j] = _logsum([fwd[j - 1]] + [fwd[i] + v for i, _, _, vs in ends.get(j, ()) for v in vs])
        for i in range(n - 1, -1, -1):
            bwd[i] = _logsum([bwd[i + 1]] + [bwd[j] + v for _, j, _, vs in starts.get(i, ()) for v in vs])
        for i, j, feats, vs in scored:
            for k, v in zip(KINDS, vs):
                g = ((i, j, k) in gold) - math.exp(fwd[i] + v + bwd[j] - fwd[n])
                if abs(g) > 1e-4:
                    for f in feats:
                        self.w[k, f] = self.w.get((k, f), 0.0) + rate * g

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """Best segmentation of a region: (kind, start, end) of its entities."""
        borders, segments = candidates(text)
        if not segments:
            return []
        n = len(borders) - 1
        ends: dict[int, list] = {}
        for i, j, f in segments:
            vs = self.scores(f)
            k = max(range(len(KINDS)), key=vs.__getitem__)
            if vs[k] > MARGIN:
                ends.setdefault(j, []).append((i, vs[k] - MARGIN, KINDS[k]))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, v, k in ends.get(j, ()):
                if best[i] + v > best[j]:
                    best[j], back[j] = best[i] + v, (i, k)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((k, borders[i], borders[j]))
                j = i
        return out[::-1]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))


def examples(seed: int = 11, each: int = 24) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated regions: other spellings of each kind, with and without a cue, and look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = rng.choice("3456") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def parts(sep: str) -> str:
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i:i + 4] for i in range(0, 16, 4))

    kinds = {
        "email": [lambda: f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com",
                  lambda: f"{word()} (at) {word()} (dot) com", lambda: f"{word()} [at] {word()}.org",
                  lambda: f"{word()}.{word()} at {word()} dot net", lambda: f"{word()}{num(2)}[at]{word()}[dot]com"],
        "ip": [lambda: parts("."), lambda: parts("[.]"), lambda: parts(" . ")],
        "card": [card, lambda: grouped(card(), " "), lambda: grouped(card(), "-"), lambda: grouped(card(), ".")],
        "phone": [lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}",
                  lambda: f"+{num(2)} {num(3)} {num(6)}", lambda: f"{num(3)}-{num(3)}-{num(4)}"],
    }
    noise = [lambda: num(rng.randint(7, 12)), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: num(16)[:15] + "x" + num(4),
             lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{parts('.')}.{num(2)}", lambda: f"9{num(2)}.{num(3)}.{num(3)}.7{num(2)}",
             lambda: "".join(rng.choice("abcdef0123456789") for _ in range(24)), lambda: f"{num(5)},{num(3)}.{num(2)}",
             lambda: f"{num(4)} {num(4)}", lambda: f"{word()} at {word()} {word()}", lambda: f"{num(2)}:{num(2)}:{num(2)} {num(4)}",
             lambda: " ".join(num(rng.randint(1, 4)) for _ in range(6)), lambda: f"{num(4)}/{num(4)}-{num(3)}"]
    out = []
    for kind, makers in kinds.items():
        for make in makers:
            for n in range(each):
                lead = f"{word()} {rng.choice(CUES[kind])}: " if n % 3 == 0 else f"{word()} {word()} "
                span = make()
                # A local number without a cue is not told from any other number.
                named = not (kind == "phone" and make is makers[3] and n % 3)
                out.append((f"{lead}{span}{rng.choice([' ', ', ', '. '])}{word()} {word()}",
                            [(kind, len(lead), len(lead) + len(span))] if named else []))
    for make in noise:
        out += [(f"{word()} {word()} {make()} {word()}", []) for _ in range(2 * each)]
    rng.shuffle(out)
    return out


def fit(sample: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS) -> SemiCrf:
    """Weights from regions with their true spans; of overlapping ones the kind listed first counts."""
    data = []
    for text, spans in sample:
        borders, segments = candidates(text)
        token = {b: i for i, b in enumerate(borders)}
        gold, taken = set(), []
        for k, a, b in sorted(spans, key=lambda s: KINDS.index(s[0])):
            if a in token and b in token and not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                gold.add((token[a], token[b], k))
        if segments:
            data.append(((borders, segments), gold))
    model, rng = SemiCrf(), random.Random(5)
    for e in range(epochs):
        rng.shuffle(data)
        for region, gold in data:
            model.learn(region, gold, RATE / (1 + 0.3 * e))
    return model


def labelled_regions(docs: DataFrame, bound: int = SAMPLE) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """At most ``bound`` regions of the corpus (the smallest by hash), labelled by the base patterns."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for id_, text in zip(f["id"], f["text"]):
                if text and _TRIGGER.search(text):
                    base = base_spans(text)
                    for a, b in regions(text):
                        if b - a <= SAMPLE_CHARS:
                            own = [f"{k}:{x - a}:{y - a}" for k, x, y in base if a <= x and y <= b]
                            out.append((id_, a, text[a:b], ",".join(own)))
            yield pd.DataFrame(out, columns=["id", "at", "region", "spans"])

    rows = docs.select("id", "text").mapInPandas(run, "id long, at long, region string, spans string")
    rows = rows.orderBy(F.xxhash64("id", "at"), "region").limit(bound).collect()
    return [(r["region"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)])
            for r in rows]


def all_spans(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans the model adds). The patterns read every text; only decoding needs a trigger."""
    if not text:
        return [], []
    base = base_spans(text)
    blocked = sorted((a, b) for _, a, b in base)
    added = []
    for a, b in regions(text):
        for k, x, y in model.decode(text[a:b]):
            if not any(x + a < q and p < y + a for p, q in blocked):
                added.append((k, x + a, y + a))
    return base, added


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """(id, spans) per row of ``docs`` (id, text); spans by kind as listed, then start."""
    sent = docs.sparkSession.sparkContext.broadcast(model.w)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = SemiCrf(sent.value)
        for f in frames:
            out = []
            for text in f["text"]:
                base, added = all_spans(text or "", own)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append([{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in spans])
            yield pd.DataFrame({"id": f["id"], "spans": out})
    return docs.select("id", "text").mapInPandas(run, f"id long, spans {SPANS}")


def redacted(text: str, model: SemiCrf) -> str:
    """``text`` with every span replaced by its kind in brackets (of overlapping ones the first)."""
    base, added = all_spans(text, model)
    out, at = [], 0
    for k, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_column(docs: DataFrame, text_col: str, chars_col: str | None, model: SemiCrf) -> DataFrame:
    """``docs`` with ``text_col`` redacted and, if there is such a column, ``chars_col`` set to its new
    length; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model.w)
    names = docs.columns
    at = names.index(text_col)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiCrf(sent.value)
        for b in tables:
            texts = [t and redacted(t, own) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, type=b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in names:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col))
                             .otherwise(F.length(text_col)).cast(kind))
    return out


def train(docs: DataFrame) -> SemiCrf:
    return fit(examples() + labelled_regions(docs))
