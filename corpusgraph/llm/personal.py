"""Personal data in texts: fixed patterns, and candidates judged by boosted trees."""

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.boosting import BoostedTrees
from corpusgraph.llm.tasks import lean

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn")
#: Share of the accepted held-out candidates of a kind that must be right.
PRECISION = 0.995
WINDOW = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost first and without overlap inside each kind, by kind and place."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append(("email", begin, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(
        len(x) < 4 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Generators: wide patterns whose matches are candidates of a kind.
GENERATORS = (
    ("phone", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])")),
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| at (?=[\w-]{1,63} dot ))[\w-]{1,63}"
                         r"(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[\w-]{1,63}){1,8}")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{3,4}){3,4}(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+")),
)
# Context words by what they speak for.
CONTEXTS = tuple(re.compile(rf"\b(?:{x})", re.I) for x in (
    "phone|tel|call|mobile|fax|cell|dial", "ssn|social", "e-?mail|contact|write|reach", "ip|host|addr|server|ping",
    "token|key|secret|passw|pwd|bearer|api|auth", "card|visa|amex|credit|debit|iban|account",
    "date|since|year|born|time|page|vol|chapter", "order|invoice|isbn|version|build|commit|part|serial|item|sku|ref|sha|hash"))


def _features(kind: int, text: str, begin: int, end: int) -> list[float]:
    """Format of the span and its surroundings, as numbers."""
    span, before, after = text[begin:end], text[max(0, begin - WINDOW):begin], text[end:end + 12]
    n, digits = len(span), [c for c in span if "0" <= c <= "9"]
    groups = [len(x) for x in re.split(r"[^0-9A-Za-z]+", span) if x] + [0, 0, 0, 0]
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [
        *(float(kind == k) for k in range(len(GENERATORS))), n, len(digits), len(digits) / n, sum(c.isupper() for c in span) / n,
        sum(c.islower() for c in span) / n, len(counts), entropy, sum(not c.isalnum() for c in span), *groups[:4], span.count("."),
        span.count("-"), span.count(":"), span.count("/"), float("(" in span or "[" in span), float(all(c in "0123456789abcdefABCDEF" for c in span)),
        float(len(digits) >= 13 and luhn("".join(digits))), float(before[-1:] in ("'", '"')), float(before.rstrip()[-1:] in (":", "=")),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in (".", ",")),
        *(float(bool(c.search(before))) for c in CONTEXTS)]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans that some generator proposes, ``(generator, begin, end)``; they may overlap."""
    return [(k, *m.span()) for k, (_, pattern) in enumerate(GENERATORS) for m in pattern.finditer(text)]


def _examples(count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, answers and generators of candidates in made-up lines of known content."""
    r = np.random.Generator(np.random.PCG64(seed))
    syllables = "ba ce di fo gu ha in ka lo mi no or pe qua ra st ti un ve wo".split()

    def pick(*xs):
        return xs[int(r.integers(len(xs)))]

    def digits(n):
        return "".join(str(x) for x in r.integers(0, 10, n))

    def word():
        return "".join(pick(*syllables) for _ in range(int(r.integers(1, 4))))

    def code(n, letters="0123456789abcdef"):
        return "".join(pick(*letters) for _ in range(n))

    def good_card():
        body = pick("4", "5", "37", "6011") + digits(12)
        body = body[:15]
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + last

    def right():
        kind = pick("phone", "ssn", "email", "ip", "card", "secret", "secret")
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return pick("phone ", "call ", "tel: ", "mobile ", "fax: "), pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")
        if kind == "ssn":
            return pick("ssn ", "SSN: ", "social security number "), f"{digits(3)}-{digits(2)}-{digits(4)}"
        if kind == "email":
            return pick("", "email ", "contact ", "write to "), word() + pick(" [at] ", "(at)", " at ") + word() + pick(" [dot] ", " dot ") + pick("com", "org", "net")
        if kind == "ip":
            return pick("", "host ", "from ", "addr "), ":".join(code(4) for _ in range(8)) if pick(0, 1) else f"fe80::{code(4)}:{code(4)}"
        if kind == "card":
            c = good_card()
            return pick("card ", "visa ", "credit card: ", ""), pick(".", "/").join((c[:4], c[4:8], c[8:12], c[12:]))
        n = int(r.integers(20, 64))
        key = pick("token", "api_key", "secret", "password", "auth key", "bearer")
        return key + pick(" = \"", "=", ": ", " = '"), pick(code(n), code(n, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))

    def wrong():
        y, m, d = pick("19", "20") + digits(2), f"{r.integers(1, 13):02d}", f"{r.integers(1, 29):02d}"
        return pick(
            ("since ", f"{y}-{m}-{d} {digits(2)}:{digits(2)}"), ("order ", f"{digits(4)}-{digits(4)}-{digits(4)}"), ("isbn ", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"),
            ("", f"{digits(3)} {digits(3)} {digits(3)}"), ("pages ", f"{digits(3)}-{digits(4)}"), ("at ", f"{digits(2)}:{digits(2)}:{digits(2)}"),
            ("commit ", code(40)), ("sha ", code(64)), ("", "-".join(word() for _ in range(5)) + "-" + digits(1)), ("", "/".join(word() for _ in range(5)) + "/" + digits(3)),
            ("version ", f"{digits(2)}.{digits(3)}.{digits(4)}"), ("", f"{word()} at {word()}. Dot {word()}"), ("part ", f"{digits(3)} {digits(2)} {digits(4)}"),
            ("serial ", f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}"), ("", f"{y}-{m}-{d}"), ("item ", f"{word()}_{word()}_{digits(12)}"),
            ("", f"{digits(3)}.{digits(3)} {digits(4)}"), ("", f"id_{code(24)}"), ("", f"{word()}{digits(16)}"), ("", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"))

    x, y, kinds = [], [], []
    for _ in range(count):
        answer = bool(r.integers(0, 2))
        lead, span = right() if answer else wrong()
        head = " ".join(word() for _ in range(int(r.integers(2, 8)))) + " "
        text = head + lead + span + pick(" ", ". ", ", ", "\" ", "\n") + " ".join(word() for _ in range(4))
        begin, end = len(head) + len(lead), len(head) + len(lead) + len(span)
        for kind, a, b in candidates(text):
            x.append(_features(kind, text, a, b))
            y.append(float(answer and a <= begin + 1 and b >= end - 1))
            kinds.append(kind)
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=2)
def trained(count: int = 6000, seed: int = 23) -> tuple[BoostedTrees, np.ndarray]:
    """The model, and per generator the least probability that keeps held-out precision at ``PRECISION``.

    Three quarters of the examples grow the trees, the rest calibrates them and sets the thresholds.
    """
    x, y, kinds = _examples(count, seed)
    hold = np.arange(len(y)) % 4 == 3
    model = BoostedTrees().fit(x[~hold], y[~hold]).calibrate(x[hold], y[hold])
    p, levels = model.probability(x[hold]), np.ones(len(GENERATORS) + 1)
    for kind in range(len(GENERATORS)):
        own = kinds[hold] == kind
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[hold][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        levels[kind] = max(0.5, p[own][order][good[-1]]) if len(good) else 2.0
    return model, levels


def _apart(base: list[tuple[str, int, int]], wanted: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``wanted``, the first ones first, that overlap neither ``base`` nor one kept before.

    Only spans of one stretch (spans that overlap directly or by way of others) can meet, so each
    stretch is settled alone, with the kept spans in order.
    """
    spans = sorted([(a, b, -1, "") for _, a, b in base] + [(a, b, k, kind) for k, (kind, a, b) in enumerate(wanted)])
    kept, at = [], 0
    while at < len(spans):
        to, stop = at + 1, spans[at][1]
        while to < len(spans) and spans[to][0] < stop:
            stop = max(stop, spans[to][1])
            to += 1
        starts, ends = [], []
        for a, b, k, _ in spans[at:to]:
            if k >= 0:
                continue
            if ends and a < ends[-1]:
                ends[-1] = max(b, ends[-1])
            else:
                starts.append(a)
                ends.append(b)
        for k, a, b, kind in sorted((k, a, b, kind) for a, b, k, kind in spans[at:to] if k >= 0):
            place = bisect_right(starts, a)
            if (place and ends[place - 1] > a) or (place < len(starts) and starts[place] < b):
                continue
            starts.insert(place, a)
            ends.insert(place, b)
            kept.append((k, (kind, a, b)))
        at = to
    return [span for _, span in sorted(kept)]


def found_spans(texts: list[str], model: BoostedTrees, levels: np.ndarray) -> list[tuple[list, list]]:
    """Per text the base spans, and the added ones: accepted candidates, most probable first, that overlap nothing kept before."""
    bases = [base_spans(t) for t in texts]
    proposed = [(row, *c) for row, t in enumerate(texts) for c in candidates(t)]
    p = model.probability(np.array([_features(k, texts[row], a, b) for row, k, a, b in proposed])) if proposed else np.zeros(0)
    chosen: dict[int, list] = {}
    for i in np.argsort(-p, kind="stable"):
        row, kind, a, b = proposed[i]
        if p[i] >= levels[kind]:
            chosen.setdefault(row, []).append((GENERATORS[kind][0], a, b))
    return [(base, _apart(base, chosen.get(row, []))) for row, base in enumerate(bases)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every stretch of spans replaced by the kind of its first one, ``[EMAIL]`` and so on."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _finder(redact: bool):
    model, levels = trained()

    @lean
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column("text").to_pylist()
                found = found_spans(texts, model, levels)
                if redact:
                    text = [redacted(t, b + a) if b or a else t for t, (b, a) in zip(texts, found)]
                    yield pa.RecordBatch.from_arrays(
                        [c for n, c in zip(part.schema.names, part.columns) if n != "text"] + [pa.array(text, pa.string())],
                        [n for n in part.schema.names if n != "text"] + ["text"])
                    continue
                counts = [Counter(k for k, _, _ in b) for b, _ in found]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in BASE_KINDS),
                    pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]),
                    pa.array([_joined(b + a) for b, a in found], pa.string())],
                    ["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])
    return run


def find_personal(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Personal data per text: ``id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The fixed patterns (:func:`base_spans`) always count. Wide generators propose further spans, which
    may overlap: phone and card numbers in other forms, social security numbers, written-out addresses,
    IPv6, secrets. Boosted trees judge them by format and context; a calibrated threshold
    per generator accepts. Counts and ``base_sha256`` are those of the fixed patterns, ``spans`` all.

    One pass without a shuffle; the model is grown on the driver from seeded examples and travels with the tasks. A null
    text is empty. Null and repeated ids are kept, one row each. Patterns take time in
    proportion to the text. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return rows.mapInArrow(
        _finder(False), f"id {rows.schema['id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")


def redact_personal(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the spans of :func:`find_personal` replaced in the text; a null text stays null."""
    if text_column != "text":
        raise ValueError("the text column must be named text")
    rows = docs.withColumn("_null", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(*[c for c in rows.columns if c != "text"], "text")
    done = rows.mapInArrow(_finder(True), rows.schema)
    return done.select(*[F.when(~F.col("_null"), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
