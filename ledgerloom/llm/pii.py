"""Personal data in texts: generators propose candidates, boosted trees score them, calibrated thresholds select.

The four base kinds are found by fixed patterns and always stay. Generators of high recall propose further spans, which
may overlap the base spans and each other: written-out addresses, phone numbers in national forms, card and account
numbers that fail their check, identity numbers, IPv6 addresses. Each candidate is described by its format (lengths,
groups, check digits, shape) and its context (what stands beside it, which words come before it). Boosted trees score
it; a logistic curve fitted on held-out examples turns the margin into a probability; each kind has the least threshold
at which the held-out examples reach the wanted precision. Candidates are chosen from the highest score down, and none
that overlaps a base span or a chosen one.

The examples are made by rule from a seed, PII and look-alikes (versions, dates, prices, references), so the model needs
no table and is the same everywhere.

Null texts are empty. Rows are scanned one by one, whatever their doc_id; an empty table gives no rows; redact() keeps
other columns. Every pattern takes time linear in the text.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.boosting import Calibration, Trees
from ledgerloom.llm.columns import buffers, text_slices
from ledgerloom.llm.native import let
from ledgerloom.shipping import ship

BASE = ("email", "ip", "card", "phone")
MORE = ("written_email", "local_phone", "number", "identity", "iban", "ipv6")
KINDS = BASE + MORE

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, so the lookbehind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# the spellings of a written address; the gates below are made of them too
_AT, _DOT = r"\[at\]|\(at\)|\{at\}|\sat\s", r"\[dot\]|\(dot\)|\{dot\}|\sdot\s"
_HAS_AT, _HAS_DOT = re.compile(f"(?i){_AT}"), re.compile(rf"(?i){_DOT}|\.")
# both look ahead for the domain, as its last word can be the local part of the next address; a dot with a space beside
# it may end a sentence, so the second one takes only dots without
_WRITTEN = r"(?i)(?<![\w.+-])[\w.+-]++\s?(?:{at})\s?(?=([a-z0-9-]++(?:{dot}[a-z0-9-]{{2,}}+)+))"
_TIGHT = re.compile(_WRITTEN.format(at=_AT, dot=rf"(?:\s?(?:{_DOT})\s?|\.)"))
# RE2 knows fewer spaces than Python: these are all of Python's
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: RE2, for texts without digits and '@': a written address has an 'at', an IPv6 address two colons at most four digits apart.
MAYBE = f"(?i){_AT}|:[0-9a-f]{{0,4}}:".replace(r"\s", _SPACE)
_TLD = re.compile(r"(?i)[.\s\])}](?:com|org|net|edu|gov|mil|int|info|biz|io|me|ai|app|dev|co|eu|[a-z]{2})$")

GENERATORS = {
    "written_email": re.compile(_WRITTEN.format(at=_AT, dot=rf"\s?(?:{_DOT}|\.)\s?")),
    "local_phone": re.compile(r"(?<![\w.+])(?:\([0-9]{2,5}\)\x20?|00[0-9]{1,3}[\x20.-]|0[0-9]{1,4}[\x20/.-]|[0-9]{3}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,5}){1,4}(?![\w])"),
    "number": re.compile(r"(?<![\w.+-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2,3}(?:[\x20-]?[0-9]{1,3})?(?![\w])"),
    "identity": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "ipv6": re.compile(r"(?i)(?<![\w:])(?=:{0,2}[0-9a-f])(?:(?:[0-9a-f]{1,4}:){2,7}(?::?[0-9a-f]{1,4}|:)|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?)(?![\w:])"),
}
_CUES = {
    "phone": re.compile(r"(?i)phone|tel\b|tel[.:]|call|fax|mobile|cell|whatsapp|dial"),
    "mail": re.compile(r"(?i)mail|contact|write|reach|reply"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|payment"),
    "person": re.compile(r"(?i)ssn|social|passport|identity|insurance|tax"),
    "account": re.compile(r"(?i)iban|account|bank|transfer|bic"),
    "host": re.compile(r"(?i)\bip\b|address|host|server|ping|login"),
    "thing": re.compile(r"(?i)version|\bver\b|release|order|invoice|\bref|ticket|serial|isbn|part|model|tracking|\bno\b|\bid\b|page|figure|section|range|score|total|price|\$|€|build"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start; matches that fail their check are dropped."""
    out, upto = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > upto and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            upto = m.end()
        else:
            upto = max(upto, at + 1)
        at = text.find("@", max(at + 1, upto))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all that the generators propose."""
    out = []
    for k, (kind, pattern) in enumerate(GENERATORS.items()):
        if kind != "written_email":
            out += [(len(BASE) + k, m.start(), m.end()) for m in pattern.finditer(text)]
        elif _HAS_AT.search(text) and _HAS_DOT.search(text):
            for m in pattern.finditer(text):
                ends = {m.end(1)} | ({t.end(1)} if (t := _TIGHT.match(text, m.start())) else set())
                out += [(len(BASE) + k, m.start(), e) for e in sorted(ends)]
    return out


def described(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 12]
    digits = _NOT_DIGIT.sub("", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    letters = sum(c.isalpha() for c in span)
    year = re.match(r"(?:19|20)[0-9]{2}\b", span) is not None or re.search(r"\b(?:19|20)[0-9]{2}$", span) is not None
    l, r = before[-1:], after[:1]
    return [
        *(float(kind == k) for k in range(len(BASE), len(KINDS))),
        len(span), len(digits), letters, len(groups), max(groups), min(groups), float(len(set(groups)) == 1),
        span.count(" "), span.count("-"), span.count("."), span.count(":"), float("(" in span), float(span[:1] == "0"),
        float(len(digits) > 1 and luhn(digits)), float(kind == len(BASE) + 4 and mod97(span)), len(set(digits)), float(year), float("[" in span or "{" in span or re.search(r"(?i)\sdot\s", span) is not None),
        float(re.search(rf"(?i){_DOT}", span) is not None), float(re.search(r"\.\s|\s\.", span) is not None), float(kind == len(BASE) and _TLD.search(span) is not None), float("::" in span),
        float(l == "" or l.isspace()), float(l.isalnum()), float(l in "$€£#/=<" and l != ""), float(r == "" or r.isspace()), float(r in ".,;!?)" and r != ""), float(r in "%/=>-" and r != ""),
        *(float(c.search(before) is not None) for c in _CUES.values()),
    ]


def examples(n: int, seed: int) -> tuple[list[list[float]], list[int], list[int]]:
    """Candidates in sentences made by rule: features, whether they are PII, kinds."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuvwy") for _ in range(rnd.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))

    groups = lambda a, b: "".join(f":{rnd.randrange(65536):x}" for _ in range(rnd.randint(a, b)))
    ats, dots, tlds = [" [at] ", "[at]", " (at) ", "{at}", " at "], [" [dot] ", " dot ", "(dot)", " (dot) ", "{dot}", "\ndot "], ["com", "org", "net", "de"]

    def card() -> str:
        body = rnd.choice("3456") + digits(14)
        d = next(body + c for c in "0123456789" if luhn(body + c))
        return rnd.choice(["-", " "]).join(d[k : k + 4] for k in range(0, 16, 4)) if rnd.random() < 0.5 else d

    def iban() -> str:
        land, body = rnd.choice(["DE", "FR", "GB", "ES", "NL"]), digits(18)
        code = next(f"{land}{k:02d}{body}" for k in range(2, 99) if mod97(f"{land}{k:02d}{body}"))
        return " ".join(code[k : k + 4] for k in range(0, len(code), 4)) if rnd.random() < 0.5 else code

    pii = [
        (lambda: f"{word()}{rnd.choice(ats)}{word()}{rnd.choice(dots)}{rnd.choice(tlds)}", ["write to", "email", "contact me:", "mail", ""]),
        (lambda: f"{word()}{rnd.choice(ats)}{word()}.{rnd.choice(tlds)}", ["write to", "email", "contact me:", "mail", "e-mail:", "reach me:"]),
        (lambda: rnd.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0049 {digits(3)} {digits(6)[:3]} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]), ["call", "phone:", "Tel.", "mobile", "fax", "tel:"]),
        (card, ["card", "credit card number", "Visa", "payment with", "my card is"]),
        (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["SSN", "social security", "ssn:", "insurance number", ""]),
        (iban, ["IBAN", "account", "transfer to", "bank", ""]),
        (lambda: ":".join(f"{rnd.randrange(65536):x}" for _ in range(8)), ["IP", "address", "host", "server", ""]),
        (lambda: f"{rnd.choice(['2001', 'fe80', 'fd00', f'{rnd.randrange(4096, 65536):x}'])}{groups(0, 3)}:{groups(1, 4)}", ["IP", "address", "host", "server", ""]),
    ]
    other = [
        (lambda: f"{rnd.randint(1900, 2030)}-{digits(2)}-{digits(2)}", ["on", "date", "released"]),
        (lambda: f"{digits(3)} {digits(3)} {digits(3)}", ["population", "total", "price", "score", "order"]),
        (lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", ["serial", "order no", "part", "ticket", "isbn"]),
        (lambda: f"{digits(3)}.{digits(3)}.{digits(3)}", ["version", "total", "price $", "figure"]),
        (lambda: "".join(digits(4) for _ in range(4)), ["order", "tracking", "serial", "ref", "build", "", ""]),
        (lambda: "-".join(digits(4) for _ in range(4)), ["model", "ticket", "ref", "serial", ""]),
        (lambda: f"{digits(3)} {digits(2)} {digits(2)} {digits(3)}", ["range", "scores", "page", ""]),
        (lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", ["at", "time", "duration"]),
        (lambda: ":".join(digits(2) for _ in range(rnd.randint(4, 6))), ["time", "section", "score"]),
        (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["part", "order", "ref", "model"]),
        (lambda: f"{rnd.choice(['AB', 'XX', 'QZ', 'DE'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)}", ["part", "serial", "model", "ref"]),
        (lambda: f"{word()} at {word()} dot {word()}", ["look", "stay", "the", "we met"]),
        (lambda: f"{word()} at {word()}. {word().title()}", ["look", "stay", "the", "we met", "they", ""]),
        (lambda: f"{word()} at {word()}.{rnd.choice(tlds)}", ["look", "hosted", "the site", "available", "see it", ""]),
        (lambda: rnd.choice(["::add", "::bad", "add::bed", "a::b", "c::d", "::dead", "Face::Bed", "::f"]), ["call", "class", "use", "method", ""]),
        (lambda: f"{digits(4)} {digits(4)} {digits(4)}", ["", "total", "score", "id"]),
    ]
    x, y, kinds = [], [], []
    while len(x) < n:
        good = rnd.random() < 0.45
        make, cues = rnd.choice(pii if good else other)
        lead = f"{words(0, 5)} {rnd.choice(cues)}".strip()
        if rnd.random() < (0.1 if good else 0.3):
            lead = words(1, 6)
        value = make()
        text = f"{lead} {value}{rnd.choice(['', '', '.', ',', ' '])} {words(0, 5)}"
        a = text.index(value, len(lead))
        for k, s, e in candidates(text):
            if s < a + len(value) and e > a:
                x.append(described(text, k, s, e))
                # only a candidate that covers most of the value stands for it
                y.append(int(good and min(e, a + len(value)) - max(s, a) >= 0.8 * max(e - s, len(value))))
                kinds.append(k)
    return x[:n], y[:n], kinds[:n]


class Model:
    def __init__(self, n: int = 6000, seed: int = 11, precision: float = 0.98):
        x, y, kinds = (np.array(v, float) for v in examples(n, seed))
        part = np.arange(n) % 3 == 0
        self.trees = Trees(rounds=50, depth=4).fit(x[~part], y[~part])
        margin = self.trees.margin(x[part])
        self.common = Calibration().fit(margin, y[part], precision)
        self.threshold = np.full(len(KINDS), self.common.threshold)
        for k in range(len(BASE), len(KINDS)):
            own = kinds[part] == k
            if own.sum() >= 50 and 0 < y[part][own].mean() < 1:
                self.threshold[k] = max(self.common.threshold, self._least(self.common.probability(margin[own]), y[part][own], precision))

    @staticmethod
    def _least(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        order = np.argsort(-p, kind="stable")
        good = np.flatnonzero(np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision)
        return float(p[order][good[-1]]) if len(good) else 1.0

    def select(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        found = candidates(text)
        if not found:
            return []
        p = self.common.probability(self.trees.margin(np.array([described(text, *c) for c in found], float)))
        # base spans and chosen ones, disjoint runs by start
        taken = Intervals([(s, e) for _, s, e in base])
        out = []
        for k in np.argsort(-p, kind="stable").tolist():
            kind, s, e = found[k]
            if p[k] >= self.threshold[kind] and taken.add(s, e):
                out.append((kind, s, e, float(p[k])))
        return sorted(out)


class Intervals:
    """Spans by start; add() takes a span only if it overlaps none."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> bool:
        from bisect import bisect_right

        k = bisect_right(self.starts, s)
        if (k and self.ends[k - 1] > s) or (k < len(self.starts) and self.starts[k] < e):
            return False
        self.starts.insert(k, s)
        self.ends.insert(k, e)
        return True


@functools.cache
def model() -> Model:
    return Model()


SPANS = "array<struct<kind:int,start:long,end:long,score:double>>"


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and `pii_`: the spans of each document by kind and start; base spans have score 1."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep if c != "text"]).alias("row_"), F.col("text").cast("string").alias("text_"))
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    with_text = "text" in keep
    hint = np.zeros(256, bool)
    hint[[*range(0x30, 0x3A), 0x40]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches, "text_"):
            texts = part.column("text_")
            data, offsets = buffers(texts)
            sums = np.concatenate([[0], np.cumsum(hint[data])])
            maybe = np.diff(sums[offsets]) > 0
            maybe |= pc.match_substring_regex(texts, MAYBE).fill_null(False).to_numpy(zero_copy_only=False)
            spans: list[list] = [[] for _ in range(len(texts))]
            for d in np.flatnonzero(maybe).tolist():
                text = texts[d].as_py()
                base = base_spans(text)
                spans[d] = [{"kind": k, "start": s, "end": e, "score": 1.0} for k, s, e in base] + [{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in m.select(text, base)]
            yield pa.record_batch([part.column("row_"), *([texts] if with_text else []), pa.array(spans, span)], names=["row_", *(["text_"] if with_text else []), "pii_"])

    # the row's own type, not its text: its names may need quotes
    schema = StructType([f for f in rows.schema.fields if f.name == "row_" or with_text] + StructType.fromDDL(f"pii_ {SPANS}").fields)
    out = rows.mapInArrow(run, schema)
    return out.select(*[(F.col("text_") if c == "text" else F.col(f"row_.`{c}`")).alias(c) for c in keep], "pii_")


def redact(docs: DataFrame) -> DataFrame:
    """All documents with their columns; spans in `text` give way to a mark."""
    from ledgerloom.llm.secrets import cut

    found = find(docs, tuple(docs.columns))
    spans = F.sort_array(F.transform("pii_", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return found.withColumn("text", let(spans, lambda s: cut(F.col("text"), s, "[PII]"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of their spans, and all spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")
    s = F.col("pii_")
    n = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return find(docs).select("doc_id", *[n(k).alias(f"n_{x}") for k, x in enumerate(BASE)], F.sha2(told(F.filter(s, lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), told(s).alias("spans"))
