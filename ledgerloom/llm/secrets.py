"""Secrets in texts, and credentials whose parts lie near each other.

Strong patterns are reported wherever they occur. Weak candidates (short assignments, runs that look random) are parts
of a credential only if a complementary part, an access identifier or an endpoint, lies wholly before or after the
candidate, within `reach` code points and in the same scope of the text: blank lines, lines of three or more of - = * # and
section headers such as [name] part scopes. The parts of a text are sorted by place, and one sweep forward and one backward
give each candidate the nearest complementary parts on both sides and the borders of its scope: an interval join that needs
no shuffle, emits no pairs and takes n log n steps for n parts. All of it is DataFrame operations on single rows, so
hot sources and lost executors cost nothing but the rows themselves.

Null texts are empty. Rows are scanned one by one, whatever their doc_id; other columns are kept by redact() and
ignored by scan_spans(). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.native import let, matches, scan

# The patterns of the strong kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "linked")

#: Access identifiers and endpoints, in lower or upper case.
ANCHOR = r"""(?i:(?:access_?key_?id|client_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*+[:=]\x20*+["']?[a-z0-9@._-]{3,}+|(?:[a-z][a-z0-9+.-]{1,15}://|(?:host|endpoint|server|url)["']?\x20*+[:=]\x20*+["']?)[a-z0-9._-]{3,}+)"""
#: What names a weak assignment, up to its value.
LABEL = r"""(?i:\b(?:key|pwd|pass|auth|credentials?|private_?key|session)["']?\x20*+[:=]\x20*+["']?)"""
#: Weak secrets: an assignment to a key-like name, or a run of 32 characters or more that could be random; both to their
#: end. Runs are looked at from their first character only, so the time is linear.
WEAK = LABEL + r"""[A-Za-z0-9+/_.=-]{6,}+|(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"""

#: What parts scopes, from one line feed to the next.
BORDER = r"""\n(?=[\x20\t\r]*+(?:\n|[-=*#]{3,}+[\x20\t\r]*+(?:\n|$)|\[[\w\x20.:/-]++\][\x20\t\r]*+(?:\n|$)))"""

_NONE = "cast(array() as array<struct<start:bigint,end:bigint,kind:int>>)"
_FAR = 1 << 60
#: Code points of the chunks that texts are cut from.
CHUNK = 1024


def _spans(text: Column, found: Column, kind: int, sure: Column | None = None, least: int = 0, group: str | None = None) -> Column:
    """Spans of one kind; `sure` is a cheap test that the text has any."""

    def fits(m: Column) -> Column:
        of = F.regexp_extract(m["found"], group, 2) if group else m["found"]
        return F.length(of) >= least

    got = F.transform(F.filter(found, fits) if least else found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(sure, got).otherwise(F.expr(_NONE)) if sure is not None else got


def weak_spans(text: Column) -> Column:
    """Weak spans: array of (start, end, value), value being where the name of an assignment ends and its value begins."""
    value = lambda m: m["start"] + F.length(F.regexp_extract(m["found"], f"^{LABEL}", 0))
    got = F.transform(matches(text, WEAK), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), value(m).alias("value")))
    return F.when(text.rlike(WEAK), got).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:bigint>>)"))


def linked(base: Column, anchors: Column, weak: Column, borders: Column, reach: int) -> Column:
    """Of the weak spans, those whose value lies in no base span and that have an anchor or an access identifier within
    reach, wholly before or after them and not beyond a border. A value that only overlaps base spans stays whole."""
    low, high = F.lit(-_FAR).cast("long"), F.lit(_FAR).cast("long")
    # what a sweep passes: what counts is its `at`, in the order of `place`; of equal places role 0 comes first
    event = lambda a, place, role, **at: F.transform(a, lambda x: F.struct(x[place].alias("place"), F.lit(role).alias("role"), *[(x[at[k]] if k in at else F.lit(None).cast("long")).alias(k) for k in ("base", "anchor", "border", "start", "end")]))
    names = ("base", "anchor", "border")
    kind = f"struct<{','.join(f'{k}:bigint' for k in names)}>"
    both = lambda f: lambda x, y: F.struct(*[f(x[k], y[k]).alias(k) for k in names])
    ids = F.concat(anchors, F.filter(base, lambda x: x["kind"] == 1))

    def swept(events: Column, edge: Column, merge: Callable) -> Column:
        """What lies before each weak span in the order of the events, weak spans in that order."""
        of = lambda e: scan(F.transform(e, lambda x: F.struct(*[F.coalesce(x[k], edge).alias(k) for k in names])), F.struct(*[edge.alias(k) for k in names]), both(merge), kind)
        return let(events, lambda e: F.transform(F.filter(F.arrays_zip(e.alias("x"), of(e).alias("seen")), lambda j: j["x"]["role"] == 1), lambda j: F.struct(j["x"]["start"].alias("start"), j["x"]["end"].alias("end"), j["seen"].alias("seen"))))

    # weak spans do not overlap, so they have one order in all sweeps
    spans = {"start": "start", "end": "end"}
    covered = swept(F.sort_array(F.concat(event(base, "start", 0, base="end"), event(weak, "value", 1, **spans))), low, F.greatest)
    before = swept(F.sort_array(F.concat(event(ids, "end", 0, anchor="end"), event(borders, "end", 0, border="end"), event(weak, "start", 1, **spans))), low, F.greatest)
    # backwards by negative places
    back = lambda a: F.transform(a, lambda x: F.struct((-x["place"]).alias("place"), *[x[k].alias(k) for k in ("role", *names, "start", "end")]))
    after = F.reverse(swept(F.sort_array(back(F.concat(event(ids, "start", 0, anchor="start"), event(borders, "start", 0, border="start"), event(weak, "end", 1, **spans)))), high, F.least))

    def near(j: Column) -> Column:
        l, r = j["b"]["seen"], j["a"]["seen"]
        left = (l["anchor"] > l["border"]) & (j["b"]["start"] - l["anchor"] <= reach)
        right = (r["anchor"] < r["border"]) & (r["anchor"] - j["b"]["end"] <= reach)
        return (j["c"]["seen"]["base"] < j["c"]["end"]) & (left | right)

    joined = F.arrays_zip(covered.alias("c"), before.alias("b"), after.alias("a"))
    got = F.transform(F.filter(joined, near), lambda j: F.struct(j["b"]["start"].alias("start"), j["b"]["end"].alias("end"), F.lit(3).alias("kind")))
    return F.when((F.size(weak) > 0) & (F.size(ids) > 0), got).otherwise(F.expr(_NONE))


def found(text: Column, reach: int = 200) -> Column:
    """All spans of a text, sorted by start and kind: array of (start, kind, end), kinds by their place in KINDS."""

    def all_spans(t: Column) -> Column:
        sets = t.rlike("[:=]")
        base = F.concat(
            _spans(t, matches(t, ASSIGN), 0, sets & t.rlike("(?i:pass|secret|token|api)"), 12, ASSIGN),
            _spans(t, matches(t, ACCESS), 1, t.contains("AKIA"), 18),
            _spans(t, matches(t, "[0-9a-f]{16,}+"), 2, t.rlike("[0-9a-f]{16}")),
        )
        weak = weak_spans(t)
        beside = F.struct(_spans(t, matches(t, ANCHOR), 3, sets).alias("a"), _spans(t, matches(t, BORDER), 4, t.contains("\n")).alias("p"))
        joined = let(F.struct(base.alias("b"), weak.alias("w")), lambda s: F.concat(s["b"], F.when(F.size(s["w"]) > 0, let(beside, lambda x: linked(s["b"], x["a"], s["w"], x["p"], reach))).otherwise(F.expr(_NONE))))
        return F.sort_array(F.transform(joined, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))

    return let(F.coalesce(text.cast("string"), F.lit("")), all_spans)


def scan_spans(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id and the spans of each document."""
    return docs.select("doc_id", found(F.col("text"), reach).alias("spans"))


def cut(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark; linear in the text and the spans."""

    def joined(s: Column) -> Column:
        upto = scan(F.transform(s, lambda x: x["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b), "bigint")
        # pieces are cut from chunks of the text, as a place in a long text is found by counting from its start
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        whole = lambda c, a, b: F.array_join(F.slice(c, (F.floor(a / CHUNK) + 1).cast("int"), (F.ceil(b / CHUNK) - F.floor(a / CHUNK)).cast("int")), "")
        piece = lambda c, a, b: F.when(b > a, F.substring(whole(c, a, b), (a % CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise("")
        begins = F.filter(F.arrays_zip(s.alias("x"), upto.alias("u")), lambda j: (j["u"] == 0) | (j["x"]["start"] >= j["u"]))
        return let(chunks, lambda c: F.concat(
            F.array_join(F.transform(begins, lambda j: F.concat(piece(c, j["u"], j["x"]["start"]), F.lit(mark))), ""),
            let(F.array_max(F.transform(s, lambda x: x["end"])), lambda e: piece(c, e, F.greatest(e, F.length(text).cast("long")))),
        ))

    return F.when(F.size(spans) > 0, let(spans, joined)).otherwise(text)


def redact(docs: DataFrame, reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """All documents with their columns; spans in `text` give way to the mark, and `n_chars`, if there, follows."""
    new = let(found(F.col("text"), reach), lambda s: cut(F.col("text"), s, mark))
    changed = docs.withColumn("text", new)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("text").isNull(), docs["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def summary(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row a document: counts of the strong kinds, a digest of their spans, and all spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")
    n = lambda s, k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    row = let(F.col("spans"), lambda s: F.struct(
        *[n(s, k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(told(F.filter(s, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        told(s).alias("spans"),
    ))
    return scan_spans(docs, reach).select("doc_id", row.alias("r")).select("doc_id", "r.*")
