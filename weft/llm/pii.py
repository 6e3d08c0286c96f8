"""Personal data by patterns, checksums and context words, in DataFrame functions only.

Regular expressions propose spans: what splits the text are the proposals, and the lengths of pieces and proposals give
their places. Validators confirm them (ranges, digit counts, Luhn, mod-97). Words within CONTEXT characters around a span
raise its score; kinds without a checksum are kept only from KEEP on.

The patterns of the base kinds are written so that each text is read once: where a run of characters has been tried from its
start, the rest of the run is not tried again, which the lookbehind and \\G say; the matches are those of the plain patterns.

Defined cases: null text is empty and has no spans; equal rows have equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
KEEP = 0.6
#: Items that one step of the two-level running sum takes.
STEP = 128

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
CARD = r"[0-9](?:[ -]?+[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body uses it in loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_before(values: Column) -> Column:
    """Sums of the earlier values, in two levels, so that many matches in one text stay cheap."""

    def blocks(values: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda b: F.slice(values, b * STEP + 1, STEP))
        return let(at, lambda parts: let(F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, lambda part, i: let(total(F.slice(sums, F.lit(1), i)), lambda base: F.transform(part, lambda _, j: base + total(F.slice(part, F.lit(1), j))))))))

    return let(values, blocks)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether at most 20 digits pass."""
    doubled = F.translate(x, "0123456789", "0246813579")
    padded, twice = F.lpad(x, 20, "0"), F.lpad(doubled, 20, "0")
    terms = [F.substring(padded if i % 2 == 0 else twice, i, 1).cast("int") for i in range(1, 21)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number's check digits fit."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97)
    return rest == 1


def between(x: Column, low: int, high: int) -> Column:
    return (F.length(x) >= low) & (F.length(x) <= high)


class Kind:
    def __init__(self, name: str, pattern: str, confirm: Callable[[Column], Column], score: float, words: str, hint: str | None = None, base: bool = False):
        self.name, self.pattern, self.confirm, self.score, self.words, self.hint, self.base = name, pattern, confirm, score, words, hint, base


#: The base kinds come first, in the order in which spans of one start are listed.
KINDS = [
    Kind("email", EMAIL, lambda x: F.lit(True), 0.9, "mail|contact|write|correo|adresse", "@", True),
    Kind("ip", IP, lambda x: x.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"), 0.6, "ip|host|server|address|addr", None, True),
    Kind("card", CARD, lambda x: let(digits(x), lambda d: F.when(between(d, 12, 19), luhn(d)).otherwise(False)), 0.8, "card|visa|credit|pay|karte|carte|tarjeta", None, True),
    Kind("phone", PHONE, lambda x: between(digits(x), 9, 15), 0.7, "phone|tel|call|mobile|fax|whatsapp", "+", True),
    Kind("iban", IBAN, mod97, 0.9, "iban|account|bank|konto"),
    Kind("secret", SECRET, lambda x: F.lit(True), 0.4, "token|secret|key|password|passwd|auth|bearer"),
    Kind("national_id", NATIONAL_ID, lambda x: ~x.rlike("^(000|666|9)|-00-|-0000$"), 0.4, "ssn|social|insurance|national|id"),
]
SPAN = "struct<start:int,kind:int,stop:int,score:double>"


def kind_spans(text: Column, index: int) -> Column:
    """Confirmed spans of one kind as structs (start, kind, stop, score)."""
    kind = KINDS[index]
    pattern = F.lit(kind.pattern)
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        def inner(pieces: Column) -> Column:
            size = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))

            def span(i: Column, before: Column) -> Column:
                match, piece = F.get(found, i), F.get(pieces, i)
                start = before + F.length(piece)
                near = F.lower(F.concat(F.right(piece, F.lit(CONTEXT)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(CONTEXT))))
                score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.words})\b"), 0.3).otherwise(0.0))
                return F.when(kind.confirm(match), F.struct(start.alias("start"), F.lit(index).alias("kind"), (start + F.length(match)).alias("stop"), F.round(score, 2).alias("score")))

            spans = F.transform(running_before(size), lambda before, i: span(i, before))
            return F.filter(spans, lambda s: s.isNotNull() if kind.base else s.isNotNull() & (s["score"] >= KEEP))

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, kind.pattern, -1), inner)).cast(f"array<{SPAN}>")

    spans = let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(kind.hint)), spans).otherwise(none) if kind.hint else spans


def spans_of(text: str) -> Column:
    """All spans of the text column (no nulls) in order of start, then kind."""
    return F.array_sort(F.concat(*[kind_spans(F.col(text), i) for i in range(len(KINDS))]))


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with found: all spans in order of start, then kind."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("found", spans_of("text"))


def listed(spans: Column, with_score: bool = False) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    parts = lambda s: [F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"), *([s["score"].cast("string")] if with_score else [])]
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *parts(s))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, all spans, and all spans with scores."""
    base = sum(k.base for k in KINDS)
    found = find(docs).select("doc_id", "found")
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        F.col("doc_id").cast("long"), *[count(i).alias(f"n_{KINDS[i].name}") for i in range(base)],
        F.sha2(listed(F.filter("found", lambda s: s["kind"] < base)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), listed(F.col("found"), True).alias("scored_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with each span replaced by its kind in angle brackets; of overlapping spans the earliest is."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    apart = F.aggregate("found", F.array().cast(f"array<{SPAN}>"), lambda a, s: F.when((F.size(a) == 0) | (s["start"] >= F.element_at(a, -1)["stop"]), F.concat(a, F.array(s))).otherwise(a))
    text = F.col("text")
    pieces = lambda spans: F.transform(spans, lambda s, i: F.concat(F.substr(text, F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))), F.lit("<"), F.get(names, s["kind"]), F.lit(">")))
    whole = let(apart, lambda spans: F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces(spans), ""), F.substr(text, F.element_at(spans, -1)["stop"] + 1))))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return held.withColumn("found", spans_of("text")).select(F.col("row").withField("text", whole).alias("row")).select("row.*")
