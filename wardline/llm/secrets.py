"""Secret scans: fixed-shape secrets by pattern, free-form ones by sliding-window entropy per character class.

DataFrame expressions only, one projection, no shuffle. A pattern's matches get their places from the pieces between
them (`split`) and their own lengths. A candidate is a maximal run of a character class; a window slides over it, the
per-character counts and the sum of c*log2(c) are carried along and changed by the one character that enters and the
one that leaves. Candidates on the allow-list (words, UUIDs, placeholders, runs of the alphabet) are suppressed;
pattern matches never are.

Nulls are empty texts; an empty text has no spans. Rows are judged one by one, so repeated rows give repeated results,
an empty table gives an empty result, and no other column is looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import body, let, packed

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


@dataclass(frozen=True)
class CharClass:
    """Runs of `pattern` (only of `alphabet`) are candidates; hot if a window of `width` has `bits` or more."""

    kind: str
    pattern: str
    alphabet: str
    width: int
    bits: float


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("hexrun", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])", DIGITS + "abcdefABCDEF", 16, 2.93),
    CharClass("uprun", r"(?<![0-9A-Za-z])[A-Z0-9]{16,}(?![0-9A-Za-z])", DIGITS + UPPER, 16, 3.46),
    CharClass("mixrun", r"[A-Za-z0-9+/_=-]{20,}", DIGITS + UPPER + LOWER + "+/_=-", 20, 3.83),
)
KINDS = ("assign", "access", "hex") + tuple(c.kind for c in CLASSES)

# Candidates that match one of these are no secrets.
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[A-Za-z]+([-_/=+]+[A-Za-z]*)+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your[-_]",
    r"(?i)abcdefghij|0123456789",
)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value of the group), in code points."""
    none = F.array().cast(SPANS)
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    found = F.aggregate(zipped, start, step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(none)


def is_hot(value: Column, c: CharClass) -> Column:
    """Whether a window of `value` has an entropy that reaches the class limit.

    H = log2(width) - sum(c * log2 c) / width, so a hot window is one whose sum stays under a limit.
    """
    weight = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(c.width + 2)])
    limit = c.width * (math.log2(c.width) - c.bits)

    def slide(codes: Column, f: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            entering = codes[i]
            leaving = F.when(i >= c.width, F.get(codes, i - c.width)).otherwise(F.lit(-1))
            same = entering == leaving
            now_in, now_out = acc["n"][entering], F.get(acc["n"], leaving)
            gain = F.when(same, F.lit(0.0)).otherwise(f[now_in + 1] - f[now_in])
            loss = F.when(same | (leaving < 0), F.lit(0.0)).otherwise(F.get(f, now_out) - F.get(f, now_out - 1))
            counts = F.transform(acc["n"], lambda n, k: n + (k == entering).cast("int") - (k == leaving).cast("int"))
            total = acc["s"] + gain - loss
            hot = acc["hot"] | ((i >= c.width - 1) & (total <= limit))
            return F.struct(counts.alias("n"), total.alias("s"), hot.alias("hot"))

        zero = F.struct(
            F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(False).alias("hot")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step)["hot"]

    codes = F.transform(F.split(value, ""), lambda ch: F.when(ch == "", -1).otherwise(F.instr(F.lit(c.alphabet), ch) - 1))
    return let(F.filter(codes, lambda k: k >= 0), lambda arr: let(weight, lambda f: slide(arr, f)))


def entropy_spans(text: Column, c: CharClass) -> Column:
    """Candidates of one class with a hot window, those on the allow-list left out."""
    candidates = F.filter(matches(text, c.pattern), lambda m: ~m["value"].rlike("|".join(f"(?:{p})" for p in ALLOWED)))
    return F.filter(candidates, lambda m: is_hot(m["value"], c))


def clear_of(spans: Column, others: list[Column]) -> Column:
    """Spans that overlap none of the others."""
    taken = F.concat(*others)
    return F.filter(spans, lambda s: ~F.exists(taken, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))


def scan(docs: DataFrame, text: str = "text", prefix: str = "spans_") -> DataFrame:
    """`docs` with one array of (start, end, value) per kind: `spans_assign`, `spans_access`, ...

    Working columns of the same names in the input are replaced.
    """
    t = body(text)
    base = {
        "assign": F.filter(matches(t, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= 6),
        "access": F.filter(matches(t, ACCESS), lambda m: m["end"] - m["start"] >= 20),
        "hex": matches(t, HEX),
    }
    docs = docs.withColumns({prefix + k: v for k, v in base.items()})
    earlier = [F.col(prefix + k) for k in base]
    docs = docs.withColumns({prefix + c.kind: entropy_spans(t, c) for c in CLASSES})
    out = {}
    for c in CLASSES:
        out[prefix + c.kind] = clear_of(F.col(prefix + c.kind), earlier)
        earlier = [*earlier, F.col(prefix + c.kind)]
    return docs.withColumns(out)


def listed(kinds: tuple[str, ...], prefix: str = "spans_") -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def tag(n: int, kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = [tag(n, kind) for n, kind in enumerate(kinds)]
    return F.array_join(
        F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every span replaced by `mark`; overlapping spans become one mark. Texts without
    spans stay as they are; n_chars follows the text."""
    docs, unpacked = packed(docs, (text, "n_chars"))
    found = scan(docs, text)
    spans = [f"spans_{k}" for k in KINDS]
    whole = F.array_sort(F.concat(*[F.transform(F.col(s), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for s in spans]))

    def step(acc: Column, s: Column) -> Column:
        clean = s["start"] >= acc["at"]
        piece = F.substring(body(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.when(clean, F.concat(acc["out"], F.array(piece, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    cut = let(F.aggregate(whole, zero, step), lambda end: F.array_join(
        F.concat(end["out"], F.array(F.substring(body(text), (end["at"] + 1).cast("int"), F.lit(2**31 - 1)))), ""))
    changed = F.size(whole) > 0
    out = found.withColumn(text, F.when(changed, cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unpacked(out)
