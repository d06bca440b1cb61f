"""Quality rules: per-text word and repetition rules, and lines that many documents of a host share.

DataFrame expressions only. A line is normalised and hashed; per host it counts the distinct documents that hold it. Documents
with all word lines alike count once, so that copies of one text do not make its lines common; near copies count each. A line
that more than `min_docs` distinct documents of a host hold is over the limit, whatever the size of the host. Such lines are
removed from every document but the host's first that holds it (lowest doc_id), and a document of which less than `min_left`
of the words are left is rejected as depleted.

Only lines over the limit are joined back to the documents, never the lines of all texts; counts are partial before each
shuffle, so one line in every document, or one host with most documents, costs a task no more than any other. Texts are
shuffled only in `cleaned`, and there only those that a bitmap of fixed size takes for texts with lines to remove.

A null text is empty and has no words; a null source is a host of its own. Repeated rows are judged alike. An empty table
gives an empty result. Only doc_id, source, text and n_chars are looked at; `cleaned` keeps all other columns, whatever their
names. Lines and documents are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import body, let, packed, parted, stage, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    min_docs: int = 20
    min_left: float = 0.5


WHOLE = Limits()


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, blanks as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0"))


def n_repeat_words(found: Column, width: int) -> Column:
    """Words that lie in a `width`-word window found twice or more, by hashes of the windows, sorted with their places."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            again = F.filter(
                F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), (
                    ((k > 0) & F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)))
                    | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
                ).alias("twice"))),
                lambda x: x["twice"],
            )
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
            return F.aggregate(
                starts, zero,
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
            )["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, repeated))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))

    hashes = let(F.transform(found, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(found) < width, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def measures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`docs` with the per-text counts."""
    t = body("text")
    docs = docs.withColumns({"_words": words(t), "_lines": word_lines(t)})
    return docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": n_repeat_words(F.col("_words"), limits.window),
    }).withColumn(
        "base_failed",
        (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words")),
    ).drop("_words", "_lines")


def with_row_key(docs: DataFrame) -> DataFrame:
    """A key per (doc_id, source, text): the same for repeated rows, whose decisions are the same too."""
    return docs.withColumn("_row", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "source", "text"))


def line_rows(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per word line: _row, doc_id, source, signature of the document, place, hash and words of the line."""
    lines = F.transform(word_lines(body("text")), lambda x: F.struct(
        F.xxhash64(normal_line(x)).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    return docs.select("_row", "doc_id", "source", lines.alias("_l")).select(
        "_row", "doc_id", "source", F.xxhash64("_l.line").alias("sig"), F.posexplode("_l").alias("pos", "l")).select(
        "_row", "doc_id", "source", "sig", "pos", F.col("l.line").alias("line"), F.col("l.words").alias("words"))


def common_lines(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(source, line, first_doc) of the lines over the limit of their host."""
    per_document = rows.groupBy("source", "line", "sig").agg(F.min("doc_id").alias("first_doc"))
    return per_document.groupBy("source", "line").agg(F.count("*").alias("n_docs"), F.min("first_doc").alias("first_doc")).filter(
        F.col("n_docs") > limits.min_docs).drop("n_docs")


def removals(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row key the lines to remove: _gone (the key), _places (array of line places among word lines), _removed (words in them)."""
    rows = line_rows(docs, limits)
    common = stage(common_lines(rows, limits)).select(
        F.col("source").alias("_s"), F.col("line").alias("_line"), "first_doc")
    hits = rows.join(common, F.col("source").eqNullSafe(F.col("_s")) & (F.col("line") == F.col("_line"))).filter(
        ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    once = hits.groupBy("_row", "pos").agg(F.first("words").alias("words"))
    return once.groupBy(F.col("_row").alias("_gone")).agg(F.collect_set("pos").alias("_places"), F.sum("words").alias("_removed"))


def verdict(measured: DataFrame, limits: Limits) -> DataFrame:
    """Add `n_removed_words` and `kept` to rows with their counts and `_removed`."""
    removed = F.coalesce("_removed", F.lit(0)).cast("long")
    depleted = (F.col("n_words") - removed) < limits.min_left * F.col("n_words")
    return measured.withColumns({"n_removed_words": removed, "kept": ~F.col("base_failed") & ~depleted}).drop("_row", "_gone", "_removed")


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, source and text with the counts, `base_failed`, `n_removed_words`, `kept` and `_places` of the removed lines."""
    keyed = with_row_key(docs.select("doc_id", "source", "text"))
    gone = stage(removals(keyed, limits))
    return verdict(measures(keyed, limits).join(gone, F.col("_row") == F.col("_gone"), "left"), limits)


def without_lines(text: Column, places: Column) -> Column:
    """The text without the word lines at `places`. Word lines are numbered as they come; other lines stay where they are."""
    def step(acc: Column, line: Column) -> Column:
        real = line.rlike(r"[^\x20\x09-\x0D]")
        cut = real & F.array_contains(places, acc["k"])
        return F.struct(
            (acc["k"] + real.cast("int")).alias("k"),
            F.when(cut, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.split(text, "\n", -1), zero, step)["out"], "\n")


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents kept, without the lines over the limit, with the columns of `docs`; n_chars follows the text."""
    docs, unpacked = packed(docs, ("doc_id", "source", "text", "n_chars"))
    keyed = with_row_key(docs)
    gone = stage(removals(keyed, limits))
    affected, whole = parted(keyed, "_row", gone.select("_gone"))

    def judged(rows: DataFrame) -> DataFrame:
        return verdict(measures(rows, limits), limits).filter("kept")

    found = affected.join(gone, F.col("_row") == F.col("_gone"), "left")
    cut = judged(found).withColumn("text", F.when(F.col("_places").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("_places"))))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_places").isNull(), F.col("n_chars")).otherwise(
            F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    left = judged(whole.withColumn("_removed", F.lit(0)))
    return unpacked(cut.select(*docs.columns).union(left.select(*docs.columns)))
