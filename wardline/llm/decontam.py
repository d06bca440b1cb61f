"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming look-up, exact weighted-shingle check.

DataFrame expressions only. A window of an item's size is looked at wherever the text holds one of the item's shingles, at
the place that lines the two up: a window that shares no shingle with any item has similarity 0. Equal windows are worked
once. Each window gets a 64-bit SimHash; the fingerprint is cut into `BLOCKS` blocks, and items are indexed under every
value of a block within `FLIPS` flipped bits. Two fingerprints within BLOCKS * (FLIPS + 1) - 1 bits differ in at most
FLIPS bits in one block, so none within that radius is lost. Candidates are checked exactly: shingles are counted with
multiplicity and weigh as much as they have code points; 100 * weight in common >= 80 * weight in either.

Items are told apart by their words (`item`, a hash of them), so that texts under one item_id, or without one, are looked for each
by itself; item_id only names them in the result. Shingles are five words (lower case); an item of fewer words is one shingle. Null and empty texts and items have no words
and match nothing. Repeated documents give one row per (doc_id, item); an empty table gives an empty result; other columns
are not looked at. The items' shingles are broadcast only after they were counted; beyond `BROADCAST_ROWS` the join
shuffles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import body, let, packed, parted, stage, words

SHINGLE = 5
PERCENT = 80
WIDTHS = (13, 13, 13, 13, 12)
BLOCKS = len(WIDTHS)
FLIPS = 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
BROADCAST_ROWS = 1_000_000


def grams(found: Column, size: int | Column) -> Column:
    """Runs of `size` words, joined by a blank; none if there are fewer words."""
    size = F.lit(size) if isinstance(size, int) else size
    runs = F.transform(F.sequence(F.lit(1), F.size(found) - size + 1), lambda i: F.array_join(F.slice(found, i, size), " "))
    return F.when(F.size(found) >= size, runs).otherwise(F.array().cast("array<string>"))


def gram_hashes(found: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, from the hashes of the words."""
    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))

    return F.when(F.size(found) >= size, let(F.transform(found, lambda w: F.xxhash64(w)), runs)).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64 bits; each shingle votes on every bit with its length in code points."""
    votes = F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("h"), F.char_length(s).alias("w")))

    def fold(v: Column) -> Column:
        def bit(b: Column) -> Column:
            total = F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(
                _shift(x["h"], b).bitwiseAND(F.lit(1).cast("bigint")) == 1, x["w"]).otherwise(-x["w"]))
            return F.when(total > 0, _power(b)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return let(votes, fold)


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def _power(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), b)


def blocks(fingerprint: Column) -> Column:
    """(block, value) of the fingerprint's blocks."""
    at, out = 0, []
    for k, width in enumerate(WIDTHS):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        out.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def masks(width: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)]


def probes(fingerprint: Column) -> Column:
    """(block, value) of every block value within FLIPS flipped bits."""
    at, out = 0, []
    for k, width in enumerate(WIDTHS):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        flips = F.expr("array(" + ",".join(f"{m}L" for m in masks(width)) + ")")
        out.append(F.transform(flips, _flip(k, value)))
        at += width
    return F.concat(*out)


def _flip(k: int, value: Column):
    return lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, key of the words, size in words, shingle length, shingles; items without words are left out."""
    w = words(F.lower(body("text")))
    return benchmark.select("item_id", w.alias("w")).filter(F.size("w") > 0).select(
        "item_id", F.xxhash64(F.array_join("w", " ")).alias("item"), F.size("w").alias("size"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w"
    ).withColumn("shingles", grams(F.col("w"), F.col("k"))).drop("w").dropDuplicates(["item_id", "size", "shingles"])


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """(key, shingle, n, weight): how often the shingle is there, and what one weighs."""
    return rows.select(key, F.explode("shingles").alias("shingle")).groupBy(key, "shingle").agg(
        F.count("*").alias("n")).withColumn("weight", F.char_length("shingle").cast("long"))


def anchored_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """_row, start, size, k of the windows that line a shared shingle up with an item."""
    lengths = [r.k for r in items.select("k").distinct().collect()]  # at most SHINGLE values
    w = words(F.lower(body("text")))
    places = items.select("size", "k", F.posexplode("shingles").alias("offset", "s"))
    n_places = places.count()
    hits = None
    for k in sorted(lengths):
        hashed = F.transform(F.split("s", " "), lambda x: F.xxhash64(x))
        anchors = places.filter(F.col("k") == k).select(
            "size", "k", "offset", let(hashed, lambda h: F.xxhash64(*[h[i] for i in range(k)])).alias("_gram")).distinct()
        anchors = F.broadcast(anchors) if n_places <= BROADCAST_ROWS else anchors
        found = docs.select("_row", F.size(w).alias("n"), F.posexplode(gram_hashes(w, k)).alias("pos", "_gram"))
        found = found.join(anchors, "_gram")
        size = F.least("size", "n")
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("n") - size))
        found = found.select("_row", start.alias("start"), size.alias("size"), "k")
        hits = found if hits is None else hits.union(found)
    return hits.distinct() if hits is not None else None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row key, item and window that match: doc_id, _row, item_id, start, size, common and either weight."""
    docs = docs.select("doc_id", "text").withColumn("_row", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text"))
    items = stage(items_of(benchmark))
    windows = anchored_windows(docs, items)
    if windows is None:  # no item has a word
        return docs.limit(0).select("doc_id", "_row", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("size"),
                                    F.lit(0).cast("long").alias("common"), F.lit(0).cast("long").alias("either"))
    windows = stage(windows.groupBy("_row").agg(F.collect_list(F.struct("start", "size", "k")).alias("places")))
    w = words(F.lower(body("text")))
    cut = docs.join(windows.withColumnRenamed("_row", "_key"), F.col("_row") == F.col("_key")).select(
        "doc_id", "_row", w.alias("w"), "places"
    ).select("doc_id", "_row", "w", F.explode("places").alias("p")).select(
        "doc_id", "_row", F.col("p.start").alias("start"), F.col("p.size").alias("size"), F.col("p.k").alias("k"),
        F.slice("w", F.col("p.start") + 1, F.col("p.size")).alias("w"))
    cut = stage(cut.distinct().withColumn("window", F.md5(F.concat_ws(" ", F.col("k").cast("string"), F.array_join("w", " ")))))

    distinct = cut.groupBy("window").agg(F.first("w").alias("w"), F.first("k").alias("k")).withColumn(
        "shingles", grams(F.col("w"), F.least(F.col("k"), F.size("w")))).drop("w")
    prints = stage(distinct.withColumn("print", simhash(F.col("shingles"))))
    texts = items.dropDuplicates(["item"])
    index = texts.withColumn("item_print", simhash(F.col("shingles"))).select(
        "item", F.col("k").alias("item_k"), "item_print", F.explode(probes(F.col("item_print"))).alias("b"))
    looked_up = prints.select("window", "k", "print", F.explode(blocks(F.col("print"))).alias("b"))
    near = looked_up.join(index, "b").filter(
        (F.col("k") == F.col("item_k")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    ).select("window", "item").distinct()

    of_window, of_item = _counted(prints, "window"), _counted(texts, "item")
    totals = lambda rows, key, name: rows.groupBy(key).agg(F.sum(F.col("n") * F.col("weight")).alias(name))
    common = near.join(of_window, "window").join(
        of_item.select("item", "shingle", F.col("n").alias("m")), ["item", "shingle"]
    ).groupBy("window", "item").agg(F.sum(F.least("n", "m") * F.col("weight")).alias("common"))
    same = common.join(totals(of_window, "window", "tw"), "window").join(totals(of_item, "item", "ti"), "item").withColumn(
        "either", F.col("tw") + F.col("ti") - F.col("common")).filter(100 * F.col("common") >= PERCENT * F.col("either"))
    same = same.join(items.select("item", "item_id"), "item").drop("item")
    return cut.drop("w").join(same, "window").select("doc_id", "_row", "item_id", "start", "size", "common", "either")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: the best window (the first of equals) and its weights."""
    best = F.max_by(F.struct("start", "size", "common", "either"), F.struct(F.col("common") / F.col("either"), -F.col("start")))
    return contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.size").alias("size"),
        F.col("b.common").alias("common_weight"), F.col("b.either").alias("either_weight"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item. Only texts that a bitmap of fixed size takes for such as hold one can be shuffled."""
    rows = stage(contaminated(docs, benchmark).select("_row").distinct())
    small, unpacked = packed(docs, ("doc_id", "text"))
    keyed = small.withColumn("_key", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text"))
    maybe, clear = parted(keyed, "_key", rows)
    return unpacked(maybe.join(rows, F.col("_key") == F.col("_row"), "left_anti").union(clear))
