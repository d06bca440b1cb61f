"""How filters act on one another, from sorted posting lists of the documents that each of them fails.

The table is dealt by id ranges. Of each range and part a task holds, per filter, the sorted ids that fail it, and those of good and of
toxic documents. `merged` unites up to five such lists and takes others away: it goes forward in ranges of ids, in every
list by galloping (steps that double from the last place, then a binary search), so that a range that only one list has is
copied as a whole. For each set of filters the size of the union is what fails any of them; for each filter and set of
earlier ones the difference is what the filter removes after them. Those sizes (all, good, toxic) are summed over the
ranges; every one of the orders is read off the sums.

A task works on batches of at most `BATCH` rows, whatever the range holds. Lists hold row numbers in id order, so rows that
share a doc_id count each. Whether a text is that of a smaller doc_id is decided by the least doc_id per text (md5), joined
back by doc_id and text, so a group of copies is spread like any other rows.

A null text is empty, a null lang is the part ''. A null doc_id is no smaller id, has none and no label. Repeated rows of one
doc_id are no copies of each other (no id is smaller) and count each. A doc_id with several labels is good (toxic) if any row says so.
An empty table gives no parts. Columns other than doc_id, text and lang (doc_id, quality and toxic of labels) are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import body, let, stage, words

FILTERS = "ABCDE"
STRIDE = 512
BATCH = 65_536
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT = 200, 50, 3
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ALL = (1 << len(FILTERS)) - 1
SIZES = "part string, minus int, filter int, n long, good long, toxic long"
UNION = -1


def gallop(ids: np.ndarray, at: int, bound: int) -> int:
    """The first place from `at` on whose id is not under `bound`."""
    step, low, n = 1, at, len(ids)
    while at < n and ids[at] < bound:
        low = at + 1
        at += step
        step *= 2
    return bisect_left(ids, bound, low, min(at, n))


def merged(lists: list[np.ndarray], minus: list[np.ndarray] = [], stride: int = STRIDE) -> np.ndarray:  # noqa: B006
    """Sorted ids in any of `lists` and in none of `minus`. All lists are sorted and without repeats."""
    places, away = [0] * len(lists), [0] * len(minus)
    out = []
    while True:
        ends = [int(ids[min(at + stride, len(ids)) - 1]) for ids, at in zip(lists, places, strict=True) if at < len(ids)]
        if not ends:
            return np.concatenate(out) if out else np.empty(0, np.int64)
        bound = min(ends) + 1
        runs = _cut(lists, places, bound)
        run = runs[0] if len(runs) == 1 else np.unique(np.concatenate(runs))
        for gone in _cut(minus, away, bound):
            if len(run) and gone[-1] >= run[0]:
                run = run[gone[np.minimum(np.searchsorted(gone, run), len(gone) - 1)] != run]
        out.append(run)


def _cut(lists: list[np.ndarray], places: list[int], bound: int) -> list[np.ndarray]:
    """What each list has before `bound`; the places go on to it."""
    runs = []
    for k, ids in enumerate(lists):
        end = gallop(ids, places[k], bound)
        if end > places[k]:
            runs.append(ids[places[k]:end])
        places[k] = end
    return runs


def _members(mask: int) -> list[int]:
    return [k for k in range(len(FILTERS)) if mask >> k & 1]


def sizes(fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(minus, filter, n, good, toxic) of rows in id order: for UNION in `minus`, what fails any filter of the set `filter` (all rows
    for the empty set); else what fails `filter` and none of the set `minus`."""
    posting = [np.flatnonzero(fails >> k & 1) for k in range(len(FILTERS))]
    marked = [np.flatnonzero(good), np.flatnonzero(toxic)]

    def counted(ids: np.ndarray) -> tuple[int, int, int]:
        return len(ids), *(len(ids) - len(merged([ids], [m])) for m in marked)  # type: ignore[return-value]

    out = [(UNION, 0, len(fails), len(marked[0]), len(marked[1]))]
    unions = {mask: merged([posting[k] for k in _members(mask)]) for mask in range(1, ALL + 1)}
    out += [(UNION, mask, *counted(ids)) for mask, ids in unions.items()]
    for k in range(len(FILTERS)):
        for mask in range(ALL + 1):
            if not mask >> k & 1:
                out.append((mask, k, *counted(merged([posting[k]], [posting[j] for j in _members(mask)]))))
    return out


def range_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes per part of each batch of at most BATCH rows (or one batch of Spark's); rows come by part and id."""
    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        part = table.column("part").combine_chunks().dictionary_encode()
        code = part.indices.to_numpy(zero_copy_only=False)
        fails, good, toxic = (table.column(c).to_numpy() for c in ("fails", "good", "toxic"))
        rows = []
        for p, name in enumerate(part.dictionary.to_pylist()):
            mine = code == p
            rows += [(name, *r) for r in sizes(fails[mine], good[mine], toxic[mine])]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "minus", "filter", "n", "good", "toxic"])

    held, n = [], 0
    for batch in batches:
        if held and n + batch.num_rows > BATCH:
            yield work(held)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield work(held)


def failing(text: Column) -> Column:
    """Bits of the filters A to D that the text fails."""
    def by_words(w: Column) -> Column:
        few = F.size(w) < MIN_WORDS
        same = 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PCT * F.size(w)
        return few.cast("int") + 2 * same.cast("int")

    n = F.char_length(text)
    capitals = n - F.char_length(F.translate(text, CAPITALS, ""))
    return let(words(text), by_words) + 4 * (100 * capitals > MAX_CAPITAL_PCT * n).cast("int") + 8 * text.rlike(r"[#$%&*|]").cast("int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits), good, toxic and a number of its own of every document, written."""
    text = body("text")
    narrow = stage(docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("md5"), failing(text).alias("fails"),
        F.monotonically_increasing_id().alias("row")))
    known = narrow.filter("doc_id is not null")
    firsts = known.groupBy("md5").agg(F.min("doc_id").alias("_first")).withColumnRenamed("md5", "_md5")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = known.join(
        firsts, (F.col("doc_id") == F.col("_first")) & (F.col("md5") == F.col("_md5")), "left"
    ).join(marks, F.col("doc_id") == F.col("_labelled"), "left")
    copied = F.when(F.col("_first").isNull(), 16).otherwise(0)
    bit = lambda c: F.coalesce(c, F.lit(0))
    return stage(marked.select("doc_id", "part", (F.col("fails") + copied).alias("fails"), bit("good").alias("good"), bit("toxic").alias("toxic"), "row").union(
        narrow.filter("doc_id is null").select("doc_id", "part", "fails", F.lit(0), F.lit(0), "row")))


def key_of(minus: Column | int, filter_: Column | int) -> Column:
    at = lambda x: F.lit(x) if isinstance(x, int) else x
    return (at(minus) + 1) * (ALL + 1) + at(filter_)


def steps() -> Column:
    """(order, step, set of the filters before it, filter) of every step of every order, as a literal array."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            name = "".join(FILTERS[j] for j in order)
            out.append(f"struct('{name}' AS name, {step} AS step, {before} AS before, {k} AS k)")
            before |= 1 << k
    return F.expr(f"array({', '.join(out)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    ranged = judged(docs, labels).repartitionByRange("doc_id", "row").sortWithinPartitions("part", "doc_id", "row")
    summed = ranged.select("part", "fails", "good", "toxic").mapInArrow(range_sizes, SIZES).groupBy("part", "minus", "filter").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    others = len(FILTERS) - 1
    before = F.bit_count("minus")  # so many filters stand before one in |before|! * |the rest|! of the orders
    weight = F.element_at(F.array(*[F.lit(factorial(n) * factorial(others - n)) for n in range(others + 1)]), before + 1)
    mine = lambda k: (F.col("minus") != UNION) & (F.col("filter") == k)
    per_part = summed.groupBy("part").agg(
        F.map_from_entries(F.collect_list(  # as many entries as there are sets, twice
            F.struct(key_of(F.col("minus"), F.col("filter")), F.struct("n", "good", "toxic")))).alias("size"),
        F.array(*[F.sum(F.when(mine(k), F.col("n") * weight).otherwise(0)) for k in range(len(FILTERS))]).alias("shapley"))
    each = per_part.select("part", "size", "shapley", F.explode(steps()).alias("at"))
    before, k = F.col("at.before"), F.col("at.k")
    alone = F.element_at(F.array(*[F.lit(1 << j) for j in range(len(FILTERS))]), k + 1)
    of = lambda minus, which: F.element_at("size", key_of(minus, which))
    removed = of(before, k)
    return each.select(
        "part", F.col("at.name").alias("filter_order"), F.col("at.step").alias("step"),
        (of(UNION, F.lit(0))["n"] - of(UNION, before.bitwiseOR(alone))["n"]).alias("kept"),
        removed["n"].alias("removed"),
        (of(UNION, alone)["n"] - removed["n"]).alias("redundant"),
        of(F.lit(ALL) - alone, k)["n"].alias("unique_fails"),
        removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"),
        F.get("shapley", k).alias("shapley"),
    )
