"""Mixing sources to target weights with balanced (cube method) sampling.

Sources in code-point order (null last) weigh 3, 1, 2, 3, ... and share `budget` times all words; a source's target stops at
`most` times its size and the excess goes to the others by weight. A source with target t and size s takes every document
floor(t / s) times, and once more with inclusion probability t / s - floor(t / s). The draw is balanced: documents are dealt
into blocks, and in a block the probabilities of three documents at a time are moved along the null-space of the constraints
(words, documents) until one of them is 0 or 1, so both totals stay as they are. At most two documents of a block are left
undecided; those of all blocks are dealt into blocks again, round by round, until a source has one block. There the flight
stops when `LANDING` documents are left, and the rounding of these that comes nearest to the words aimed at is taken.

A block has about `block` documents whatever the size of its source, and blocks are dealt to tasks one by one, so a source with
most rows is worked by as many tasks as it has blocks (at most `TASKS`). One row per source reaches the driver, and goes out with
the plan, in each round: memory there grows with the number of sources only. Random numbers depend on source, round and block only: reruns agree.

A null text has size 0. Rows alike in doc_id, source and size are taken together and equally often. An empty table gives an
empty result. Columns of the input other than doc_id, source and text are not looked at.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import WORD, body, packed, stage

WEIGHTS = (3, 1, 2)
BUDGET = Fraction(3, 2)
MOST = 2
BLOCK = 1000
LANDING = 10
TASKS = 10_000
NEAR = 1e-9


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, most: int = MOST) -> list[Fraction]:
    """Words to take per source: shares of the budget by weight, none above `most` times the source's size."""
    left, out = budget * sum(sizes), {}
    open_ = list(range(len(sizes)))
    while open_:
        whole = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / whole for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        if not full:
            out |= share
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return [out[i] for i in range(len(sizes))]


def fly(p: np.ndarray, rows: np.ndarray, rng: np.random.Generator, spare: int = 0) -> np.ndarray:
    """Flight phase: `rows` (2 x n) are the balancing totals per unit; returns p with at most two entries off 0 and 1,
    besides the last `spare` ones."""
    p = p.copy()
    p[p <= NEAR], p[p >= 1 - NEAR] = 0.0, 1.0
    todo = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    todo = todo[: len(todo) - spare] if len(todo) > spare else []
    at, held = 0, []
    while True:
        while len(held) < 3 and at < len(todo):
            held.append(todo[at])
            at += 1
        v = null_vector(rows[:, held])
        if v is None:
            break
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf)).min()
            down = np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf)).min()
        q = q + up * v if rng.random() * (up + down) < down else q - down * v
        q = np.where(q < NEAR, 0.0, np.where(q > 1 - NEAR, 1.0, q))
        p[held] = q
        held = [i for i, x in zip(held, q, strict=True) if 0.0 < x < 1.0]
    return p


def null_vector(a: np.ndarray) -> np.ndarray | None:
    """A direction in which both totals of the (at most three) units stay; None if there is none."""
    n = a.shape[1]
    if n == 3:
        v = np.cross(a[0], a[1])
        if np.abs(v).max() > NEAR:
            return v / np.abs(v).max()
    if n >= 2:  # two units with proportional totals
        for i in range(n):
            for j in range(i + 1, n):
                x, y = a[:, i], a[:, j]
                if abs(x[0] * y[1] - x[1] * y[0]) <= NEAR * max(1.0, np.abs(x).max() * np.abs(y).max()):
                    v = np.zeros(n)
                    v[i], v[j] = y.sum(), -x.sum()
                    return v / np.abs(v).max()
    return None


def land(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Round the few undecided units to the corner whose words are nearest to those expected, then whose number is."""
    loose = np.flatnonzero((p > 0.0) & (p < 1.0))
    corners = (np.arange(1 << len(loose))[:, None] >> np.arange(len(loose))) & 1
    off_words = np.abs(corners @ words[loose] - p[loose] @ words[loose])
    off_units = np.abs(corners.sum(axis=1) - p[loose].sum())
    p = p.copy()
    p[loose] = corners[np.lexsort((off_units, off_words))[0]]
    return p


def _block_job(round_no: int):
    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size"], kind="stable")
        rng = np.random.default_rng([round_no, int(pdf["src"].iloc[0]), int(pdf["block"].iloc[0])])
        n, p = pdf["n"].to_numpy(float), pdf["p"].to_numpy(float)
        words = n * pdf["size"].to_numpy(float)
        order = rng.permutation(len(pdf))
        out = np.empty(len(pdf))
        last = bool(pdf["last"].iloc[0])
        out[order] = fly(p[order], np.vstack([words, n])[:, order], rng, LANDING if last else 0)
        if last:
            out = land(out, words)
        return pdf.assign(p=out)[["doc_id", "src", "size", "n", "p"]]

    return job


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(body("text"), F.lit(WORD)).cast("long").alias("size"))


def plan(narrow: DataFrame) -> DataFrame:
    """One row per source: src (its place), source, source_size, target, base copies, p (probability of one copy more), units."""
    spark = narrow.sparkSession
    found = narrow.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.countDistinct(F.coalesce("doc_id", F.lit(-1)), "size").alias("units")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["source_size"] for r in found])
    rows = []
    for i, (r, goal) in enumerate(zip(found, goals, strict=True)):
        ratio = goal / r["source_size"] if r["source_size"] else Fraction(0)
        base = int(ratio)
        rows.append((i, r["source"], r["source_size"], float(goal), base, float(ratio - base), r["units"]))
    return spark.createDataFrame(
        rows, "src int, source string, source_size long, target double, base int, p double, units long")


def draw(units: DataFrame, n_units: DataFrame, block: int = BLOCK) -> DataFrame:
    """The balanced draw: doc_id, src, size and p, which is 0 or 1 for every unit in the end."""
    loose, decided, round_no = units, None, 0
    counts = n_units
    while True:
        found = counts.select("src", "units").collect()  # one row per source, as they were collected for the targets
        blocks = {r["src"]: max(math.ceil(r["units"] / block), 1) for r in found}
        # By value and not by a join, which could deal a source's blocks to one task.
        of_source = F.broadcast(units.sparkSession.createDataFrame(list(blocks.items()), "_s int, blocks int"))
        dealt = loose.join(of_source, F.col("src") == F.col("_s")).withColumns({
            "block": F.pmod(F.xxhash64("doc_id", "size", F.lit(round_no)), "blocks").cast("int"), "last": F.col("blocks") == 1,
        }).drop("_s", "blocks").repartition(max(min(sum(blocks.values()), TASKS), 1), "src", "block")
        flown = stage(dealt.groupBy("src", "block").applyInPandas(
            _block_job(round_no), "doc_id long, src int, size long, n long, p double"))
        decided = flown if decided is None else decided.union(flown)
        decided = decided.filter("p = 0 or p = 1")
        if max(blocks.values(), default=1) == 1:
            return decided
        loose = flown.filter("p > 0 and p < 1")
        counts = loose.groupBy("src").agg(F.count("*").alias("units"))
        round_no += 1


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    narrow = stage(sized(docs))
    sources = plan(narrow)
    same = F.col("source").eqNullSafe(F.col("_source"))
    known = narrow.join(sources.withColumnRenamed("source", "_source"), same).drop("_source")
    units = known.filter("p > 0").groupBy("doc_id", "src", "size").agg(F.count("*").alias("n"), F.first("p").alias("p"))
    drawn = draw(units, sources.filter("p > 0").select("src", "units"), block).select(
        F.col("doc_id").alias("_d"), F.col("src").alias("_s"), F.col("size").alias("_z"), F.col("p").cast("int").alias("extra"))
    chosen = known.join(
        drawn, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("src") == F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    copies = F.col("base") + F.coalesce("extra", F.lit(0))
    return chosen.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents taken, each once, with `size`, `source_size`, `target`, `copies` and `taken` (words, repeats counted); columns
    of the input with these five names are replaced."""
    made = ["size", "source_size", "target", "copies", "taken"]
    decided = stage(mix(docs).filter("copies > 0").groupBy("doc_id", "source", "size").agg(
        *[F.first(c).alias(c) for c in made[1:]]))
    decided = decided.withColumnsRenamed({"doc_id": "_d", "source": "_source", "size": "_z"})
    small, unpacked = packed(docs.drop(*made), ("doc_id", "source", "text"))
    sized_docs = small.withColumn("size", F.regexp_count(body("text"), F.lit(WORD)).cast("long"))
    joined = sized_docs.join(
        decided, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_z")))
    return unpacked(joined, *made)
