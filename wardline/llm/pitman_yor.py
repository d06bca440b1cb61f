"""Language-model scores from a hierarchical Pitman-Yor model.

A token's context is the word before it in its text; that of the first word is the text's start. Every context has a
restaurant whose dishes are words; all of them share the restaurant of words without context as parent, whose base is
uniform over the training words and one unknown word. A table in a context restaurant is a customer of the parent.
Gibbs sweeps take out the customers of each dish and seat them anew by the Chinese-restaurant chances, given the tables
and totals of the sweep before; predictive probabilities are averaged over the sweeps after the first. A text's score is the
sum of their logarithms. A context that no training text has leaves its words to the parent.

(context, word) pairs are counted in the task and grouped by Spark, one row per pair. A pair seen once sits at its one table
in every sweep, so only the others are joined with the totals of their context and of their word and seated; totals by
context and by word are tables of their own and only sums over all of them reach the driver. Pairs of two of the
FREQUENT most frequent words, a fixed bound, look the totals up in the task; the pairs of other words are joined by a shuffle.

When texts are scored, the FREQUENT most frequent pairs are looked up in the task. A pair met once in all texts is no row of any
join if both its words are among the FREQUENT most frequent: the totals of the two words and whether its text trains give its
probability. So the task scores every other token of two frequent words as if its pair were met once there, and a join on the
pair puts right those met more often and adds the tokens of rare words. Once all pairs are counted, only these are kept.

`score_few` is the model of one row per word with only the CONTEXTS most frequent words as contexts (a token's is the latest of
them before it). No query uses it.

Random numbers depend on word, context and sweep only, so reruns agree. A null text is empty: its only token is the end. A
null doc_id trains. Repeated rows count and are scored each for itself. Without training text every token has the uniform
probability 1. Other columns are not looked at. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.ngrams import END, spread, with_ends, word_hashes
from wardline.llm.text import discard, release, stage

CONTEXTS = 16
BITS = 5  # of a key that hold the context
FREQUENT = 1 << 18
SWEEPS = 3
STRENGTH = 1.0
EXACT_SEATS = 64
TOKENS = 3_000_000
PAIR_TOKENS = 2_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def uniform(key: np.ndarray, sweep: int, turn: int) -> np.ndarray:
    """Random numbers in (0, 1) that depend on the arguments only."""
    x = spread(spread(key.astype(np.uint64) + np.uint64((sweep * 0x9E3779B97F4A7C15 + 1) % 2**64)) + np.uint64(turn))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def tables(c: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables at which the c customers of each dish sit after they came in one by one: a customer opens a table with
    weight `weight` against c - discount * t for those there. Beyond EXACT_SEATS customers the further tables are drawn
    at once from the Poisson law to whose mean the single chances add up."""
    t = np.minimum(c, 1).astype(np.float64)
    for n in range(1, EXACT_SEATS):
        at = np.flatnonzero(c > n)
        if not len(at):
            return t
        a = weight[at]
        t[at] += uniform(key[at], sweep, n) < a / (a + n - discount * t[at])
    at = np.flatnonzero(c > EXACT_SEATS)
    if len(at):
        a = weight[at]
        mean = a * np.log((c[at] + a) / (EXACT_SEATS + a))
        u, v = uniform(key[at], sweep, EXACT_SEATS), uniform(key[at], sweep, EXACT_SEATS + 1)
        more = np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
        few = np.flatnonzero(mean < 20)
        p = cum = np.exp(-mean[few])
        low = np.zeros(len(few))
        for k in range(1, 80):
            low += u[few] > cum
            p = p * mean[few] / k
            cum = cum + p
        more[few] = low
        t[at] += np.clip(more, 0, c[at] - t[at])
    return t


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1.0), 0.05, 0.95))


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in sorted `keys`, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def token_ids(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word ids of all tokens, tokens per text) for each slice of a column; every text is closed by the end."""
    for first, h, counts in word_hashes(texts):
        yield first, with_ends(h, counts) >> np.uint64(BITS), counts + 1


def with_context(ids: np.ndarray, lengths: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Keys: word id and, in the low bits, the context: 1 + place in `contexts` (sorted ids), 0 for none."""
    at, there = find(contexts, ids)
    place = np.arange(len(ids))
    latest = np.maximum.accumulate(np.where(there, place, -1))
    latest = np.concatenate([[-1], latest[:-1]])
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = latest >= first
    context = np.where(inside, at[np.maximum(latest, 0)] + 1, 0)
    return (ids << np.uint64(BITS)) | context.astype(np.uint64)


def frequent_words(docs: DataFrame, number: int = CONTEXTS) -> np.ndarray:
    """Ids of the most frequent training words, from the thousand most frequent ones of every task."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = np.empty(0, np.uint64), np.empty(0)
        for batch in batches:
            for _, new, _ in token_ids(batch.column("text")):
                new, new_n = np.unique(new, return_counts=True)
                ids, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n, new_n]), minlength=len(ids))
                if len(ids) > TOKENS // 4:  # the rare ones are of no use here
                    keep = n > np.median(n)
                    ids, n = ids[keep], n[keep]
        top = np.argsort(-n, kind="stable")[:1000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[top].view(np.int64)), pa.array(n[top].astype(np.int64))], names=["id", "n"])

    rows = docs.filter(~held_out()).select("text").mapInArrow(job, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "id").limit(number).collect()
    return np.sort(np.array([r["id"] for r in top], np.int64).view(np.uint64))


def word_counts(docs: DataFrame, contexts: np.ndarray) -> DataFrame:
    """One row per word: id, c and total (count in training texts and in all), us and cs (contexts and training counts in them)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            u, at = np.unique(keys, return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([w for _, w in held]).astype(np.float64), minlength=len(u))
            total = np.bincount(at, minlength=len(u))
            return pa.RecordBatch.from_arrays([
                pa.array((u >> np.uint64(BITS)).view(np.int64)), pa.array((u & np.uint64((1 << BITS) - 1)).astype(np.int32)),
                pa.array(c.astype(np.int64)), pa.array(total.astype(np.int64))], names=["id", "u", "c", "total"])

        for batch in batches:
            trains = ~batch.column("held").to_numpy(zero_copy_only=False)
            for first, ids, lengths in token_ids(batch.column("text")):
                held.append((with_context(ids, lengths, contexts), np.repeat(trains[first : first + len(lengths)], lengths)))
                size += len(ids)
                if size >= TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select("text", held_out().alias("held")).mapInArrow(job, "id long, u int, c long, total long")
    pairs = rows.repartition("id").groupBy("id", "u").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))
    seen = F.filter(F.collect_list(F.struct("u", "c", "total")), lambda x: x["total"] > 0)
    words = pairs.groupBy("id").agg(F.sum("c").alias("c"), F.sum("total").alias("total"), F.array_sort(seen).alias("p"))
    return words.select("id", "c", "total", F.col("p.u").alias("us"), F.col("p.c").alias("cs"), F.col("p.total").alias("totals"))


class State:
    """Totals of the restaurants after a sweep. Arrays are by context; `parent_*` are those of the restaurant without context."""

    def __init__(self, n, tables_of, parent_n, parent_tables, words):
        self.n, self.tables_of, self.parent_n, self.parent_tables, self.words = n, tables_of, parent_n, parent_tables, words

    def backoff(self, discount: float) -> np.ndarray:
        return (STRENGTH + discount * self.tables_of) / (self.n + STRENGTH)

    def parent_probability(self, customers: np.ndarray, seated: np.ndarray, discount: float) -> np.ndarray:
        base = 1.0 / (self.words + 1)
        return (customers - discount * seated + (STRENGTH + discount * self.parent_tables) * base) / (self.parent_n + STRENGTH)


def _columns(batch: pa.RecordBatch) -> tuple:
    """ids, owner (place of the word) of every (word, context), contexts, counts."""
    ids = batch.column("id").to_numpy().view(np.uint64)
    us, cs = batch.column("us"), batch.column("cs")
    lengths = np.diff(us.offsets.to_numpy())
    return ids, np.repeat(np.arange(len(ids)), lengths), us.flatten().to_numpy().astype(np.int64), cs.flatten().to_numpy().astype(float)


def _seat(ids, owner, us, cs, discounts: tuple[float, float], states: list, upto: int) -> Iterator[tuple]:
    """Seatings of the sweeps 0..upto, one after the other: (tables per (word, context), customers and tables of the parent)."""
    t = np.minimum(cs, 1.0)
    customers = np.bincount(owner, weights=t, minlength=len(ids))
    seated = np.minimum(customers, 1.0)
    yield t, customers, seated
    keys = (ids[owner] << np.uint64(BITS)) | us.astype(np.uint64)
    for sweep in range(1, upto + 1):
        s = states[sweep - 1]
        parent = s.parent_probability(customers, seated, discounts[1])
        t = tables(cs, (STRENGTH + discounts[0] * s.tables_of[us]) * parent[owner], discounts[0], keys, 2 * sweep)
        customers = np.bincount(owner, weights=t, minlength=len(ids))
        base = np.full(len(ids), (STRENGTH + discounts[1] * s.parent_tables) / (s.words + 1))
        seated = tables(customers, base, discounts[1], ids, 2 * sweep + 1)
        yield t, customers, seated


def fit(words: DataFrame, sweeps: int = SWEEPS) -> tuple[list[State], tuple[float, float], dict]:
    """The states after every sweep (the first seats every dish at one table), the discounts, and the totals of training."""
    one = F.lit(1.0)
    n_in = F.size(F.filter("cs", lambda c: c > 0))
    s = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"),
        F.sum(F.size(F.filter("cs", lambda c: c == 1)) * one).alias("ones"), F.sum(F.size(F.filter("cs", lambda c: c == 2)) * one).alias("twos"),
        F.count_if(n_in == 1).alias("in_one"), F.count_if(n_in == 2).alias("in_two")).first().asDict()
    discounts = discount_of(s["ones"] or 0, s["twos"] or 0), discount_of(s["in_one"], s["in_two"])
    states: list[State] = []
    for sweep in range(sweeps):
        known = list(states)

        def job(batches: Iterator[pa.RecordBatch], known=known, sweep=sweep) -> Iterator[pa.RecordBatch]:
            n, t_of, parent = np.zeros(CONTEXTS + 1), np.zeros(CONTEXTS + 1), np.zeros(2)
            for batch in batches:
                ids, owner, us, cs = _columns(batch)
                for t, customers, seated in _seat(ids, owner, us, cs, discounts, known, sweep):
                    pass
                n += np.bincount(us, weights=cs, minlength=CONTEXTS + 1)
                t_of += np.bincount(us, weights=t, minlength=CONTEXTS + 1)
                parent += [customers.sum(), seated.sum()]
            values = np.concatenate([n, t_of, parent])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["k", "v"])

        rows = words.select("id", "us", "cs").mapInArrow(job, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(2 * CONTEXTS + 4)
        for r in rows:
            v[r["k"]] = r["v"]
        k = CONTEXTS + 1
        states.append(State(v[:k], v[k : 2 * k], v[-2], v[-1], s["v"]))
    return states, discounts, s


def probabilities(words: DataFrame, states: list[State], discounts: tuple[float, float]) -> DataFrame:
    """id, c, total, us, totals, lps (log10 probability in each context it was met in), ps (its parent probability after
    each of the sweeps averaged over)."""
    last = len(states) - 1
    first = min(1, last)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owner, us, cs = _columns(batch)
            p, ps = np.zeros(len(us)), []
            for sweep, (t, customers, seated) in enumerate(_seat(ids, owner, us, cs, discounts, states, last)):
                if sweep < first:
                    continue
                s = states[sweep]
                parent = s.parent_probability(customers, seated, discounts[1])
                ps.append(parent)
                own = (cs - discounts[0] * t) / (s.n[us] + STRENGTH)
                p += own + s.backoff(discounts[0])[us] * parent[owner]
            lp = np.log10(p / len(ps))
            offsets = batch.column("us").offsets
            offsets = pa.array(offsets.to_numpy() - offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k) for k in ("id", "c", "total", "us", "totals")], pa.ListArray.from_arrays(offsets, pa.array(lp)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(ps), pa.int32()), pa.array(np.stack(ps, axis=1).ravel())),
            ], names=["id", "c", "total", "us", "totals", "lps", "ps"])

    return words.mapInArrow(
        job, "id long, c long, total long, us array<int>, totals array<long>, lps array<double>, ps array<double>")


def at_least(df: DataFrame, count: str, bound: int) -> int:
    """The least count such that at most `bound` rows have it or more."""
    histogram = df.groupBy(count).agg(F.count("*").alias("rows")).orderBy(F.desc(count))
    rows, least = 0, None
    for r in histogram.toLocalIterator():
        rows += r["rows"]
        if rows > bound:
            break
        least = r[count]
    return least if least is not None else 2**62


def score_few(docs: DataFrame, sweeps: int = SWEEPS, frequent: int = FREQUENT) -> DataFrame:
    """`score` with the CONTEXTS most frequent words as the only contexts."""
    spark = docs.sparkSession
    contexts = frequent_words(docs)
    counts = stage(word_counts(docs, contexts))
    states, discounts, totals = fit(counts, sweeps)
    n, v = totals["n"], totals["v"]
    words = stage(probabilities(counts, states, discounts))

    pairs = words.select("id", "c", F.explode(F.arrays_zip("us", "totals", "lps")).alias("x")).select(
        "id", "c", F.col("x.us").alias("u"), F.col("x.totals").alias("times"), F.col("x.lps").alias("lp"))
    least = at_least(pairs, "times", frequent)
    often = pairs.filter(F.col("times") >= least).select(
        F.shiftleft("id", BITS).bitwiseOR(F.col("u").cast("long")).alias("key"), "c", "lp").toPandas()
    keys = often["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    lookup = spark.sparkContext.broadcast((
        keys[order], np.log10((often["c"].to_numpy(float) + 1) / (n + v + 1))[order], often["lp"].to_numpy(float)[order],
        often["c"].to_numpy(np.int64)[order] > 0))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, lp, known = lookup.value
        row = TaskContext.get().partitionId() << 40
        for batch, first, ids, lengths in ((b, *t) for b in batches for t in token_ids(b.column("text"))):
            flat = with_context(ids, lengths, contexts)
            docs_here = len(lengths)
            owner = np.repeat(np.arange(docs_here), lengths)
            at, there = find(keys, flat)
            own, at = owner[there], at[there]
            add = lambda x: np.bincount(own, weights=x[at], minlength=docs_here) if len(x) else np.zeros(docs_here)
            rows = row + np.arange(docs_here)
            row += docs_here
            far = np.flatnonzero(~there)
            by = np.lexsort((flat[far], owner[far]))
            far_owner, far_key = owner[far][by], flat[far][by]
            new = np.ones(len(by), bool)
            new[1:] = (far_owner[1:] != far_owner[:-1]) | (far_key[1:] != far_key[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(by)))
            far_owner, far_key = far_owner[starts], far_key[starts]
            none = np.zeros(len(times))
            join = lambda a, b, kind: pa.array(np.concatenate([a, b]).astype(kind))
            yield pa.RecordBatch.from_arrays([
                join(rows, rows[far_owner], np.int64),
                join(rows, (far_key >> np.uint64(BITS)).view(np.int64), np.int64),
                join(np.zeros(docs_here), far_key & np.uint64((1 << BITS) - 1), np.int32),
                join(np.zeros(docs_here), times, np.int64),
                pa.chunked_array([batch.column("doc_id").slice(first, docs_here).cast(pa.int64()), pa.nulls(len(times), pa.int64())]).combine_chunks(),
                join(lengths, none, np.int64), join(add(known), none, np.int64),
                join(add(base), none, np.float64), join(add(lp), none, np.float64),
            ], names=["row", "id", "u", "times", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    parts = docs.select("doc_id", "text").mapInArrow(
        job, "row long, id long, u int, times long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    # The row of a whole document (times 0) carries its own number as word, so that these spread evenly; it takes nothing from the join.
    rare_words = words.filter(F.exists("totals", lambda x: x < least)).select("id", "c", "us", "lps", "ps")
    joined = parts.join(rare_words, "id", "left")
    averaged = states[min(1, len(states) - 1):]
    backoffs = [F.array(*[F.lit(float(x)) for x in s.backoff(discounts[0])]) for s in averaged]
    unknown = [float(s.parent_probability(np.zeros(1), np.zeros(1), discounts[1])[0]) for s in averaged]
    parents = [F.coalesce(F.get("ps", F.lit(k)), F.lit(p)) for k, p in enumerate(unknown)]
    elsewhere = sum((F.get(b, F.col("u")) * p for b, p in zip(backoffs, parents, strict=True)), F.lit(0.0)) / len(averaged)
    met = F.get("lps", (F.array_position("us", F.col("u")) - 1).cast("int"))
    rare = F.col("times") > 0
    base_of = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare, F.when(F.col("c") > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("times") * base_of).otherwise(F.col("base_score"))).alias("base_score"),
        F.sum(F.when(rare, F.col("times") * F.coalesce(met, F.log10(elsewhere))).otherwise(F.col("score"))).alias("score"),
    )
    return summed.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def previous(ids: np.ndarray) -> np.ndarray:
    """The token before each; texts are closed by END, so a first token has END before it."""
    return np.concatenate([[END], ids[:-1]]).astype(np.uint64)


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return spread(spread(u) + w)


def pair_counts(docs: DataFrame) -> DataFrame:
    """One row per (context, word): u, w, c and total (count in training texts and in all)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([k for k, _ in held])
            before = previous(ids)
            _, first, at = np.unique(pair_keys(before, ids), return_index=True, return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([w for _, w in held]), minlength=len(first))
            total = np.bincount(at, minlength=len(first))
            by = np.lexsort((ids[first], before[first]))  # rows next to each other share their context: less to write
            return pa.RecordBatch.from_arrays([
                pa.array(before[first][by].view(np.int64)), pa.array(ids[first][by].view(np.int64)),
                pa.array(c[by].astype(np.int64)), pa.array(total[by].astype(np.int64))], names=["u", "w", "c", "total"])

        for batch in batches:
            trains = ~batch.column("held").to_numpy(zero_copy_only=False)
            for first, h, counts in word_hashes(batch.column("text")):
                held.append((with_ends(h, counts), np.repeat(trains[first : first + len(counts)], counts + 1)))
                size += len(held[-1][0])
                if size >= PAIR_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select("text", held_out().alias("held")).mapInArrow(job, "u long, w long, c long, total long")
    # A task's pairs are nearly all distinct by now: they are dealt out as they are, finely, so that no task sums up many at once.
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "u", "w").groupBy("u", "w").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


class Restaurants:
    """Seatings of all sweeps. contexts: u, n (customers), t0, t1, ... (tables after each sweep). words: w, c, n0, n1, ...
    (customers of the parent) and s0, s1, ... (its tables). pairs: u, w, c, total, t1, ... . parent: totals of n and s of each sweep.
    If pairs are `joined_pairs` only, least is the training count from which a word is frequent; as a context it has as many customers."""

    least: int | None = None

    def __init__(self, contexts, words, pairs, parent, discounts, n, v):
        self.contexts, self.words, self.pairs, self.parent = contexts, words, pairs, parent
        self.discounts, self.n, self.v = discounts, n, v

    def parent_probability(self, sweep: int, customers: Column, seated: Column) -> Column:
        n, t = self.parent[sweep]
        base = (STRENGTH + self.discounts[1] * t) / (self.v + 1)
        return (customers - F.lit(self.discounts[1]) * seated + F.lit(base)) / F.lit(n + STRENGTH)


def _seat_pairs(rows: DataFrame, sweep: int, discount: float) -> DataFrame:
    """`rows` with t of this sweep in place of `weight`."""
    out = [f for f in rows.schema.fields if f.name != "weight"]
    name = f"t{sweep}"

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, c, weight = (batch.column(k).to_numpy() for k in ("u", "w", "c", "weight"))
            t = tables(c.astype(float), weight, discount, pair_keys(u.view(np.uint64), w.view(np.uint64)), 2 * sweep)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in out], pa.array(t.astype(np.int64))], names=[*[f.name for f in out], name])

    return rows.mapInArrow(job, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + f", {name} long")


def _seat_words(rows: DataFrame, sweep: int, weight: float, discount: float) -> DataFrame:
    """`rows` with the parent's tables s of this sweep, from its customers n."""
    names = rows.columns

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(f"n{sweep}").to_numpy().astype(float)
            s = tables(n, np.full(len(n), weight), discount, batch.column("w").to_numpy().view(np.uint64), 2 * sweep + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.int64))], names=[*names, f"s{sweep}"])

    return rows.mapInArrow(job, ", ".join(f"{k} long" for k in [*names, f"s{sweep}"]))


def known_totals(contexts: DataFrame, words: DataFrame, least: int) -> dict[str, np.ndarray]:
    """Columns of `contexts` (u, n, ...) and `words` (w, wc, ...) by name, for the frequent words only; u is sorted. A word's n as a
    context is its training count, so wc is left out."""
    often = contexts.filter(F.col("n") >= least).join(words.filter(F.col("wc") >= least), F.col("u") == F.col("w")).drop("w", "wc").toArrow()
    columns = {k: often[k].to_numpy() for k in often.column_names}
    columns["u"] = columns["u"].view(np.uint64)
    order = np.argsort(columns["u"])
    return {k: x[order] for k, x in columns.items()}


def joined_pairs(pairs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """`pairs` without those that are met once and have two frequent words (training count of `least` or more), and `rare`: whether
    one of the two words is not frequent."""
    often = words.filter(F.col("c") >= least).select("w").toArrow()["w"].to_numpy()
    lookup = pairs.sparkSession.sparkContext.broadcast(np.sort(often.view(np.uint64)))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (_, u), (_, w) = (find(lookup.value, batch.column(k).to_numpy().view(np.uint64)) for k in ("u", "w"))
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(~(u & w))], names=[*batch.schema.names, "rare"])
            yield rows.filter(pa.array((batch.column("total").to_numpy() > 1) | ~(u & w)))

    return pairs.mapInArrow(job, "u long, w long, c long, total long, rare boolean")


def with_totals(rows: DataFrame, contexts: DataFrame, words: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """`rows` with the columns of `contexts` (u, n, ...) and `words` (w, wc, ...). With the totals of frequent words in `known`, rows
    of two such words (`joined_pairs` says which) look them up in the task."""
    if known is None:
        return rows.join(contexts, "u").join(words, "w")
    sides = [("u", [f for f in contexts.schema.fields if f.name != "u"]), ("w", [f for f in words.schema.fields if f.name != "w"])]
    names = [*rows.columns, *[f.name for _, fields in sides for f in fields]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*rows.schema.fields, *[f for _, fields in sides for f in fields]])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [*batch.columns]
            for key, fields in sides:
                at, _ = find(known.value["u"], batch.column(key).to_numpy().view(np.uint64))
                found += [pa.array(known.value[f.name if f.name in known.value else "n"][at]) for f in fields]
            yield pa.RecordBatch.from_arrays(found, names=names)

    seldom = rows.filter("rare").join(contexts, "u").join(words, "w").select(*names)
    return rows.filter("NOT rare").mapInArrow(job, schema).union(seldom)


def seat(pairs: DataFrame, sweeps: int = SWEEPS, frequent: int | None = None) -> Restaurants:
    """Seat the pairs; the first sweep puts every dish at one table. With `frequent`, at most so many words are frequent; only
    their `joined_pairs` are kept after the totals are taken, and the staged table `pairs` is deleted."""
    spark = pairs.sparkSession
    once = [F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") > 0).alias("t0")]
    contexts = stage(pairs.groupBy("u").agg(*once))
    words = stage(pairs.groupBy("w").agg(F.sum("c").alias("c"), once[1], once[2].alias("n0")).withColumn("s0", F.least("n0", F.lit(1))))
    release(spark)
    p = pairs.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    w = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("n0") == 1), F.count_if(F.col("n0") == 2),
        F.coalesce(F.sum("n0"), F.lit(0))).first()
    all_ = Restaurants(contexts, words, None, [(float(w[4]), float(w[1]))], (discount_of(p[0], p[1]), discount_of(w[2], w[3])), w[0], w[1])
    if frequent is not None:
        all_.least = at_least(words, "c", frequent)
        whole, pairs = pairs, stage(joined_pairs(pairs, words, all_.least))
        discard(whole)
    d = all_.discounts
    seated = pairs.filter("c > 1")
    for sweep in range(1, sweeps):
        k = sweep - 1
        of_context = all_.contexts.select("u", "n", (F.lit(STRENGTH) + F.lit(d[0]) * F.col(f"t{k}")).alias("open"))
        of_word = all_.words.select("w", F.col("c").alias("wc"), all_.parent_probability(k, F.col(f"n{k}"), F.col(f"s{k}")).alias("p"))
        weighed = with_totals(seated, of_context, of_word).select(*seated.columns, (F.col("open") * F.col("p")).alias("weight"))
        before, seated = seated, stage(_seat_pairs(weighed, sweep, d[0]))

        def totals(side: DataFrame, key: str, name: str, seated: DataFrame = seated, t: str = f"t{sweep}") -> DataFrame:
            sums = seated.groupBy(key).agg(F.sum(t).alias("_t")).withColumnRenamed(key, "_k")
            joined = side.join(sums, F.col(key) == F.col("_k"), "left")
            return joined.select(*side.columns, (F.col("one") + F.coalesce("_t", F.lit(0))).alias(name))

        old = [all_.contexts, all_.words, *([before] if sweep > 1 else [])]
        all_.contexts = stage(totals(all_.contexts, "u", f"t{sweep}"))
        base = (STRENGTH + d[1] * all_.parent[k][1]) / (all_.v + 1)
        all_.words = stage(_seat_words(totals(all_.words, "w", f"n{sweep}"), sweep, base, d[1]))
        sums = all_.words.agg(F.coalesce(F.sum(f"n{sweep}"), F.lit(0)), F.coalesce(F.sum(f"s{sweep}"), F.lit(0))).first()
        all_.parent.append((float(sums[0]), float(sums[1])))
        discard(*old)
        release(spark)
    ones = pairs.filter("c <= 1").select(*pairs.columns, *[F.col("c").alias(f"t{k}") for k in range(1, sweeps)])
    all_.pairs = ones.unionByName(seated)
    return all_


def _used(of: Restaurants) -> range:
    """The sweeps averaged over."""
    last = len(of.parent) - 1
    return range(min(1, last), last + 1)


def totals_used(of: Restaurants) -> tuple[DataFrame, DataFrame]:
    """(u, n, o1, ...: the weight of what lies above the context), (w, wc, p1, ...: the word's probability there), by sweep."""
    opens = [(F.lit(STRENGTH) + F.lit(of.discounts[0]) * F.col(f"t{k}")).alias(f"o{k}") for k in _used(of)]
    above = [of.parent_probability(k, F.col(f"n{k}"), F.col(f"s{k}")).alias(f"p{k}") for k in _used(of)]
    return of.contexts.select("u", "n", *opens), of.words.select("w", F.col("c").alias("wc"), *above)


def pair_probabilities(of: Restaurants, known: Broadcast | None = None) -> DataFrame:
    """u, w, c, total, n (customers of the context), wc (training count of the word), lp (log10 probability of the word in the
    context) of every pair, and once0 and once1: what lp would be, were the pair met once, in a held-out or in a training text."""
    used, d = _used(of), of.discounts[0]
    rows = with_totals(of.pairs, *totals_used(of), known)
    tables_of = lambda k: F.col(f"t{k}") if k else F.least("c", F.lit(1))
    above = sum((F.col(f"o{k}") * F.col(f"p{k}") for k in used), F.lit(0.0))
    own = sum((F.col("c") - F.lit(d) * tables_of(k) for k in used), F.lit(0.0))
    log = lambda p: F.log10(p / (len(used) * (F.col("n") + F.lit(STRENGTH))))
    return rows.select(
        "u", "w", "c", "total", "n", "wc", log(own + above).alias("lp"), log(above).alias("once0"),
        log(F.lit(len(used) * (1 - d)) + above).alias("once1"))


def corrections(pairs: DataFrame, least: int) -> DataFrame:
    """Of `pair_probabilities`, what texts need beside the totals of frequent words: _pair, wc (training count of the word, if
    rare), more0 and more1 (what a token of the pair adds to the score of a held-out and of a training text; NULL if there is no
    such text)."""
    rare = (F.col("n") < least) | (F.col("wc") < least)
    more = lambda once: F.when(rare, F.col("lp")).otherwise(F.col("lp") - F.col(once))
    return pairs.select(
        F.xxhash64("u", "w").alias("_pair"), F.when(F.col("wc") < least, F.col("wc")).alias("wc"),
        F.when(F.col("total") > F.col("c"), more("once0")).alias("more0"), F.when(F.col("c") > 0, more("once1")).alias("more1"))


def score(docs: DataFrame, sweeps: int = SWEEPS, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    counts = stage(pair_counts(docs))
    release(spark)
    seated = seat(counts, sweeps, frequent)
    n, v, least, discount = seated.n, seated.v, seated.least, seated.discounts[0]
    known = spark.sparkContext.broadcast(known_totals(*totals_used(seated), least))
    pairs = pair_probabilities(seated, known)
    often_met = at_least(seated.pairs, "total", frequent)
    often = pairs.filter(F.col("total") >= often_met).select("u", "w", "wc", "lp").toArrow()
    rare = stage(corrections(pairs.filter(F.col("total") < often_met), least))
    discard(seated.pairs, seated.contexts, seated.words)
    release(spark)

    base_of = lambda c: (c + 1) / float(n + v + 1)
    keys = pair_keys(*(often[k].to_numpy().view(np.uint64) for k in ("u", "w")))
    order = np.argsort(keys)
    wc = often["wc"].to_numpy()[order]
    used = _used(seated)
    lookup = spark.sparkContext.broadcast((keys[order], np.log10(base_of(wc)), often["lp"].to_numpy()[order], wc > 0))
    new = len(used) * (1 - discount)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, lp, seen = lookup.value
        word_ids, customers = known.value["u"], known.value["n"]
        opens, parents = ([known.value[f"{x}{k}"] for k in used] for x in "op")
        word_base, word_seen = np.log10(base_of(customers)), customers > 0
        row = TaskContext.get().partitionId() << 40
        for batch, first, h, counts in ((b, *t) for b in batches for t in word_hashes(b.column("text"))):
            ids, lengths = with_ends(h, counts), counts + 1
            before, docs_here = previous(ids), len(lengths)
            owner = np.repeat(np.arange(docs_here), lengths)
            at, there = find(keys, pair_keys(before, ids))
            own, at, far = owner[there], at[there], ~there
            add = lambda x, own, at: np.bincount(own, weights=x[at], minlength=docs_here) if len(x) else np.zeros(docs_here)
            n_known, base_score, score = add(seen, own, at), add(base, own, at), add(lp, own, at)

            trains = ~batch.column("held").slice(first, docs_here).to_numpy(zero_copy_only=False)
            far_owner, u, w = owner[far], before[far], ids[far]
            at, there = find(word_ids, w)
            n_known += add(word_seen, far_owner[there], at[there])
            base_score += add(word_base, far_owner[there], at[there])
            context, there_too = find(word_ids, u)
            both = there & there_too
            own, at, context = far_owner[both], at[both], context[both]
            p = new * trains[own] + sum(o[context] * q[at] for o, q in zip(opens, parents, strict=True))
            score += np.bincount(own, weights=np.log10(p / (len(used) * (customers[context] + STRENGTH))) if len(own) else None, minlength=docs_here)

            # The lowest bit tells what the text is.
            rows = 2 * (row + np.arange(docs_here)) + trains
            row += docs_here
            join = lambda a, b: pa.array(np.concatenate([a, b]))
            whole = pa.StructArray.from_arrays(
                [batch.column("doc_id").slice(first, docs_here).cast(pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(n_known.astype(np.int64)),
                 pa.array(base_score), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
            yield pa.RecordBatch.from_arrays([
                join(rows, rows[far_owner]), join(rows, u.view(np.int64)), join(rows, w.view(np.int64)),
                pa.concat_arrays([whole, pa.nulls(len(far_owner), whole.type)])], names=["row", "u", "w", "whole"])

    parts = docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(
        job, "row long, u long, w long, whole struct<doc_id: long, n_tokens: long, n_known: long, base_score: double, score: double>")
    # The row of a whole document carries its own number as pair, so that these spread evenly; it takes nothing from the join.
    parts = parts.select("row", F.xxhash64("u", "w").alias("_pair"), "whole")
    joined = parts.join(rare, "_pair", "left")
    whole = F.col("whole").isNotNull()
    more = F.when(F.col("row").bitwiseAND(F.lit(1)) == 1, F.col("more1")).otherwise(F.col("more0"))
    summed = joined.groupBy("row").agg(
        F.max("whole.doc_id").alias("doc_id"), F.sum("whole.n_tokens").alias("n_tokens"),
        F.sum(F.when(whole, F.col("whole.n_known")).otherwise((F.col("wc") > 0).cast("long"))).alias("n_known"),
        F.sum(F.when(whole, F.col("whole.base_score")).otherwise(F.log10(base_of(F.col("wc"))))).alias("base_score"),
        F.sum(F.when(whole, F.col("whole.score")).otherwise(more)).alias("score"),
    )
    return summed.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
