"""N-gram Jaccard join: documents whose five-word shingle sets have a Jaccard similarity of 80 % or more, as components.

1. Documents with equal sets are one class; all later steps work on classes.
2. Shingles are put in one order: rare ones first, by hash, then the frequent ones (in more than `FREQUENT` classes; the
   most frequent `MOST_FREQUENT` of them, a fixed bound, are handed to the tasks). Which shingles count as frequent only
   steers cost: any division gives the same links.
3. Two sets of similarity t share one of the first n - ceil(t n) + 1 shingles of each. If that is a rare one, it is
   indexed alone. If all they share there are frequent, the prefix is extended: two such sets of n shingles differ in at
   most n / 4 of them, so of the first n / 4 + 2 shingles that they share, two stand side by side in both. These pairs of
   neighbours (2-token combinations) are indexed in place of single frequent shingles.
4. Every class with an index key is paired with the least and the greatest class of that key (stars, not all pairs). Pairs
   that cannot be similar go: by their sizes, then by bitmaps of the sets, whose differing bits bound the overlap from above.
   The rest is compared exactly, on whole sets. Linked classes get a component. Keys whose classes all lie in one component are done; once more a star is
   drawn between components, and what then still spans components is compared pair by pair.
   Only pairs inside a component stay uncompared, and these change nothing.

Null and empty texts have an empty set and are linked with nothing, not even with each other. Repeated rows have equal
sets. Null ids are allowed: a component of only null ids has a null component_id. An empty table gives an empty result;
other columns are not looked at. Classes and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.components import components
from wardline.llm.ngrams import set_key, shingle_sets, spread
from wardline.llm.text import discard, packed, parted, release, stage

PERCENT = 80
FREQUENT = 32
MOST_FREQUENT = 250_000
STARS = 2
ROWS = 200_000
BITMAP = 32  # words of 64 bits
SEEN = 200_000
SMALL = 64  # classes of a key that are paired by a join; more are compared in blocks
BLOCK = 1024


def prefix(n: int) -> int:
    """Shingles of a set of n of which a similar set must hold one."""
    return n - (PERCENT * n + 99) // 100 + 1


def reach(n: int) -> int:
    """Extended prefix: among so many, the first n // 4 + 2 shared ones are found."""
    return min(n, prefix(n) - 1 + n // 4 + 2)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit. Sets that differ in d shingles differ in at most d bits."""
    bits = np.bincount((found >> np.uint64(20)) & np.uint64(BITMAP * 64 - 1), minlength=BITMAP * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, node (the set's key) and bits (its bitmap), null for an empty set."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, bits = np.zeros(len(batch), np.int64), [], []
            for i, found in shingle_sets(batch.column("text")):
                n[i] = len(found)
                nodes.append(set_key(found) if len(found) else None)
                bits.append(bitmap(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(nodes, pa.int64()),
                pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "node", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        job, "doc_id long, text_key long, n_shingles long, node long, bits array<long>")


def _fresh(texts: pa.Array, seen: set) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) of the classes that the task has not met lately; the same class from elsewhere does no harm."""
    for _, found in shingle_sets(texts):
        if len(found):
            node = set_key(found)
            if node not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                yield node, found


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, at most MOST_FREQUENT: counted over the first three tenths (by hash) of every set."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def flush() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int32)), pa.array(n.astype(np.int32))], names=["shingle", "n"])

        for batch in batches:
            for _, found in _fresh(batch.column("text"), seen):
                held.append(half(found[: 3 * len(found) // 10 + 1]))
                size += len(held[-1])
                if size >= 5 * ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select("text").mapInArrow(job, "shingle int, n int").repartition("shingle")  # counts are partial already
    top = rows.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    found = top.agg(F.collect_list("shingle")).first()[0]  # at most MOST_FREQUENT numbers
    return np.sort(np.array(found, np.int32).view(np.uint32))


def half(found: np.ndarray) -> np.ndarray:
    """Half of a shingle's hash: enough to class it, and the same for all."""
    return (found >> np.uint64(8)).astype(np.uint32)


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, node, n): index keys of every class, single rare shingles and pairs of neighbouring frequent ones."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def keys_of(found: np.ndarray, order: np.ndarray) -> np.ndarray:
        n, rare, common = len(found), found, found[:0]
        if len(order):
            h = half(found)
            often = order[np.minimum(np.searchsorted(order, h), len(order) - 1)] == h
            rare, common = found[~often], found[often]
        keys = rare[: prefix(n)]
        if len(rare) < prefix(n):
            run = common[: reach(n) - len(rare)]
            keys = np.concatenate([keys, spread(run[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ run[1:])])
        return keys

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, held, size = shared.value, set(), [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([k for k, _, _ in held]).view(np.int64)),
                pa.array(np.concatenate([np.full(len(k), node, np.int64) for k, node, _ in held])),
                pa.array(np.concatenate([np.full(len(k), n, np.int32) for k, _, n in held])),
            ], names=["sig", "node", "n"])

        for batch in batches:
            for node, found in _fresh(batch.column("text"), seen):
                held.append((keys_of(found, order), node, len(found)))
                size += len(held[-1][0])
                if size >= ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(job, "sig long, node long, n int")


def comparable(n: str, m: str) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the classes in `nodes`, from one document of each. Documents that cannot be one of these are
    left out by a bitmap of fixed size (1 MB, so it may be broadcast) before anything is shuffled."""
    wanted = stage(classes.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("_want")))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    marks = wanted.select(place("_want").alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_bits"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_p", place("doc_id"))
    some = some.join(F.broadcast(marks), F.shiftright("_p", 6) == F.col("_word")).filter(
        F.expr("shiftrightunsigned(_bits, cast(_p & 63 as int)) & 1 = 1"))
    some = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("_want")), "left_semi").select("text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for node, found in _fresh(batch.column("text"), set()):
                held.append((node, found.view(np.int64)))
                size += len(found)
                if size >= ROWS:
                    yield pa.RecordBatch.from_pydict({"node": [a for a, _ in held], "shingles": [b for _, b in held]})
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"node": [a for a, _ in held], "shingles": [b for _, b in held]})

    found = some.mapInArrow(job, "node long, shingles array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow the similarity: twice the overlap is at most both sizes less the differing bits."""
    side = lambda c, k: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    differ = F.aggregate(F.zip_with("bits_x", "bits_y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, k: s + k)
    sizes = F.col("n_x") + F.col("n_y")
    overlap = (sizes - differ) / 2
    return both.filter((100 + PERCENT) * overlap >= PERCENT * sizes).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, compared exactly."""
    pairs = stage(possible(pairs, classes))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stage(sets_of(docs, classes, nodes))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stage(both.select("a", "b", "x", "y").mapInArrow(job, "a long, b long"))
    discard(sets, pairs)
    release(docs.sparkSession)
    return links


def spanning(rows: DataFrame) -> DataFrame:
    """Rows (sig, node, n, label) of the keys whose classes have several labels, with the ends `lo` and `hi` of each key
    and the number of its rows. Without a label every class is its own."""
    label = F.col("label") if "label" in rows.columns else F.col("node")
    me, key = F.struct(label.alias("label"), "node", "n"), Window.partitionBy("sig")
    ends = rows.withColumns({"lo": F.min(me).over(key), "hi": F.max(me).over(key), "rows": F.count("*").over(key)})
    return ends.filter("lo.label <> hi.label").withColumn("label", label)


def star_pairs(rows: DataFrame) -> DataFrame:
    """Every class with both ends of its key, where sizes allow it and the labels differ."""
    pair = lambda end: F.when(
        (F.col("label") != F.col(f"{end}.label")) & comparable("n", f"{end}.n"),
        F.struct(F.least("node", f"{end}.node").alias("a"), F.greatest("node", f"{end}.node").alias("b")))
    return rows.select(F.explode(F.array_compact(F.array(pair("lo"), pair("hi")))).alias("p")).select("p.a", "p.b").distinct()


def all_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Per key: every two classes of different components. Keys of few classes are joined with themselves. Those of many are
    gathered by their least class, which the keys of a group of copies mostly share, so that a pair meets once and not at
    every key; such a gathering is dealt into blocks, every two blocks meet in a task, and only pairs whose bitmaps allow
    the similarity come out."""
    few = rows.filter(F.col("rows") <= SMALL)
    x = few.select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = few.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    joined = x.join(y, "sig").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & comparable("na", "nb")).select("a", "b")

    many = rows.filter(F.col("rows") > SMALL).select(F.col("lo.node").alias("hub"), "node", "n", "label").distinct().withColumn(
        "blocks", F.ceil(F.count("*").over(Window.partitionBy("hub")) / BLOCK).cast("int"))
    many = many.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    dealt = many.join(classes.select("node", "bits"), "node").withColumn("meet", F.explode(meets)).select(
        "hub", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "mine", "node", "n", "label", "bits")

    def job(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).combine_chunks()
        node, n, label, mine = (col(c).to_numpy() for c in ("node", "n", "label", "mine"))
        bits = col("bits").flatten().to_numpy().reshape(len(node), BITMAP).view(np.uint64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        right = np.flatnonzero(mine == j)
        a, b = [], []
        for k in np.flatnonzero(mine == i):
            other = right[(label[right] != label[k]) & (100 * np.minimum(n[right], n[k]) >= PERCENT * np.maximum(n[right], n[k]))]
            differ = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
            sizes = n[other].astype(np.int64) + int(n[k])
            other = other[(100 + PERCENT) * (sizes - differ) >= 2 * PERCENT * sizes]
            a.append(np.minimum(node[k], node[other]))
            b.append(np.maximum(node[k], node[other]))
        empty = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)})

    return joined.union(dealt.groupBy("hub", "i", "j").applyInArrow(job, "a long, b long")).distinct()


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, label): components of the classes (node, n, bits, doc_id) that are linked with another class; None if none is."""
    spark = docs.sparkSession
    frequent = frequent_shingles(docs)
    release(spark)
    # A key met by one class only joins nothing; the others are the index. One exchange serves all three steps.
    index = stage(spanning(signatures(docs, frequent).repartition("sig").dropDuplicates(["sig", "node"])))
    links, labels, tried, spent = None, None, None, [index]
    for turn in range(STARS + 1):
        rows = index
        if labels is not None:
            rows = index.select("sig", "node", "n").join(labels.select("node", F.col("label").alias("known")), "node", "left").withColumn(
                "label", F.coalesce("known", "node")).drop("known")
            rows = spanning(rows)
        pairs = star_pairs(rows) if turn < STARS else all_pairs(rows, classes)
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        release(spark)
        if pairs.isEmpty():
            spent.append(pairs)
            if turn < STARS:
                continue
            break
        found = verified(pairs, docs, classes)
        spent += [pairs, found]
        tried = pairs if tried is None else tried.union(pairs)
        if labels is None or not found.isEmpty():
            links = found if links is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found)
            labels = stage(components(links))
        release(spark)
    discard(*spent)
    return labels


def grouped(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, label (of its component; null for an empty set), component_id."""
    classes = stage(classes_of(docs))
    ids = stage(classes.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").cast("int").alias("n"), F.first("bits").alias("bits")))
    labels = linked(docs, ids.withColumnRenamed("least", "doc_id"))
    if labels is None:
        ids = ids.select(F.col("node").alias("_node"), F.col("node").alias("label"), F.col("least").alias("component_id"))
    else:
        tied = ids.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn(
            "label", F.coalesce("label", "node"))
        lowest = tied.groupBy("label").agg(F.min("least").alias("component_id"))
        ids = tied.join(lowest, "label").select(F.col("node").alias("_node"), "label", "component_id")
    return classes.drop("bits").join(stage(ids), F.col("node") == F.col("_node"), "left").drop("_node", "node")


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    lone = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped(docs).select("doc_id", "n_shingles", lone.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group (a null one only if there is no other), once if its row is
    repeated; documents without words all stay."""
    found = grouped(docs)
    rows = stage(found.filter("label is not null").withColumn(
        "who", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")))
    discard(found)
    first = rows.groupBy("label").agg(F.min("who").alias("best"))
    judged = rows.join(first, "label").withColumn("stays", F.col("who").eqNullSafe(F.col("best")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_key"))
    keys = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    gone = stage(judged.filter("not stays").select(*keys).distinct())
    again = stage(judged.filter("stays").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select(*keys))
    discard(rows)
    small, unpacked = packed(docs, ("doc_id", "text"))
    # Only texts that a bitmap of fixed size takes for one of those that go are shuffled.
    keyed = small.withColumn("_both", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    maybe, clear = parted(keyed, "_both", gone.select(F.xxhash64("_id", "_key").alias("k")))
    kept = maybe.join(gone, same, "left_anti").union(clear).drop("_both")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return unpacked(kept)
