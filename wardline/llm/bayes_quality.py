"""Quality and toxicity of documents by hierarchical empirical Bayes.

1. A classifier per question (quality, toxic): logistic regression on the presence of its WORDS most telling words and on
   the shape of the text, fitted on at most TRAIN labelled documents (lowest hashes of the id), a bound. Its log odds less
   the prior odds of the sample are the document's evidence.
2. Hosts: the mean of the documents' probabilities, drawn toward the global mean by a Beta prior whose strength is taken
   from how much hosts differ beyond chance (moments). Paths within a host are drawn toward their host in the same way. A
   document does not count in its own site's mean. Sparse sites so stay near what stands above them.
3. Posterior odds of a document = evidence x odds of its path. A document is kept if it is more likely good than not and
   more likely not toxic.

Only sums are grouped; sites are joined back as one row each. Null texts are empty and judged by what an empty text shows;
null hosts and paths are sites of their own. Without labels of both kinds the evidence is 0. Documents are judged one by
one, repeated rows alike; labels of unknown documents are not used, repeated labels count once each. Empty tables give empty
results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import stage

TRAIN = 8192
WORDS = 256
MIN_DOCS = 5
HEADS = ("quality", "toxic")
RIDGE = 1.0


def bare_words(text: str | None) -> set[str]:
    """Distinct words, lower case, without punctuation at their ends."""
    return {w.strip(".,;:!?\"'()[]{}|*#$%&<>-_") for w in (text or "").lower().split()}


def shape(text: str | None) -> list[float]:
    """Parts of the text: capitals, symbols, digits, exclamation marks, bars, repeated lines and words; size."""
    t = text or ""
    n, w = max(len(t), 1), t.split()
    letters = max(sum(map(str.isalpha, t[:])), 1)
    lines = [x for x in t.split("\n") if x.strip()]
    return [
        sum(map(str.isupper, t)) / letters, sum(t.count(c) for c in "#*$%&<>") / n * 5, sum(map(str.isdigit, t)) / n * 5,
        t.count("!") / n * 5, t.count("|") / n * 5, 1 - len(set(lines)) / max(len(lines), 1), 1 - len(set(w)) / max(len(w), 1),
        min(len(w), 1000) / 1000, float(len(w) < 20), letters / n,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(text: str | None, words: list[str]) -> np.ndarray:
    have = bare_words(text)
    return np.array([*(float(w in have) for w in words), *shape(text)])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample of labelled documents with their texts."""
    sample = labels.filter(" and ".join(f"{h} in (0, 1)" for h in HEADS)).orderBy(F.xxhash64("doc_id"), "doc_id", *HEADS).limit(TRAIN)
    sample = stage(sample.select(F.col("doc_id").alias("_id"), *[F.col(h).cast("int").alias(h) for h in HEADS]))
    return docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", *HEADS)  # at most TRAIN rows


def telling_words(rows: DataFrame, head: str) -> list[str]:
    """The words whose presence parts the two classes best, by log odds over their standard error."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ys = [], []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                have = sorted(bare_words(t))
                words += have
                ys += [y] * len(have)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ys, pa.int32())], names=["word", "y"])

    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(head), F.lit(0)).alias("p")).first()
    p, n = float(seen["p"]), float(seen["n"] - seen["p"])
    counted = rows.select("text", F.col(head).alias("y")).mapInArrow(job, "word string, y int").groupBy("word").agg(
        F.sum("y").alias("a"), F.count("*").alias("d")).filter(F.col("d") >= MIN_DOCS)
    a, b = F.col("a") + 0.5, F.col("d") - F.col("a") + 0.5
    z = F.abs(F.log(a / (p + 1 - a)) - F.log(b / (n + 1 - b))) / F.sqrt(1 / a + 1 / b)
    return [r["word"] for r in counted.orderBy(F.desc(z), "word").limit(WORDS).select("word").collect()]


def train(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[list[str], np.ndarray, float]]:
    """Per question the words, the weights and the prior log odds of the sample; left out where only one class is known."""
    rows, models = stage(training_rows(docs, labels)), {}
    for head in HEADS:
        words = telling_words(rows, head)

        def job(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [features(t, words).tolist() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

        got = rows.select("text", F.col(head).alias("y")).mapInArrow(job, "x array<double>, y int").toPandas()
        y = got["y"].to_numpy(float)
        if len(y) and 0 < y.sum() < len(y):
            models[head] = (words, fit_logistic(np.stack(got["x"].to_numpy()), y), float(np.log(y.mean() / (1 - y.mean()))))
    return models


def evidence(docs: DataFrame, models: dict, host: str, path: str) -> DataFrame:
    """doc_id, host, path and per question the log likelihood ratio and the probability under the sample's prior."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "host", "path")]
            texts = batch.column("text").to_pylist()
            for head in HEADS:
                ratio, p = np.zeros(len(texts)), np.full(len(texts), 0.5)
                if head in models:
                    words, w, prior = models[head]
                    odds = np.array([features(t, words) @ w[:-1] + w[-1] for t in texts])
                    ratio, p = odds - prior, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                columns += [pa.array(ratio, pa.float64()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", "path", "r_quality", "p_quality", "r_toxic", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text").mapInArrow(
        job, "doc_id long, host string, path string, r_quality double, p_quality double, r_toxic double, p_toxic double")


def strength(sites: DataFrame, head: str, mean: Column) -> float:
    """Strength of the Beta prior by moments: how far site means lie from `mean` beyond what their sizes explain."""
    m = F.col(f"s_{head}") / F.col("n")
    chance = mean * (1 - mean)
    got = sites.filter("n > 1").agg(
        F.sum(F.col("n") * (m - mean) * (m - mean) - chance).alias("over"), F.sum(F.col("n") - 1).alias("weight"), F.avg(chance).alias("v")).first()
    if not got["weight"] or got["v"] is None:
        return 10.0
    between = max(got["over"] / got["weight"], 1e-4)
    return float(min(max(got["v"] / between - 1, 1.0), 1e4))


def posteriors(rows: DataFrame) -> DataFrame:
    """Adds host_*, path_* and post_* per question to the evidence rows."""
    sums = [F.count("*").alias("n"), *[F.sum(f"p_{h}").alias(f"s_{h}") for h in HEADS]]
    paths = stage(rows.groupBy("host", "path").agg(*sums))
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(f"s_{h}") for h in HEADS]))
    whole = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"s_{h}").alias(h) for h in HEADS]).first()
    means = {h: min(max((whole[h] or 0.5) / (whole["n"] or 1), 1e-3), 1 - 1e-3) for h in HEADS}
    host_k = {h: strength(hosts, h, F.lit(means[h])) for h in HEADS}
    hosts = hosts.select(F.col("host").alias("_host"), F.col("n").alias("host_n"), *[F.col(f"s_{h}").alias(f"host_s_{h}") for h in HEADS])
    sites = stage(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"))
    inner = {h: (F.col(f"host_s_{h}") + host_k[h] * means[h]) / (F.col("host_n") + host_k[h]) for h in HEADS}
    path_k = {h: strength(sites, h, inner[h]) for h in HEADS}
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path", "n": "path_n", **{f"s_{h}": f"path_s_{h}" for h in HEADS}})
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    for h in HEADS:
        p = F.col(f"p_{h}")
        out = out.withColumn(f"host_{h}", (F.col(f"host_s_{h}") - p + host_k[h] * means[h]) / (F.col("host_n") - 1 + host_k[h]))
        out = out.withColumn(f"path_{h}", (F.col(f"path_s_{h}") - p + path_k[h] * F.col(f"host_{h}")) / (F.col("path_n") - 1 + path_k[h]))
        prior = F.least(F.greatest(F.col(f"path_{h}"), F.lit(1e-3)), F.lit(1 - 1e-3))
        out = out.withColumn(f"post_{h}", 1 / (1 + F.exp(-(F.col(f"r_{h}") + F.log(prior / (1 - prior))))))
    return out


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """One row per document: doc_id, per question host, path and posterior probability, and `kept`."""
    rows = stage(evidence(docs, train(docs, labels), host, path))
    out = posteriors(rows)
    return out.select(
        "doc_id", *[f"{k}_{h}" for h in HEADS for k in ("host", "path", "post")],
        ((F.col("post_quality") >= 0.5) & (F.col("post_toxic") < 0.5)).alias("kept"))
