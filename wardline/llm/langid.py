"""Language identification by a string kernel.

A text's feature set is which character n-grams of 1 to 3 letters it has (blended spectrum, presence not counts), hashed to
BITS bits; the kernel of two texts is the number of n-grams they share over the geometric mean of their sizes. LANDMARKS
training texts span the Nystrom space; one ridge regression per language (one versus rest) is solved in it. A batch of texts
is scored by matrix products: bits times landmark bits, kernel values times coefficients.

The fit uses texts of every language: at most PER_LANGUAGE of each, fewer (but FEW) if there are so many languages that all
would pass SAMPLE, chosen by the lowest hashes of their ids among all training documents; their bits (BITS / 8 bytes a
text) are all that reaches the driver. Every language has FEW landmarks or all its texts. Every text is scored whole.

A null text or one without letters is `und` with score 0, as is every text if there is nothing to learn from. Rows are
scored one by one; repeated rows alike. Other columns are not looked at for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 4096
LANDMARKS = 256
PER_LANGUAGE = 400
SAMPLE = 80_000
FEW = 4
RIDGE = 1e-3
NONE = "und"
CHARS = 200_000  # letters worked at a time; longer texts come in overlapping pieces


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def presence(text: str) -> np.ndarray:
    """Which n-grams the text has, as BITS bytes of 0 and 1. Case is folded, anything but letters parts words."""
    out = np.zeros(BITS, np.uint8)
    for start in range(0, len(text), CHARS):
        piece = text[start : start + CHARS + 2].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = (code > 0xBF) | ((code >= 97) & (code <= 122))
        code = np.where(letter, code, np.uint64(32))
        a, b, c = code, code[1:], code[2:]
        one = a * np.uint64(0x9E3779B97F4A7C15)
        two = (one[: len(b)] ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two[: len(c)] ^ c) * np.uint64(0x165667B19E3779F9)
        for grams in (one, two, three):
            out[(grams >> np.uint64(40)) % np.uint64(BITS)] = 1
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of the numbers of n-grams, for all rows of x and y."""
    size = np.sqrt(np.outer(np.maximum(x.sum(axis=1), 1), np.maximum(y.sum(axis=1), 1)))
    return (x @ y.T) / size


def solve(bits: np.ndarray, labels: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Landmarks, coefficients (landmark x language) and languages of the one-versus-rest kernel ridge regression."""
    names = sorted(set(labels.tolist()))
    by_name = [np.flatnonzero(labels == n) for n in names]
    chosen = [rows[i] for i in range(max(map(len, by_name))) for rows in by_name if i < len(rows)][:max(landmarks, sum(min(FEW, len(rows)) for rows in by_name))]
    x = bits.astype(np.float32)
    marks = x[chosen]
    k_mm = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-8 * max(values.max(), 1e-12)
    to_space = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2): the Nystrom map
    z = kernel(x, marks) @ to_space
    z = np.hstack([z, np.ones((len(z), 1))])
    goal = np.where(labels[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = np.array([1.0 / max((labels == n).sum(), 1) for n in labels])[:, None] * len(labels) / len(names)
    gram = z.T @ (z * weight) + ridge * len(labels) * np.eye(z.shape[1])
    w = np.linalg.solve(gram, z.T @ (goal * weight))
    return marks, np.vstack([to_space @ w[:-1], w[-1:]]), names


def training_bits(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits and languages of the bounded training sample."""
    pool = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    found = pool.groupBy("lang").agg(F.count("*").alias("n")).collect()
    wanted = min(PER_LANGUAGE, max(FEW, SAMPLE // max(len(found), 1)))
    rank = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(2**62)) / float(2**62)
    # Twice the wanted share of every language and some, of which the lowest ranks are kept: enough unless chance is absurdly unkind.
    # One row a language, collected already: broadcast, so that no text is shuffled.
    shares = docs.sparkSession.createDataFrame([(r["lang"], (2.0 * wanted + 40) / r["n"]) for r in found], "_lang string, _share double")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(packed, pa.binary())], names=["lang", "rank", "bits"])

    some = pool.withColumn("rank", rank).join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter(F.col("rank") < F.col("_share")).select("lang", "rank", "text")
    lowest = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "bits"))
    rows = some.mapInArrow(job, "lang string, rank double, bits binary").filter("bits is not null").withColumn("_at", lowest).filter(
        F.col("_at") <= wanted).select("lang", "rank", "bits").toPandas().sort_values(["rank", "bits"], kind="stable")
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(b) for b in rows["bits"]), np.uint8).reshape(len(rows), BITS // 8), axis=1) if len(rows) else np.empty((0, BITS), np.uint8)
    return bits, rows["lang"].to_numpy(dtype=object)


def predict(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    bits, labels = training_bits(docs)
    model = solve(bits, labels) if len(labels) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [NONE] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
            for start in range(0, len(rows), 512):
                part = rows[start : start + 512]
                marks, w, langs = model
                k = kernel(np.stack([presence(texts[i]) for i in part]).astype(np.float32), marks)
                margin = k @ w[:-1] + w[-1]
                best = margin.argmax(axis=1)
                for i, b, m in zip(part, best, margin[np.arange(len(part)), best], strict=True):
                    names[i], scores[i] = langs[b], min(max((m + 1) / 2, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(
        job, "doc_id long, held_out boolean, lang_pred string, score double")
