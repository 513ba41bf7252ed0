"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: its words, its pairs of words, and runs of one to three word forms (length, case, digits,
symbols, end mark, repetition), each hashed into one weight vector.  A text's score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .shingles import U, mixed, words_of

#: Labelled rows that are learned from at most (expected; they are picked by a hash).
SAMPLE = 6000
#: Weights, the last of which is the bias; passes over the sample; the updates' rates.
BITS, PASSES = 18, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.01
ROWS = 256


def features(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    """Distinct feature numbers of each text, sorted."""
    h, counts, forms = words_of(texts, shapes=True)
    shape = mixed(forms.astype(U) + U(0xA5A5_0000))
    runs = [(h, 1), (h[:-1] * U(3) + h[1:] * U(0x9E3779B97F4A7C15), 2), (shape * U(5), 1), (shape[:-1] * U(7) + shape[1:] * U(11), 2), (shape[:-2] * U(13) + shape[1:-1] * U(17) + shape[2:] * U(19), 3)]
    numbers = [((mixed(x) >> U(64 - bits)).astype(np.int32), n) for x, n in runs]
    out, at = [], 0
    for n in counts.tolist():
        out.append(np.unique(np.concatenate([x[at : at + n - k + 1] for x, k in numbers if n >= k])) if n else np.zeros(0, np.int32))
        at += n
    return out


def _dot(weights: np.ndarray, own: np.ndarray) -> float:
    return float(weights[own].sum()) / np.sqrt(len(own)) if len(own) else 0.0


def ftrl(samples: list[tuple[np.ndarray, int]], bits: int = BITS, passes: int = PASSES) -> np.ndarray:
    """Weights after the updates; the last one is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for turn in range(passes):
        for k in np.random.default_rng(turn).permutation(len(samples)):
            own, y = samples[k]
            at = np.append(own, size - 1)
            value = np.append(np.full(len(own), 1 / np.sqrt(max(len(own), 1))), 1.0)
            zs, ns = z[at], n[at]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + root) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            z[at] = zs + g - (np.sqrt(ns + g * g) - root) / ALPHA * w
            n[at] = ns + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most about ``sample`` labelled rows that are not held out; the driver gets their feature numbers alone.

    Without labelled rows all weights are 0 and every score is 0.5."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y"))
    n = own.count()
    picked = own.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "id")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in features(batch.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], ["id", "y", "f"])

    got = sorted((r["id"], r["y"], bytes(r["f"])) for r in rows.mapInArrow(numbered, "id long, y int, f binary").toLocalIterator())
    return ftrl([(np.frombuffer(f, np.int32), y) for _, y, f in got])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted.

    Null and empty texts get the bias's score; repeated rows and null ids give a row each; other columns are left out; an empty
    table gives no rows.  The weights (1 MB) are broadcast; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, ROWS):
                out += [_dot(w, x) + float(w[-1]) for x in features(batch.column("t").slice(at, ROWS).to_pylist())]
            values = 1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values)], ["id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(scored, "id long, score double")
    return own.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
