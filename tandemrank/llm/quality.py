"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.llm.common import fold_pieces, materialize, mix, table, train_row, words_of
from tandemrank.llm.registry import query

BITS, TRAIN_ROWS, TRAINERS, EPOCHS = 18, 16_000, 4, 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.01
THRESHOLD = 0.3
_UP = np.zeros(256, np.int64)
_UP[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _grams(data: bytes, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of one piece of text, and its last words for the next piece.

    Two word streams give n-grams: the words themselves (1 and 2 words) and their forms (1 to 3): lower case, capital,
    upper case, same as the word before, or the sign itself.
    """
    h, kind, starts, ends = words_of(data, signs=True)
    b = np.frombuffer(data, np.uint8)
    ups, letters = (np.concatenate([[0], np.cumsum(t[b])]) for t in (_UP, _LETTER))
    n_up, n_letter = ups[ends] - ups[starts], letters[ends] - letters[starts]
    form = np.where(n_letter == 0, 3, np.where(n_up == 0, 0, np.where((n_up * 2 > n_letter) & (n_letter > 1), 2, 1)))
    words = np.concatenate([carry[0], h])
    before = len(carry[0])
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    forms = np.concatenate([carry[1], np.where(kind == 1, form.astype(np.uint64), h)])
    forms = np.where(same & (np.arange(len(words)) >= before), np.uint64(9), forms)
    out, one = [], np.uint64(0x9E3779B97F4A7C15)
    for stream, most in ((words, 2), (forms, 3)):
        got = np.zeros(len(stream), np.uint64)
        for n in range(1, most + 1):
            got = mix((got[:-1] if n > 1 else got) * one + stream[n - 1 :] + np.uint64(n + 10 * (stream is forms)))
            fresh = got[max(0, before - n + 1) :]
            out.append(fresh)
    return np.concatenate(out), np.stack([words[-2:], forms[-2:]]) if len(words) else carry


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a whole text: square roots of n-gram counts by hash, of unit length. Index 0 is the constant 1."""
    carry, parts = np.zeros((2, 0), np.uint64), []
    for piece in fold_pieces((text or "").encode("utf-8", "replace")):
        got, carry = _grams(piece, carry)
        parts.append(got)
    index, count = np.unique((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    value = np.sqrt(count)
    norm = np.linalg.norm(value)
    value = value / norm if norm else value
    return np.concatenate([[0], index + 1]), np.concatenate([[1.0], value])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of per-coordinate follow-the-regularised-leader updates, in the given order."""
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for i, x, y in examples:
            zi, ni = z[i], n[i]
            w = _weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[i] = grown
    return _weights(z, n)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, trainers: int = TRAINERS) -> np.ndarray:
    """Weights from labelled rows with crc32(doc_id) mod 5 <> 0, averaged over up to ``trainers`` tasks.

    At most ``rows`` labelled ids, those with the smallest hashes, are used: that bounds time and memory at any input
    size. Ids with a null or contradictory label are left out; repeated equal labels count once. Without any labelled
    row all weights are 0, so every score is 0.5.
    """
    spark, size = docs.sparkSession, (1 << BITS) + 1
    known = (
        labels.filter(train_row() & F.col("quality").isin(0, 1)).groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")
    )
    known = materialize(known)  # at most `rows` rows of 12 bytes: a proven bound for the broadcast
    trainers = max(1, min(trainers, known.count() // 2000))
    mine = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(trainers)).alias("part"),
        F.xxhash64("doc_id", F.lit(4)).alias("turn"), "text", "y",
    )

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["turn", "text"], na_position="first")
        w = ftrl([(*features(t), float(y)) for t, y in zip(g["text"], g["y"])], size)
        return pd.DataFrame({"n": [len(g)], "w": [w.astype(np.float32).tobytes()]})

    got = mine.groupBy("part").applyInPandas(fit, "n bigint, w binary").collect()  # `trainers` rows of 1 MB
    if not got:
        return np.zeros(size, np.float32)
    total = sum(r["n"] for r in got)
    return sum(np.frombuffer(r["w"], np.float32) * (r["n"] / total) for r in got).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, of every whole text (null: empty; an empty text gets the prior).

    Weights have a fixed size (1 MB), so they are broadcast. Only doc_id and text are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        w = held.value
        for b in batches:
            out = []
            for t in b.column("text"):
                i, x = features(t.as_py())
                out.append(1 / (1 + np.exp(-np.clip(w[i] @ x, -35.0, 35.0))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (~train_row()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
