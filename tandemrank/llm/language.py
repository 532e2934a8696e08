"""Language identification by a string kernel: n-gram presence, landmarks, ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemrank.llm.common import fold_pieces, materialize, table, train_row
from tandemrank.llm.registry import query

SPECTRUM, BITS, LANDMARKS, TRAIN_PER_LANG, MOST_LANGS, RIDGE = (1, 2, 3, 4), 18, 96, 800, 200, 1e-3
UNKNOWN = "und"
_KEEP = np.full(256, 32, np.uint8)
_KEEP[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_TABLE = _KEEP.tobytes()
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted hashes (BITS bits) of the distinct byte n-grams of a whole text, all lengths of SPECTRUM together.

    Letters count in lower case; all else is a word gap. ``seen`` is a cleared scratch array of 2**BITS flags.
    """
    tail = b" "

    def mark(data: bytes) -> None:
        b = np.frombuffer(data, np.uint8).astype(np.uint64)
        code = np.zeros(len(b), np.uint64)
        for n in SPECTRUM:
            if n <= len(b):
                code = code[: len(b) - n + 1] << np.uint64(8) | b[n - 1 :]
                seen[((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = True

    for piece in fold_pieces((text or "").lower().encode("utf-8", "replace")):
        flat = piece.translate(_TABLE)
        words = b" ".join(flat.split())
        before = b" " if flat[:1] == b" " and tail[-1:] != b" " else b""
        after = b" " if words and flat[-1:] == b" " else b""
        data = tail + before + words + after
        mark(data)
        tail = data[-3:]
    mark(tail if tail[-1:] == b" " else tail + b" ")
    got = np.flatnonzero(seen)
    seen[got] = False
    return got


@dataclass(frozen=True)
class Model:
    """``cells`` x landmarks presence matrix over the landmarks' n-grams, its row numbers, and the ridge weights."""

    rows: np.ndarray  # row of an n-gram hash in `presence`, or the last (zero) row
    presence: np.ndarray
    norms: np.ndarray  # square roots of the landmarks' numbers of n-grams
    weights: np.ndarray  # landmarks x languages
    langs: list[str]


def landmarks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen = np.zeros(1 << BITS, bool)
    sets = [grams(t, seen) for t in texts]
    used = np.unique(np.concatenate(sets))
    rows = np.full(1 << BITS, len(used), np.int32)
    rows[used] = np.arange(len(used))
    presence = np.zeros((len(used) + 1, len(texts)), np.float32)
    for j, s in enumerate(sets):
        presence[rows[s], j] = 1
    return rows, presence, np.sqrt([max(1, len(s)) for s in sets]).astype(np.float32)


def kernel(texts: list[str | None], rows: np.ndarray, presence: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of each text with each landmark: shared distinct n-grams over root of both counts."""
    seen, out = np.zeros(1 << BITS, bool), np.zeros((len(texts), len(norms)), np.float64)
    for i, t in enumerate(texts):
        got = grams(t, seen)
        at = rows[got]
        at = at[at < len(presence) - 1]
        out[i] = presence[at].sum(axis=0) / np.sqrt(max(1, len(got)))
    return out / norms


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, count: int = LANDMARKS) -> Model | None:
    """Nyström landmarks and one-versus-rest ridge weights, from rows with crc32(doc_id) mod 5 <> 0 and a language.

    The sample takes, of each language (the MOST_LANGS commonest), the ``per_lang`` texts with the smallest low hash bits, so
    its size is bounded at any input size; copies of a text count once. The landmarks are a part of it, dealt evenly
    over the languages. Kernel rows are computed in tasks; the driver solves a system of ``count`` unknowns. None
    without a usable row.
    """
    spark = docs.sparkSession
    usable = docs.filter(train_row() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", F.xxhash64("text").alias("h"), "text"
    )
    hashes = materialize(usable.select("lang", "h").distinct())
    common = hashes.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    if not common:
        return None
    # About 2 * per_lang + 100 of a language's distinct hashes go on, so that no task gathers much more than the sample.
    # They are the first in the order of the window: what is left out would not be taken.
    below = F.create_map(*[F.lit(x) for r in common for x in (r["lang"], min(1.0, (2 * per_lang + 100) / r["count"]))])[F.col("lang")]
    low = F.pmod("h", F.lit(1 << 30))
    first = Window.partitionBy("lang").orderBy(low, "h")
    keys = hashes.filter(low < below * (1 << 30)).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_lang)
    keys = materialize(keys)  # at most MOST_LANGS * per_lang rows: a proven bound for the broadcast
    sample = materialize(
        usable.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h", "nth").agg(F.min("text").alias("text"))
    )
    each = max(1, count // len(common))
    marks = [r["text"] for r in sample.filter(F.col("nth") <= each).orderBy("lang", "h").collect()]
    rows, presence, norms = landmarks(marks)
    held = spark.sparkContext.broadcast((rows, presence, norms))

    def run(frames):
        for f in frames:
            k = kernel(f["text"].tolist(), *held.value)
            yield pd.DataFrame({"lang": f["lang"], "k": list(k)})

    got = sample.select("lang", "text").mapInPandas(run, "lang string, k array<double>").toPandas()
    k, langs = np.stack(got["k"].to_numpy()), sorted(set(got["lang"]))
    own = kernel(marks, rows, presence, norms)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # landmarks to Nyström features
    x = k @ root
    y = np.where(got["lang"].to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    share = np.array([(got["lang"] == c).mean() for c in langs])
    weight = 1 / share[np.array([langs.index(c) for c in got["lang"]])]  # each language counts alike
    a = (x * weight[:, None]).T @ x + RIDGE * weight.sum() * np.eye(x.shape[1])
    w = root @ np.linalg.solve(a, (x * weight[:, None]).T @ y)
    return Model(rows, presence, norms, w, langs)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0, as are all without a model. Ties go to the first
    language by name. The model is bounded by its landmarks and is broadcast. Only doc_id and text are read.
    """
    return _predict(docs.select("doc_id", "text"), model)


def _predict(docs: DataFrame, model: Model | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    spec = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    def run(batches):
        m = held.value
        for b in batches:
            texts = b.column("text").to_pylist()
            asked = [i for i, t in enumerate(texts) if m and t and _LETTER.search(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for s in range(0, len(asked), 256):
                some = asked[s : s + 256]
                value = kernel([texts[i] for i in some], m.rows, m.presence, m.norms) @ m.weights
                best = value.argmax(axis=1)
                for i, j, v in zip(some, best, value):
                    lang[i], score[i] = m.langs[j], float(np.clip((v[j] + 1) / 2, 0, 1))
            columns = [b.column(f.name) for f in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["lang_pred", "score"])

    return docs.mapInArrow(run, spec)


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents with letters, with all their columns: those whose language nothing could tell go.

    Also without a model, as of a corpus without a language to learn from, all documents with letters stay.
    """
    model = train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]"))  # as _LETTER
    packed = docs.select(F.struct("*").alias("row"), "text")
    return _predict(packed, model).filter(F.col("lang_pred") != UNKNOWN).select("row.*")


@query("op5_string_kernel_language")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (~train_row()).alias("held_out"), "lang_pred", "score")
