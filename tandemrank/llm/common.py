"""Shared helpers: documents with stable row numbers, connected groups, byte-level word hashing."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemrank.session import scratch_dir

_CAPTURES: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for capture in _CAPTURES:
        capture.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def drop_path(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    drop_path(table.sparkSession, table._scratch_path)


@contextlib.contextmanager
def captured():
    """The paths of the tables that ``materialize`` writes meanwhile."""
    paths: list[str] = []
    _CAPTURES.append(paths)
    try:
        yield paths
    finally:
        _CAPTURES.remove(paths)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def train_row(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text modulo 5 is not 0; such rows may be learnt from. A null id is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def number_rows(df: DataFrame) -> DataFrame:
    """``df`` written once as columns ``rid`` (unique, fixed by the written table) and ``row`` (all columns of ``df``)."""
    return materialize(df.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")))


def components(edges: DataFrame) -> DataFrame:
    """Connected groups of the graph ``edges(a, b)``: ``node`` and ``root``, the smallest node of its group.

    Smallest labels travel along edges and are then looked up in themselves, which halves long paths; every round is
    written to the shared folder. Only a number of changes reaches the driver. Nodes without an edge are not returned.
    """
    both = materialize(
        edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct()
    )
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(state.withColumnsRenamed({"node": "b", "root": "near"}), "b").groupBy(F.col("a").alias("node"))
        stepped = (
            state.join(seen.agg(F.min("near").alias("near")), "node")
            .select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        )
        up, before = state.select(F.col("node").alias("mid"), F.col("root").alias("top")), state
        state = materialize(
            stepped.join(up, "mid").select(
                "node", F.least("mid", "top").alias("root"), (F.least("mid", "top") != F.col("old")).alias("moved")
            )
        )
        drop(before)
        if state.filter("moved").limit(1).count() == 0:
            drop(both)
            return state.select("node", "root")


# Byte classes for words: 0 white space, 1 part of a word, 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = 1
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] = _LOWER[97:123]
_ODD = 0x9E3779B97F4A7C15
_PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (0x100000001B3, pow(0x100000001B3, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD)
    return x ^ (x >> np.uint64(29))


def fold_pieces(data: bytes, size: int = _PIECE):
    """Cut ``data`` into pieces of about ``size`` bytes, at a space or line end where one is near the cut."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(b" ", at + size // 2, at + size), data.rfind(b"\n", at + size // 2, at + size)) + 1
        cut = cut or at + size
        yield data[at:cut]
        at = cut
    yield data[at:]


def words_of(data: bytes, signs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class, start and end of each word of ``data`` (at most about a million bytes), in order.

    A word is a run of non-space bytes, or with ``signs`` a run of one class. ASCII letters hash in lower case.
    """
    if not data:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint8), none, none
    if not _TABLES:
        _TABLES.append(_powers(2 * _PIECE + 2))
    power, inverse = _TABLES[0]
    b = np.frombuffer(data, np.uint8)
    kind = _CLASS[b]
    if not signs:
        kind = np.minimum(kind, 1) if kind.max() < 2 else (kind > 0).astype(np.uint8)
    edge = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(b)]])
    kept = kind[starts] > 0
    starts, ends = starts[kept], ends[kept]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LOWER[b] * power[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), kind[starts], starts, ends
