"""Helpers that the training-data operators share: materialised tables, slices of batches, joins of skewed keys, 64-bit mixing."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.tables import materialise, release, shared_dir  # noqa: F401 - for the operators

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_GOLDEN, _MIX_A, _MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_holder: list = [None, None]


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """In a worker: what another operator remembers goes before this one starts to remember.

    Workers serve one stage after the other; without this their memories would add up.
    """
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
        _holder[:] = [name, clear]
        gc.collect()
        pa.default_memory_pool().release_unused()


#: Texts, and characters of texts, that a worker holds at once.
ROWS_AT_ONCE, CHARS_AT_ONCE = 1_000, 8_000_000


def slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = ROWS_AT_ONCE, chars: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, and so many bytes of the text column; one row at least.

    Spark itself bounds a batch by rows and bytes (spark.sql.execution.arrow.maxRecordsPerBatch, maxBytesPerBatch).
    """
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes, dtype=np.int64), 0
        while lo < b.num_rows:
            held = int(ends[lo - 1]) if lo else 0
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, held + chars, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi


#: A key of a lookup counts as hot from this many rows on, if it also holds a thousandth of them.
HOT_ROWS = 500


def lookup_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of ``left`` with ``right``, whose keys are unique and not null, split by how often a key occurs on the left.

    Keys that hold at least a thousandth of the left rows (a thousand keys at most) are broadcast, so that none of them
    lands in one task; the others are shuffled. Both sides are read twice: give written tables.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    hot = [r[key] for r in counts.where(F.col("n") >= max(HOT_ROWS, total // 1000)).where(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective finaliser on unsigned 64-bit integers (splitmix64's constants)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> U64(30))) * _MIX_A
        x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` bears it."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = f"_{wish}"
    return wish


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names, so that clashing extra columns play no part."""
    return df.select(*(F.col(f"`{c}`").alias(new) for new, c in columns.items()))


