"""What the operators of this subpackage share: the shared folder, written tables, small helpers.

Every intermediate result that is read more than once is written as Parquet below the folder that
the session names in ``spark.checkpoint.dir``, so that a lost executor costs a task and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.scratch import drop, run_dir
from trailweave.shipping import ship

__all__ = ["BROADCAST_BYTES", "done", "fresh_path", "held", "let", "literal_rows", "literal_side", "ship", "small_side", "split_by_bits", "sweep", "temporaries", "texts_of", "written"]
#: The largest table, in estimated bytes, that is ever broadcast on purpose.
BROADCAST_BYTES = 8 << 20
_TEMPORARY: ContextVar[list | None] = ContextVar("temporary", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the application's folder, which goes when Python ends."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns what was written: this cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if (left := _TEMPORARY.get()) is not None:
        left.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def done(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: those of earlier rounds, mostly."""
    for t in tables:
        drop(t.sparkSession, t._written_at)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever ``written`` wrote within: for callers that have written the result."""
    left: list[str] = []
    token = _TEMPORARY.set(left)
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for path in left:
            drop(spark, path)


_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """A large object that a worker keeps from task to task: one at a time, so the last operator's goes."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a batch one by one: they aren't all there at once as Python strings."""
    return (x.as_py() for x in column)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this application has left in the shared folder."""
    drop(spark, run_dir(spark))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A small table made on the driver, without Python or RDDs on the executors."""

    def one(v, t: str) -> str:
        return f"CAST(NULL AS {t})" if v is None else f"CAST('{v!r}' AS {t})" if t == "double" else f"CAST({v!r} AS {t})"

    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in zip(names, types))).limit(0)
    body = ", ".join("(" + ", ".join(one(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def literal_side(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """``literal_rows`` with a broadcast hint if they stay below BROADCAST_BYTES: a value takes about 8 bytes."""
    df = literal_rows(spark, rows, names, types)
    return F.broadcast(df) if len(rows) * len(names) * 8 <= BROADCAST_BYTES else df


def split_by_bits(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` surely isn't among ``keys``, and those of which it may be; the first needn't be shuffled to know.

    The keys, a written table of one column of that name, set bits of up to 2048 bitmaps of 4 KB, which are
    broadcast: at most BROADCAST_BYTES, whatever the size of the table. With so many keys that most bits
    are set, more rows go the second way; what is true of them is up to the caller to find out exactly.
    Rows with a null key go the first way.
    """
    count = keys.count()
    maps = 1
    while maps < 2048 and maps << 15 < 16 * count:
        maps <<= 1

    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(maps << 15))

    spot = keys.select(bit(F.col(key)).alias("__bit"))
    bitmaps = spot.groupBy(F.bitmap_bucket_number("__bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__bits"))
    seen = rows.withColumn("__bit", F.when(F.col(key).isNotNull(), bit(F.col(key)))).join(F.broadcast(bitmaps), F.bitmap_bucket_number("__bit") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return seen.where(~hit).select(*rows.columns), seen.where(hit).select(*rows.columns)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
