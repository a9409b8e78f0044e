"""Models by name: encoders of batches, and taggers that fall back when a model fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trailweave.shipping import ship

#: Takes a batch of inputs, returns a matrix with a row for each.
Encoder = Callable[[list], np.ndarray]
_ENCODERS: dict[str, Callable[[], Encoder]] = {}


def register_encoder(name: str, make: Callable[[], Encoder]) -> None:
    """``make`` loads the model; it is called once a task."""
    _ENCODERS[name] = make


def encoders() -> tuple[str, ...]:
    return tuple(sorted(_ENCODERS))


#: Rows and bytes of a batch for a model, about.
ROWS, BYTES = 2048, 4 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows and about BYTES bytes, or one row: Spark's may have 10,000 rows of any length."""
    for b in batches:
        rows = max(1, min(ROWS, b.num_rows * BYTES // max(1, b.nbytes)))
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def encode(df: DataFrame, column: str, name: str, out: str = "embedding") -> DataFrame:
    """Adds vectors of unit length for a column, by Arrow batches."""
    if name not in _ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; there are {', '.join(encoders()) or 'none'}")
    make = _ENCODERS[name]

    def loaded() -> Callable[[list], pa.Array]:
        model = make()

        def vectors(values: list) -> pa.Array:
            x = np.asarray(model(values), np.float32)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            unit = np.divide(x, n, out=x.copy(), where=n > 0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(unit.ravel()))

        return vectors

    return _added(df, column, loaded, out, "array<float>")


def attach(df: DataFrame, column: str, model: Callable[[list], list], kind: str, out: str, fallback: object = None) -> DataFrame:
    """Adds what ``model`` says of each value: a batch at a time, one by one where a batch fails, and
    ``fallback`` where that fails too."""

    def one(v: object) -> object:
        try:
            return model([v])[0]
        except Exception:
            return fallback

    def said(values: list) -> list:
        try:
            return list(model(values))
        except Exception:
            return [one(v) for v in values]

    return _added(df, column, lambda: said, out, kind)


def _added(df: DataFrame, column: str, load: Callable[[], Callable[[list], list | pa.Array]], out: str, kind: str) -> DataFrame:
    """``df`` with ``out``, of Spark's type ``kind``, as what ``load`` returns gives it for lists of values of ``column``."""
    ship(df.sparkSession)
    schema = df.select("*", F.lit(None).cast(kind).alias(out)).schema
    arrow = to_arrow_type(schema[-1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = load()
        for b in _parts(batches):
            got = given(b.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, got if isinstance(got, pa.Array) else pa.array(got, arrow)], [*b.schema.names, out])

    return df.mapInArrow(run, schema)
