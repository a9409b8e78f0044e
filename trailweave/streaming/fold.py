"""Ordered folds: a step over the rows of each session, with what it remembers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from trailweave.shipping import ship


def fold(frames: DataFrame, key: str, order: str, columns: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """Runs ``step(memory, row) -> (memory, values)`` over each session's rows, by ``order``.

    Sessions are dealt by key and sorted by Spark, and rows stream through: a session of any length
    takes the memory of one Arrow batch. ``out`` is the schema of key and values.
    """
    ship(frames.sparkSession)
    names = names_of(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, last, begun = None, None, False
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                k = row[0]
                if not begun or not (k == last or (pd.isna(k) and pd.isna(last))):
                    memory, last, begun = start(), k, True
                memory, values = step(memory, row)
                rows.append((k, *values))
            yield pd.DataFrame(rows, columns=names)

    chosen = list(dict.fromkeys([key, order, *columns]))
    # A number of partitions, so that few bytes with much to do aren't put into one task.
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.select(*chosen).repartition(n, key).sortWithinPartitions(key, order).mapInPandas(run, out)


def names_of(schema: str) -> list[str]:
    """Column names of a schema text, whose types may hold commas."""
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out
