"""Folds over the rows of a key in a stated order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold of the rows (tuples of the columns of df, missing values None) of each key, in order; its tuples make the rows of schema.

    One sort by key and order; a task goes through its keys one after another
    and holds the rows of one key at a time, so that many small keys cost no
    call each. An empty df gives no rows.
    """
    names = df.columns
    n = len(keys)
    rows = df.select(*keys, *(c for c in names if c not in keys))
    at = [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in schema.split(", ")]
        held: list[tuple] = []
        key = None
        for batch in batches:
            out: list[tuple] = []
            values = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in batch.columns]
            for row in zip(*values, strict=True):
                if row[:n] != key:
                    if held:
                        out += fold(held)
                    held, key = [], row[:n]
                held.append(tuple(row[i] for i in at))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(list(fold(held)), columns=columns)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
