"""Functions of whole groups, many small groups to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def each_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], one: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str | StructType) -> DataFrame:
    """one(rows) of every group, its rows in order, put together.

    Groups go to tasks by their keys and are cut from sorted batches, so that thousands of
    small ones cost a few calls and not one each; a group that spans batches is held until it ends.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            made = []
            for a, b in _spans(rows, keys):
                found = one(rows.iloc[a:b].reset_index(drop=True))
                if found is not None and len(found):
                    made.append(found)
            if made:
                yield pd.concat(made, ignore_index=True)

        for batch in batches:
            if not len(batch):
                continue
            start = _spans(batch, keys)[-1][0]
            if held and (start or not _same(held[-1], batch, keys)):
                # What is held ends within this batch, or before it.
                first = _spans(batch, keys)[0][1] if _same(held[-1], batch, keys) else 0
                yield from out(pd.concat([*held, batch.iloc[:first]], ignore_index=True))
                if start > first:
                    yield from out(batch.iloc[first:start])
                held = [batch.iloc[start:]]
            elif held:
                held.append(batch)
            else:
                if start:
                    yield from out(batch.iloc[:start])
                held = [batch.iloc[start:]]
        if held:
            yield from out(pd.concat(held, ignore_index=True))

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def _spans(rows: pd.DataFrame, keys: Sequence[str]) -> list[tuple[int, int]]:
    """First and end of each run of equal keys; nulls are equal."""
    change = np.zeros(len(rows), bool)
    change[0] = True
    for k in keys:
        codes = pd.factorize(rows[k])[0]
        change[1:] |= codes[1:] != codes[:-1]
    heads = np.flatnonzero(change)
    return list(zip(heads.tolist(), [*heads[1:].tolist(), len(rows)]))


def _same(a: pd.DataFrame, b: pd.DataFrame, keys: Sequence[str]) -> bool:
    """Whether the last row of one and the first of the other belong to one group."""
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in ((a[k].iloc[-1], b[k].iloc[0]) for k in keys))
