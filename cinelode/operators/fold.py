"""Many small groups through Python without a call of the framework for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def stream_groups(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``solve`` to the rows (tuples in the order of ``df.columns``) of each group, sorted by ``order``.

    Groups are hash-partitioned and stream through sorted partitions; only one group is held at a time.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for pdf in batches:
            for row in zip(*[pdf[c] for c in columns], strict=True):
                k = tuple(row[i] for i in at)
                if k != key:
                    if held:
                        out += solve(held)
                    key, held = k, []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            out += solve(held)
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def stream_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple | None], schema: str) -> DataFrame:
    """Apply ``step`` to a state made by ``start`` and each row (tuple in the order of ``df.columns``) of a group, sorted by ``order``; it gives a result row or None.

    Like :func:`stream_groups`, but only the state of one group is held, not its rows. NULL keys make a group.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c] for c in columns], strict=True):
                k = tuple(None if row[i] != row[i] else row[i] for i in at)  # NULL may come as NaN, which equals nothing
                if state is None or k != key:
                    key, state = k, start()
                if (made := step(state, row)) is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Scan:
    """A fold that gives rows late: ``take`` a row and give what is finished, ``end`` with the rest."""

    def take(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def stream_scan(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Scan], schema: str) -> DataFrame:
    """Feed the rows (tuples in the order of ``df.columns``) of each group, sorted by ``order``, to a :class:`Scan` of its own.

    Only a scan's own state is held, not its rows. NULL keys make a group.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, scan, out = None, None, []
        for pdf in batches:
            for row in zip(*[pdf[c] for c in columns], strict=True):
                k = tuple(None if row[i] != row[i] else row[i] for i in at)
                if scan is None or k != key:
                    if scan is not None:
                        out += scan.end()
                    key, scan = k, start()
                out += scan.take(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if scan is not None and (out := scan.end()):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
