"""Connected components of slim edge tables, and folds of components in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b), which are of one orderable type: the smallest node of each component.

    Every round hangs each node and its neighbours on the smallest of them, first those that are larger than
    the node and then the others; the longest way to a component's smallest node shrinks by about half, so rounds grow with the
    logarithm of the longest way. Hot nodes are grouped minima and joins, which adaptive execution splits.
    """
    up = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph")
    while True:
        both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "graph-least")
        large = written(both.where("b > a").join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "graph-large")
        root = written(large.groupBy("a").agg(F.min("b").alias("m")), "graph-least")
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        after = written(root.select("a", F.col("m").alias("b")).unionByName(small).where("a <> b").distinct(), "graph")
        if after.count() == up.count() and after.exceptAll(up).isEmpty():
            break
        up = after
    tops = up.select("b").distinct()
    return up.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(tops.join(up.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), F.col("b").alias("component")))


def folded(rows: DataFrame, component: str, order: list[Column], fold: Callable, returns: str, columns: list[str] | None = None) -> DataFrame:
    """Each component's rows in ``order``, streamed through ``fold``.

    ``fold()`` starts a component: it gives a function that takes one row as a tuple of ``columns`` (all but the component's if None) and
    returns the rows that it makes. One task has a component's rows, a batch at a time, beside what the fold remembers.
    """
    columns = columns or [c for c in rows.columns if c != component]
    names = [c.split()[0] for c in returns.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for pdf in batches:
            out: list[tuple] = []
            for key, row in zip(pdf[component].tolist(), pdf[columns].itertuples(index=False, name=None)):
                if step is None or key != now:
                    now, step = key, fold()
                out += step(row)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(component).sortWithinPartitions(component, *order).select(component, *columns).mapInPandas(of, returns)
