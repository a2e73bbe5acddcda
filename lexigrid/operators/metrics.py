"""Classification metrics over true and predicted labels; nulls count as ``-``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, true: str = "true_label", pred: str = "pred_label", group: str | None = None, weight: str | None = None) -> DataFrame:
    """(group,) t, p, n: rows of each pair, where a row stands for ``weight`` rows. All metrics are made from this small table."""
    keys = [F.col(group).alias("grp")] if group else []
    return df.where(F.col(group).isNotNull() if group else F.lit(True)).groupBy(*keys, F.coalesce(true, F.lit("-")).alias("t"), F.coalesce(pred, F.lit("-")).alias("p")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def per_class(df: DataFrame, true: str = "true_label", pred: str = "pred_label", group: str | None = None, weight: str | None = None) -> DataFrame:
    """Support, predicted, tp, precision, recall and f1 of every label that either column has; 0 for a zero divisor."""
    c = counts(df, true, pred, group, weight)
    g = ["grp"] if group else []
    side = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))))
    k = c.select(*g, side.alias("x")).groupBy(*g, "x.label").agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), F.sum("x.tp").alias("tp"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return k.withColumns({"precision": div(F.col("tp"), F.col("predicted")), "recall": div(F.col("tp"), F.col("support")), "f1": div(2 * F.col("tp"), F.col("predicted") + F.col("support"))})


def report(df: DataFrame, true: str = "true_label", pred: str = "pred_label", group: str | None = None, weight: str | None = None) -> DataFrame:
    """Accuracy, and macro and weighted means, over all rows or in each group (§2.14)."""
    k = per_class(df, true, pred, group, weight)
    total = F.sum("support")
    mean = lambda c: F.round(F.avg(c), 6)
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / total, 6)
    aggs = [total.alias("rows"), F.count("*").alias("labels"), F.round(F.sum("tp") / total, 6).alias("accuracy")]
    aggs += [f(c).alias(f"{name}_{c}") for name, f in (("macro", mean), ("weighted", weighted)) for c in ("precision", "recall", "f1")]
    return k.groupBy("grp").agg(*aggs) if group else k.agg(*aggs)


def confusion(df: DataFrame, true: str = "true_label", pred: str = "pred_label", least_percent: float = 0.0) -> DataFrame:
    """A12, long form: t, p, n, share of t's rows. Predicted-only labels need ``least_percent`` of all predictions."""
    c = counts(df, true, pred)
    keep = predicted_only(df, true, pred, least_percent).where("not included").select("p")
    c = c.join(keep, "p", "left_anti")
    return c.select("t", "p", "n", F.round(F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("t"))), F.lit(0.0)), 6).alias("share"))


def confusion_matrix(df: DataFrame, true: str = "true_label", pred: str = "pred_label", least_percent: float = 0.0) -> DataFrame:
    """A12, wide form: one row a true label, one column a predicted label, 0 where no row is."""
    return confusion(df, true, pred, least_percent).groupBy("t").pivot("p").agg(F.first("share")).na.fill(0.0)


def predicted_only(df: DataFrame, true: str = "true_label", pred: str = "pred_label", least_percent: float = 0.0) -> DataFrame:
    """A13, U3s: labels that are predicted but never true, with their share of all predictions."""
    c = counts(df, true, pred)
    total = c.agg(F.sum("n").alias("total"))
    only = c.groupBy("p").agg(F.sum("n").alias("n")).join(c.select(F.col("t").alias("p")).distinct(), "p", "left_anti").crossJoin(F.broadcast(total))
    share = F.round(F.col("n") * 100.0 / F.col("total"), 2)
    return only.select("p", "n", share.alias("percent"), (share >= least_percent).alias("included"))


def distribution(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """How often each label is true and predicted, 0 if never; order by desc(total), label for a top list."""
    c = counts(df, true, pred)
    a = c.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("true_n"))
    b = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("pred_n"))
    z = lambda x: F.coalesce(x, F.lit(0))
    return a.join(b, "label", "full").select("label", z("true_n").alias("true_n"), z("pred_n").alias("pred_n"), (z("true_n") + z("pred_n")).alias("total"))


def disagreement(df: DataFrame, true: str, first: str, second: str) -> DataFrame:
    """Rows where two predictions differ, and which of them is right there."""
    differ = ~F.col(first).eqNullSafe(F.col(second))
    return df.agg(
        F.count("*").alias("rows"), F.count_if(differ).alias("differ"), F.count_if(differ & F.col(first).eqNullSafe(F.col(true))).alias("first_right"),
        F.count_if(differ & F.col(second).eqNullSafe(F.col(true))).alias("second_right"),
    )


def examples(df: DataFrame, n: int, correct: bool | None, order: str = "ord", true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """The first n rows that are right, wrong, or either."""
    ok = F.col(true).eqNullSafe(F.col(pred))
    return df.where(F.lit(True) if correct is None else ok if correct else ~ok).orderBy(order).limit(n)


def slice_of(df: DataFrame, true_value: str, pred_value: str, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """F11."""
    return df.where((F.col(true) == true_value) & (F.col(pred) == pred_value))


def only_possible(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """neither side is ``other``. This conditions on the prediction, so scores over it rise by construction."""
    return df.where((F.col(true) != "other") & (F.col(pred) != "other"))


@dataclass(frozen=True)
class Metric:
    """A metric of one's own for ``evaluate_with``: partial states that add up, and the value that they give together.

    ``states`` names the states and their types, in SQL's words. ``update`` gets the true and the predicted labels of some
    rows of one group, as arrays of text, and gives one number a state; Spark adds those of all tasks up. ``value`` is a
    column over the states' names.
    """

    name: str
    states: dict[str, str]
    update: Callable[[np.ndarray, np.ndarray], tuple]
    value: Column


def evaluate_with(df: DataFrame, metrics: list[Metric], true: str = "true_label", pred: str = "pred_label", group: str | None = None) -> DataFrame:
    """M4, M5 with metrics of one's own: one row, or one a group, with a column for each metric; nulls count as ``-``.

    Each task gives one row of states a batch and group, whatever the number of rows; these are added up and put into
    the values. Rows whose group is null are left out. Without rows the states are null, as are values made of them.
    """
    names = [f"{m.name}_{s}" for m in metrics for s in m.states]
    if len(set(names)) < len(names):
        raise ValueError("two metrics have the same name and state")
    g = [F.col(group).alias("grp")] if group else []
    rows = df.where(F.col(group).isNotNull() if group else F.lit(True)).select(*g, F.coalesce(F.col(true).cast("string"), F.lit("-")).alias("t"), F.coalesce(F.col(pred).cast("string"), F.lit("-")).alias("p"))

    updates = [m.update for m in metrics]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, p = (np.array(batch.column(c).to_pylist(), object) for c in ("t", "p"))
            keys = batch.column("grp").dictionary_encode() if group else None
            of = keys.indices.to_numpy(zero_copy_only=False) if group else np.zeros(len(t), np.int64)
            found = [[x for update in updates for x in update(t[of == k], p[of == k])] for k in range(len(keys.dictionary) if group else 1)]
            columns = [pa.array(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*([keys.dictionary] if group else []), *columns], names=[*(["grp"] if group else []), *names])

    kinds = ", ".join([*([f"grp {rows.schema['grp'].dataType.simpleString()}"] if group else []), *[f"`{m.name}_{s}` {k}" for m in metrics for s, k in m.states.items()]])
    summed = rows.mapInArrow(run, kinds).groupBy(*(["grp"] if group else [])).agg(*[F.sum(n).alias(n) for n in names])
    for m in metrics:  # a metric sees its states by their own names
        own = summed.withColumns({s: F.col(f"{m.name}_{s}") for s in m.states}).withColumn(f"__{m.name}", m.value)
        summed = own.drop(*m.states)
    return summed.select(*(["grp"] if group else []), *[F.col(f"__{m.name}").alias(m.name) for m in metrics])
