"""Requests dealt to minutes by a token budget and stopped at a spending cap, offline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.session import cut


def running_sums(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its value over all rows before in the order; nulls count as 0.

    Ranges of the sorted rows are summed up apart, and each is shifted by the sums of the ranges before it, one row a
    range, so that no task sees all rows. The order must tell rows apart; of rows that it doesn't, any comes first.
    """
    names = list(values)
    own = df.withColumns({f"__v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    parts = cut(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
    totals = parts.groupBy("__p").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("__p", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in names])  # one row a range
    inside = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumns({f"__b_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in names}).join(F.broadcast(shifts), "__p")
    return summed.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__s_{n}")).alias(n) for n in names])


def schedule(requests: DataFrame, order: list[str], tokens: Column, cost: Column, per_minute: int, cap: int) -> DataFrame:
    """Adds tokens_before, cost_before, minute and sent to each request.

    A request goes in the minute in which the tokens of those before it leave room: tokens before, divided by those of a
    minute. It is sent if what was spent before it is below the cap; so the one that reaches the cap is the last. Tokens and
    cost are whole numbers (cost in the smallest unit), null ones count as 0. An empty table gives an empty one.
    """
    if per_minute < 1:
        raise ValueError("per_minute must be 1 or more")
    out = running_sums(requests, order, {"tokens_before": tokens.cast("long"), "cost_before": cost.cast("long")})
    return out.withColumns({"minute": F.floor(F.col("tokens_before") / per_minute), "sent": F.col("cost_before") < cap})


def slots(scheduled: DataFrame, tokens: Column, cost: Column) -> DataFrame:
    """(minute, requests, tokens, cost) of what is sent."""
    return scheduled.where("sent").groupBy("minute").agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens.cast("long")).alias("tokens"), F.sum(cost.cast("long")).alias("cost"))
