"""Token usage and cost: price matching, totals, rankings, composition, period comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import model_key

PARTS = ("input", "output", "cache_read", "cache_write")


def match_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """model -> price row: the same name, else the same normalised name, else the closest name that continues the
    other at one of - _ . : ; ties go to the first price. Both sides are distinct names, not usage rows."""
    m = models.select("model").distinct().where("model is not null").withColumn("_m", model_key(F.col("model")))
    p = prices.withColumn("_p", model_key(F.col("name")))
    follows = lambda a, b: F.startswith(a, b) & F.substring(a, 1, 10_000).substr(
        F.length(b) + 1, F.lit(1)
    ).isin("-", "_", ".", ":")
    rank = F.when(F.col("model") == F.col("name"), 0).when(F.col("_m") == F.col("_p"), 1).when(
        follows(F.col("_m"), F.col("_p")) | follows(F.col("_p"), F.col("_m")), 2
    )
    # a price list is a small dimension; the first letters of the names must agree in every kind of match
    pairs = m.withColumn("_k", F.substring("_m", 1, 1)).join(
        p.withColumn("_k", F.substring("_p", 1, 1)), "_k"
    ).withColumn("_rank", rank).where("_rank is not null")
    best = F.row_number().over(
        Window.partitionBy("model").orderBy("_rank", F.abs(F.length("_m") - F.length("_p")), "ordinal")
    )
    return pairs.withColumn("_best", best).where("_best = 1").select("model", "name", *(f"price_{x}" for x in PARTS))


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with cost (0 where no price matches) and priced_as. Costs are exact decimals, so that sums do not
    depend on their order; prices count to six places."""
    found = match_prices(rows, prices)
    parts = [F.col(x).cast("decimal(15,0)") * F.col(f"price_{x}").cast("decimal(10,6)") for x in PARTS]
    cost = reduce(lambda a, b: a + b, parts) * F.expr("cast(0.000001 as decimal(7,6))")
    return rows.join(found, "model", "left").withColumn(
        "cost", F.coalesce(cost, F.lit(0).cast("decimal(1,0)"))
    ).withColumnRenamed("name", "priced_as").drop(*(f"price_{x}" for x in PARTS))


def cells(rows: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens summed by `keys` and model, then priced: cost is linear in tokens, so prices meet the few sums and not
    the rows."""
    return priced(rows.groupBy(*dict.fromkeys([*keys, "model"])).agg(*_sums()), prices)


def _tokens() -> Column:
    return reduce(lambda a, b: a + b, [F.col(x) for x in PARTS])


def _sums() -> list[Column]:
    return [F.sum(x).cast("long").alias(x) for x in PARTS]


def total(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Sums over all usage rows, distinct sessions, and the cost of the sums by model."""
    cost = cells(rows, prices, []).agg(F.round(F.sum("cost"), 4).cast("double").alias("cost"))
    # two rows, one each
    return rows.agg(*_sums(), F.countDistinct("session").alias("sessions")).join(F.broadcast(cost))


def by(rows: DataFrame, key: str) -> DataFrame:
    """Sums by a key; an empty or null key is `unknown`."""
    name = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("unknown"))
    return rows.groupBy(name.alias(key)).agg(*_sums(), F.round(F.sum("cost"), 6).cast("double").alias("cost"))


def top_by_cost(rows: DataFrame, key: str, k: int = 15) -> DataFrame:
    return by(rows, key).withColumn("tokens", _tokens()).orderBy(F.desc("cost"), F.desc("tokens"), key).limit(k)


def unpriced_models(rows: DataFrame, k: int = 20) -> DataFrame:
    return rows.where("priced_as is null and model is not null").select("model").distinct().orderBy("model").limit(k)


def grouping_sets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The total and every single-key breakdown in one pass: `grouped_by` names the key (`total` for the total), `name`
    is its value; an empty or null value is `unknown`."""
    named = rows.select(
        *(F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("unknown")).alias(k) for k in keys), *PARTS, "cost"
    )
    sets = named.groupingSets([[], *([F.col(k)] for k in keys)], *(F.col(k) for k in keys))
    out = sets.agg(*_sums(), F.round(F.sum("cost"), 6).cast("double").alias("cost"))
    key = F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys), F.lit("total"))
    return out.select(key.alias("grouped_by"), F.coalesce(*keys).alias("name"), *PARTS, "cost")


def dominant_model(rows: DataFrame, session: str) -> DataFrame:
    """The model of most tokens in each session; the first seen wins a tie."""
    t = rows.groupBy(session, "model").agg(F.sum(_tokens()).alias("t"), F.min("first_at").alias("at"))
    return t.groupBy(session).agg(
        F.max_by("model", F.struct("t", (-F.col("at")).alias("early"))).alias("model"),
        F.max("t").cast("long").alias("tokens")
    )


def period_delta(rows: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Measures of the last `days` days and of the window before it: [now - days, inf) and [now - 2 days, now - days)."""
    start, before = F.expr(f"timestamp'{now}' - interval {days} days"), F.expr(
        f"timestamp'{now}' - interval {2 * days} days"
    )
    cur, prev = F.col(at) >= start, (F.col(at) >= before) & (F.col(at) < start)
    tokens = _tokens()
    out = []
    for name, where in (("current", cur), ("previous", prev)):
        out += [
            F.count(F.when(where, 1)).alias(f"{name}_rows"),
            F.coalesce(F.sum(F.when(where, tokens)), F.lit(0)).cast("long").alias(f"{name}_tokens"),
            F.coalesce(F.round(F.sum(F.when(where, F.col("cost"))), 6).cast("double"), F.lit(0.0)).alias(f"{name}_cost")
        ]
    return rows.agg(*out)


def composition(rows: DataFrame) -> DataFrame:
    """Each kind of token with its share of all."""
    sums = rows.agg(*_sums()).unpivot([], list(PARTS), "part", "tokens")
    return sums.withColumn("pct", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()) * 100, 4))


def cost_table(rows: DataFrame, k: int = 5) -> DataFrame:
    """Cost by normalised name of the models that have a price; the dearest first."""
    sums = rows.where("priced_as is not null").groupBy(model_key(F.col("model")).alias("model"))
    out = sums.agg(
        F.round(F.sum("cost"), 6).cast("double").alias("cost"), F.sum(_tokens()).cast("long").alias("tokens")
    )
    return out.orderBy(F.desc("cost"), "model").limit(k)


def unpriced_summary(rows: DataFrame) -> DataFrame:
    none = F.col("priced_as").isNull() & F.col("model").isNotNull()
    tokens = F.coalesce(F.sum(F.when(none, _tokens())), F.lit(0)).cast("long")
    return rows.agg(F.countDistinct(F.when(none, F.col("model"))).alias("models"), tokens.alias("tokens"))
