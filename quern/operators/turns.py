"""Ordinal semantics of messages: turns, rounds, spans, pages, chunks, call pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(session: str, order: str) -> Column:
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)


def turn_numbers(messages: DataFrame, session: str, order: str) -> DataFrame:
    """message: position from 1; turn_no: user messages so far, 0 before the first."""
    return messages.withColumn(
        "message", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long")
    ).withColumn("turn_no", _running(session, order).cast("long"))


def round_numbers(messages: DataFrame, session: str, order: str) -> DataFrame:
    """Like turns, but what comes before the first user message belongs to round 1."""
    return messages.withColumn("round_no", F.greatest(F.lit(1), _running(session, order)).cast("long"))


def turn_spans(messages: DataFrame, session: str, order: str) -> DataFrame:
    """[start, end) of each turn by message position (from 0)."""
    w = Window.partitionBy(session)
    at = messages.select(
        session,
        (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("start"),
        "role",
        F.count(F.lit(1)).over(w).alias("n")
    )
    users = at.where("role = 'user'")
    return users.select(
        session,
        "start",
        F.coalesce(F.lead("start").over(Window.partitionBy(session).orderBy("start")), "n").cast("long").alias("end")
    )


def page_ends(messages: DataFrame, session: str, order: str, limit: int) -> DataFrame:
    """Where a first page of `limit` messages ends so that it never splits a turn."""
    at = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    stop = F.min(F.when((F.col("role") == "user") & (F.col("_at") >= limit), F.col("_at")))
    return messages.withColumn("_at", at).groupBy(session).agg(
        F.coalesce(stop, F.count(F.lit(1))).cast("long").alias("page_end")
    )


def merge_chunks(rows: DataFrame, session: str, order: str, kind: str, text: str) -> DataFrame:
    """Adjacent rows of one kind become one: the islands of equal `kind` in order."""
    w = Window.partitionBy(session).orderBy(order)
    change = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)
    marked = rows.withColumn("_change", change).withColumn(
        "chunk", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return marked.groupBy(session, "chunk").agg(
        F.first(kind).alias(kind),
        F.count(F.lit(1)).alias("parts"),
        F.array_join(F.transform(ordered, lambda x: x[text]), "\n").alias(text)
    )


def pair_calls(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing of calls and results: paired, unpaired_call or orphan_result. The n-th call of a key
    meets its n-th result, so each is consumed once."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
    a = calls.withColumn("nth", nth).withColumnRenamed("ordinal", "call_at")
    b = results.withColumn("nth", nth).withColumnRenamed("ordinal", "result_at")
    state = F.when(
        F.col("result_at").isNull(), "unpaired_call"
    ).when(F.col("call_at").isNull(), "orphan_result").otherwise("paired")
    return a.join(b, [*keys, "nth"], "full_outer").withColumn("state", state)


def byte_budget(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose texts fit the budget in bytes; the first row always stays."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used_bytes", F.sum(F.octet_length(text)).over(w).cast("long")).withColumn(
        "_n", F.row_number().over(Window.partitionBy(group).orderBy(order))
    ).where((F.col("used_bytes") <= budget) | (F.col("_n") == 1)).drop("_n")


def strictly_increasing(rows: DataFrame, group: str, order: str, ts: str) -> DataFrame:
    """The least strictly increasing sequence that is nowhere below `ts`: a running maximum of ts - position."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_n", n).withColumn(ts, F.max(F.col(ts) - F.col("_n")).over(w) + F.col("_n")).drop("_n")


def pending_owner(rows: DataFrame, session: str, order: str) -> DataFrame:
    """Buffered rows (role null) belong to the next assistant message before the next user message."""
    ahead = Window.partitionBy(session).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nxt = lambda role: F.min(F.when(F.col("role") == role, F.col(order))).over(ahead)
    owner = F.when(nxt("user").isNull() | (nxt("assistant") < nxt("user")), nxt("assistant"))
    return rows.withColumn("owner", owner)


def page(messages: DataFrame, session: str, order: str, text: str, start: int, limit: int, budget: int) -> DataFrame:
    """One page of each session from message `start` (from 0): at most `limit` messages and `budget` bytes of text, at
    least one message, with the cursor of the next page (null at the end)."""
    w = Window.partitionBy(session)
    at = messages.withColumn(
        "_at", F.row_number().over(w.orderBy(order)) - 1
    ).withColumn("_n", F.count(F.lit(1)).over(w))
    rest = at.where((F.col("_at") >= start) & (F.col("_at") < start + limit)).withColumnRenamed("_n", "_total")
    fits = byte_budget(rest, session, "_at", text, budget).withColumn("_last", F.max("_at").over(w))
    cursor = F.when(F.col("_last") + 1 < F.col("_total"), (F.col("_last") + 1).cast("long"))
    return fits.withColumn("next_message", cursor).drop("_at", "_last", "_total")


def keep_rounds(messages: DataFrame, session: str, order: str, rounds: int) -> DataFrame:
    """The messages of the first `rounds` rounds."""
    return round_numbers(messages, session, order).where(F.col("round_no") <= rounds).drop("round_no")
