"""A stored index of message texts by character trigrams, kept up to date in generations.

A sync writes one generation: postings of the sessions that it indexes, counts of their trigrams, and last, as the mark
that the generation counts, a row for each session that it indexed, failed to read or removed. Readers take of each
session the newest row and only the postings of that generation, so nothing that is stored is ever changed. Postings lie
in folders by a hash of their trigram: a search reads the folders of its rarest trigrams alone. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import grams_of, text_grams
from .state import reconcile
from .topology import _durable

BUCKETS = 64
#: Trigrams of a term that are looked up, the rarest ones; what they find is verified on the texts.
RAREST = 4
POSTINGS = "gram string, session string, message long, generation int, bucket int"
COUNTS = "gram string, n long, generation int, bucket int"
SESSIONS = "tool string, session string, revision string, state string, messages long, chars long, generation int"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _stored(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def searched_text(messages: DataFrame, tool_outputs: bool = True) -> Column:
    """What a search of messages reads: the text, and the texts of tools behind it. No term spans the two."""
    parts = ["text", "tool_text"] if tool_outputs and "tool_text" in messages.columns else ["text"]
    return F.concat_ws("\0", *parts)


def live(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each session that was not removed: state is indexed, or failed for this revision."""
    rows = _stored(spark, path, "sessions", SESSIONS)
    newest = F.max_by(F.struct("revision", "state", "messages", "chars", "generation"), "generation").alias("r")
    return rows.groupBy("tool", "session").agg(newest).select("tool", "session", "r.*").where("state <> 'removed'")


def index_plan(current: DataFrame, stored: DataFrame, rows: int = 32, budget: int = 32 << 20) -> DataFrame:
    """What a sync of the content index does with each session: stale rows are removed, changed ones indexed now (the
    newest, up to `rows` sessions and `budget` bytes) or later. Keys are (tool, session)."""
    keys = ["tool", "session"]
    state = reconcile(current, stored, keys, "revision").join(current.select(*keys, "updated", "size"), keys, "left")
    wanted = state.where(F.col("state").isin("new", "changed"))
    first = wanted.orderBy(F.desc("updated"), *keys).limit(rows)
    used = F.sum(F.coalesce("size", F.lit(0))).over(
        Window.partitionBy().orderBy(F.desc("updated"), *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    now = first.withColumn("_used", used).where(F.col("_used") <= budget).select(  # at most `rows` rows
        *keys, F.lit("index_now").alias("_action")
    )
    action = F.when(F.col("state") == "same", "keep").when(F.col("state") == "missing", "remove").otherwise(
        F.coalesce("_action", F.lit("index_later"))
    )
    return state.join(now, keys, "left").select(*keys, action.alias("action"))


def sync(
    spark: SparkSession, path: str, current: DataFrame, messages: DataFrame, rows: int = 32, budget: int = 32 << 20
) -> DataFrame:
    """Brings the index towards `current` (tool, session, revision, updated, size, and readable, if some cannot be read)
    and returns what was done: (tool, session, action) with keep, remove, index_now, index_later or fail.

    Changed sessions are indexed, the newest first, up to `rows` of them and `budget` bytes; the others wait for the next
    sync. A session that cannot be read fails, and is not tried again before its revision changes. Messages: session,
    message, text and, if there, tool_text.
    """
    stored = live(spark, path)
    plan = index_plan(
        current.select("tool", "session", "revision", "updated", "size"),
        stored.select("tool", "session", "revision"),
        rows,
        budget
    )
    can = F.coalesce(F.col("readable"), F.lit(True)) if "readable" in current.columns else F.lit(True)
    state = current.select("tool", "session", "revision", can.alias("can"))
    plan = plan.join(state, ["tool", "session"], "left")
    plan = plan.withColumn(
        "action", F.when((F.col("action") == "index_now") & ~F.col("can"), "fail").otherwise(F.col("action"))
    )
    generation = 1 + (_stored(spark, path, "sessions", SESSIONS).agg(F.max("generation")).first()[0] or 0)
    plan = _durable(plan.select("tool", "session", "revision", "action"))
    now = [r.session for r in plan.where("action = 'index_now'").select("session").collect()]  # at most `rows`
    read = messages.where(F.col("session").isin(now)).select(
        "session", "message", searched_text(messages).alias("text")
    )
    postings = read.select(
        "session", "message", F.explode(text_grams(F.col("text"))).alias("gram")
    ).withColumn("bucket", _bucket(F.col("gram")))
    at = lambda table: f"{path}/{table}/generation={generation}"
    postings.repartition(
        "bucket", F.pmod(F.xxhash64("session"), F.lit(8))
    ).write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    made = spark.read.schema("gram string, session string, message long, bucket int").parquet(at("postings"))
    made.groupBy("bucket", "gram").agg(
        F.count(F.lit(1)).alias("n")
    ).write.mode("overwrite").partitionBy("bucket").parquet(at("grams"))
    sizes = read.groupBy("session").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).cast("long").alias("chars")
    )
    states = {"index_now": "indexed", "fail": "failed", "remove": "removed"}
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in states.items() for x in kv)), F.col("action"))
    done = plan.where(F.col("action").isin(*states)).join(sizes, "session", "left")
    done = done.select(
        "tool",
        "session",
        "revision",
        named.alias("state"),
        F.coalesce("messages", F.lit(0)).cast("long").alias("messages"),
        F.coalesce("chars", F.lit(0)).cast("long").alias("chars")
    )
    done.coalesce(1).write.mode("overwrite").parquet(at("sessions"))
    return plan.select("tool", "session", "action")


def rarest(spark: SparkSession, path: str, term: str) -> list[str]:
    """The RAREST trigrams of a term by what is stored, the rarest first; a term of fewer than three characters has none."""
    grams = grams_of([term])
    if not grams:
        return []
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(
        "gram", _bucket(F.col("gram")).alias("bucket")
    )
    wanted = {r.gram: r.bucket for r in wanted.collect()}
    counts = _stored(spark, path, "grams", COUNTS).where(
        F.col("bucket").isin(*set(wanted.values())) & F.col("gram").isin(grams)
    )
    n = {r.gram: r.n for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    return sorted(grams, key=lambda g: (n.get(g, 0), g))[:RAREST]


def lookup(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """(session, message) of indexed messages that may hold the term: all that do, and some that do not. None for a term
    that is too short to be looked up."""
    grams = rarest(spark, path, term)
    if not grams:
        return None
    buckets = [
        r[0] for r in spark.createDataFrame(
            [(g,) for g in grams], "gram string"
        ).select(_bucket(F.col("gram"))).distinct().collect()
    ]
    found = _stored(spark, path, "postings", POSTINGS).where(
        F.col("bucket").isin(*buckets) & F.col("gram").isin(*grams)
    )
    known = live(spark, path).where("state = 'indexed'").select("session", "generation")
    found = found.join(known, ["session", "generation"])
    return found.groupBy("session", "message").agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("n") == len(grams)).select("session", "message")


def holding(spark: SparkSession, path: str, literals: list[str]) -> DataFrame | None:
    """Indexed sessions whose messages may together hold every literal; None where none of them can be looked up."""
    found = [hits.select("session").distinct() for x in literals if (hits := lookup(spark, path, x)) is not None]
    out = found[0] if found else None
    for more in found[1:]:
        out = out.join(more, "session", "left_semi")
    return out
