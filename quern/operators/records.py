"""State records: recovery, metadata, history, batch outcomes, deltas on the side of a consumer, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import merged_metadata


def recovered(plans: DataFrame, now_ms: int) -> DataFrame:
    """Plans that were under way when the engine stopped have failed."""
    cut = F.col("status").isin("queued", "applying")
    return plans.withColumns(
        {
            "status": F.when(cut, "failed").otherwise(F.col("status")),
            "error_type": F.when(cut, "EngineRestarted").otherwise(F.col("error_type")),
            "updated_at": F.when(cut, F.lit(now_ms)).otherwise(F.col("updated_at"))
        }
    )


def expired(plans: DataFrame, now_ms: int, ttl_ms: int = 600_000) -> DataFrame:
    """Plans that nobody ran within their time."""
    late = (F.col("status") == "planned") & (F.col("created_at") + ttl_ms <= now_ms)
    return plans.withColumns(
        {
            "status": F.when(late, "expired").otherwise(F.col("status")),
            "updated_at": F.when(late, F.lit(now_ms)).otherwise(F.col("updated_at"))
        }
    )


def patched_metadata(current: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata (a map of JSON texts) after its patches; an entry that becomes empty goes."""
    none = F.create_map().cast("map<string,string>")
    out = current.withColumnRenamed("entry", "_old").join(
        patches.withColumnRenamed("entry", "_patch"), keys, "full_outer"
    )
    entry = merged_metadata(F.coalesce("_old", none), F.coalesce("_patch", none))
    return out.select(*keys, entry.alias("entry")).where(F.size("entry") > 0)


def history_page(entries: DataFrame, limit: int = 200) -> DataFrame:
    """The latest entries first."""
    return entries.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def batch_outcomes(asked: DataFrame, rows: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome of each asked deletion: skipped with its cause (not_found, revision_changed, pinned, archived, tagged),
    failed with the error, or succeeded. Asked: keys, revision; rows: keys, current, cause; failures: keys, error."""
    out = asked.join(rows, keys, "left").join(failures, keys, "left")
    cause = F.when(F.col("current").isNull(), "not_found").when(
        F.col("current") != F.col("revision"), "revision_changed"
    ).otherwise(F.col("cause"))
    outcome = F.when(cause.isNotNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("succeeded")
    return out.select(*keys, outcome.alias("outcome"), F.coalesce(cause, F.col("error")).alias("reason"))


def audit(plans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per plan: how many of its rows succeeded, were skipped, failed."""
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("succeeded", "skipped", "failed")]
    return plans.join(
        outcomes.groupBy("plan_id").agg(*counts), "plan_id", "left"
    ).fillna(0, ["succeeded", "skipped", "failed"])


def applied(
    view: DataFrame, upserts: DataFrame, removals: DataFrame, keys: list[str], have: int, generation: int
) -> DataFrame:
    """A consumer's view after a delta. A delta that is already there changes nothing; after a gap the view is wrong,
    so ValueError asks for a full reload."""
    if generation <= have:
        return view
    if generation != have + 1:
        raise ValueError(f"generation {generation} does not follow {have}: reload")
    gone = removals.select(*keys).unionByName(upserts.select(*keys)).distinct()
    return view.join(gone, keys, "left_anti").unionByName(upserts)


def with_prior(scanned: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a scan; where the scan could not read a row (`readable` is false), the row known before."""
    columns = [c for c in prior.columns if c not in keys]
    old = prior.select(*keys, F.struct(*columns).alias("_old"))
    out = scanned.join(old, keys, "left")
    value = lambda c: F.when(F.col("readable") | F.col("_old").isNull(), F.col(c)).otherwise(F.col("_old")[c]).alias(c)
    return out.where("readable or _old is not null").select(*keys, *(value(c) for c in columns))


def evicted(index: DataFrame, active: DataFrame, keys: list[str], tools: list[str]) -> DataFrame:
    """Index rows of the scanned tools that are no longer active; rows of other tools were not looked at."""
    return index.where(F.col("tool").isin(*tools)).join(active.select(*keys), keys, "left_anti")


def cached_scan(cache: DataFrame, found: DataFrame) -> DataFrame:
    """A scan cache after new results: per path the row of the newest modification, the later of equals."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    columns = [c for c in cache.columns if c != "path"]
    newest = F.max_by(F.struct(*columns), F.struct("modified_ms", "_new")).alias("r")
    return both.groupBy("path").agg(newest).select("path", "r.*")


def price_list(catalog: DataFrame) -> DataFrame:
    """Prices of a provider catalog in JSON (provider -> models -> model -> cost), the first provider's price of a model."""
    provider = "struct<models:map<string,struct<cost:struct<input:double,output:double,cache_read:double,cache_write:double>>>>"
    rows = catalog.select(F.posexplode(F.from_json("json", f"map<string,{provider}>")).alias("_p", "provider", "v"))
    rows = rows.select("_p", "provider", F.explode("v.models").alias("name", "m")).where("m.cost is not null")
    first = rows.groupBy("name").agg(F.min_by("m", "_p").alias("m"), F.min("_p").alias("ordinal"))
    cost = lambda c: F.coalesce(F.col(f"m.cost.{c}"), F.lit(0.0)).alias(f"price_{c}")
    return first.select("name", *(cost(c) for c in ("input", "output", "cache_read", "cache_write")), "ordinal")


def model_list(discovered: DataFrame, own: DataFrame) -> DataFrame:
    """Models of discovery, then of the user's list; the first of an id wins."""
    both = discovered.withColumn("_source", F.lit(0)).unionByName(own.withColumn("_source", F.lit(1)))
    w = Window.partitionBy("id").orderBy("_source", "ordinal")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def turn_start(tool: str, role: Column, kind: Column, text: Column) -> Column:
    """Whether a record starts a turn in its format: a user's words, not results or what the tool itself put there."""
    said = (role == "user") & F.coalesce(kind, F.lit("text")).isin("text", "image")
    if tool == "claude":
        return said & ~F.startswith(F.ltrim(text), F.lit("<"))
    if tool == "codex":
        return said & ~F.startswith(F.ltrim(text), F.lit("<")) & ~F.startswith(F.ltrim(text), F.lit("["))
    return said


def progress(sources: DataFrame) -> DataFrame:
    """Processed and total files over all sources, and whether all are done."""
    done = F.sum("processed").cast("long").alias("processed"), F.sum("total").cast("long").alias("total")
    return sources.agg(*done).withColumn("complete", F.col("processed") >= F.col("total"))


def handle_log(log: DataFrame, active: DataFrame, generation: int) -> DataFrame:
    """Rows to append to a log of handles (tool, session, handle, generation, present): sessions that came, with the
    handle that they once had or a new one, and those that went, whose handle stays as a tombstone. `active` (tool,
    session) is what the generation holds; sessions that did not change get no row."""
    keys = ["tool", "session"]
    last = handles_as_of(log, generation).select(*keys, "handle", "present")
    now = active.select(*keys).distinct().withColumn("_now", F.lit(True))
    both = last.join(now, keys, "full_outer").withColumn("_now", F.coalesce("_now", F.lit(False)))
    changed = both.where(F.coalesce("present", F.lit(False)) != F.col("_now"))
    handle = F.coalesce("handle", F.sha2(F.concat("tool", F.lit("\0"), "session"), 256))
    return changed.select(
        *keys, handle.alias("handle"), F.lit(generation).cast("int").alias("generation"), F.col("_now").alias("present")
    )


def handles_as_of(log: DataFrame, generation: int) -> DataFrame:
    """Handles as a generation saw them: (tool, session, handle, present, since), tombstones included."""
    known = log.where(F.col("generation") <= generation).groupBy("tool", "session")
    newest = known.agg(F.max_by(F.struct("handle", "present", "generation"), "generation").alias("r"))
    return newest.select("tool", "session", "r.handle", "r.present", F.col("r.generation").alias("since"))
