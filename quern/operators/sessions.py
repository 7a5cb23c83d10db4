"""Sessions as a whole: search, pages, context state, the stored content index.

Sessions have (session, tool, title, dir, model, updated, size, count), messages (session, message, role, text,
tool_text), message being the position from 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import regex_snippet
from ..functions.text import bounded, contains, occurrences, query_terms, required_literals, snippet
from ..functions.validation import bounded_int, patterns, string_set, time_ms
from . import content_index
from .search import K1, B, all_terms, any_of, regex_span, sessions_to_scan
from .topology import _durable

SCOPES = ("any", "metadata", "content")
BUDGET_BYTES = 64 * 1024
SCAN_BYTES = 256 << 20


def restricted(
    sessions: DataFrame,
    agents: set[str] = frozenset(),
    projects: set[str] = frozenset(),
    start: int | None = None,
    end: int | None = None
) -> DataFrame:
    """Sessions of some tools, of some directories (case folded) and last changed in [start, end]; nothing asked for
    restricts nothing."""
    if agents:
        sessions = sessions.where(F.col("tool").isin(*sorted(agents)))
    if projects:
        sessions = sessions.where(F.lower("dir").isin(*sorted(p.lower() for p in projects)))
    if start is not None:
        sessions = sessions.where(F.col("updated") >= start)
    return sessions if end is None else sessions.where(F.col("updated") <= end)


def haystack() -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "dir", "tool", "model")))


def numbered(messages: DataFrame) -> DataFrame:
    w = Window.partitionBy("session").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("long"))


def group_score(rows: DataFrame, text: str, groups: list[list[str]], corpus: DataFrame | None = None) -> DataFrame:
    """`rows` that hold all terms of a group, with `score`, the best bm25 of a group that they hold. One pass for the
    counts of all terms, one row of statistics. `corpus` (one row: n, chars) stands for the size of all messages where
    `rows` are only those that may hold a term."""
    terms = sorted({t for g in groups for t in g})
    tf = {t: f"_tf{k}" for k, t in enumerate(terms)}
    counted = rows.select(
        "*",
        F.length(text).cast("double").alias("_size"),
        *(occurrences(F.col(text), t).alias(c) for t, c in tf.items())
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_size").alias("_avg"),
        *(F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}d") for c in tf.values())
    )
    if corpus is not None:
        stats = stats.drop("_n", "_avg").join(
            corpus.select(F.col("n").alias("_n"), (F.col("chars") / F.col("n")).alias("_avg"))
        )

    def part(t: str) -> Column:
        c, d = F.col(tf[t]), F.col(f"{tf[t]}d")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - d + 0.5) / (d + 0.5)))
        return idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("_size") / F.col("_avg")))

    def of(group: list[str]) -> Column:
        held = reduce(lambda a, b: a & b, [F.col(tf[t]) > 0 for t in group])
        return F.when(held, sum((part(t) for t in group), F.lit(0.0)))

    scores = [of(g) for g in groups]
    score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    # the statistics are one row
    out = counted.where(
        any_of([reduce(lambda a, b: a & b, [F.col(tf[t]) > 0 for t in g]) for g in groups])
    ).join(F.broadcast(stats))
    own = {"_size", "_n", "_avg", *tf.values(), *(f"{c}d" for c in tf.values())}
    return out.withColumn("score", score).drop(*(c for c in out.columns if c in own))


def content_hits(hits: DataFrame, rows: int = 3) -> DataFrame:
    """By session: number of hits, the best score, and the best `rows` hits (message, role, snippet)."""
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc_nulls_last("score"), "message"))
    item = F.struct("_place", "message", "role", "snippet")
    best = F.array_sort(F.collect_list(F.when(F.col("_place") <= rows, item)))
    counts = hits.withColumn("_place", place).groupBy("session").agg(
        F.count(F.lit(1)).alias("content_match_count"), F.max("score").alias("best_score"), best.alias("rows")
    )
    return counts.withColumn(
        "rows",
        F.transform(
            "rows",
            lambda r: F.struct(r["message"].alias("message"), r["role"].alias("role"), r["snippet"].alias("snippet"))
        )
    )


def of_sessions(messages: DataFrame, sessions: DataFrame, most: int = 1000) -> DataFrame:
    """Messages of these sessions: by a list in the scan's filter, which skips files and row groups, where there are
    `most` of them or fewer; else by a semi join."""
    ids = [r[0] for r in sessions.select("session").distinct().limit(most + 1).collect()]
    return messages.where(F.col("session").isin(*ids)) if len(ids) <= most else messages.join(
        sessions, "session", "left_semi"
    )


def _term_rows(
    asked: DataFrame, messages: DataFrame, groups: list[list[str]], index: str | None, text: Column
) -> tuple[DataFrame, DataFrame | None]:
    """(messages that may hold a term, with `_searched`; the size of all of them). Without an index, or with a term too
    short for it, these are all messages; with one, what the index finds and the sessions that it does not know."""
    spark = messages.sparkSession
    found = [content_index.lookup(spark, index, t) for t in sorted({t for g in groups for t in g})] if index else [None]
    if any(f is None for f in found):
        return messages.join(asked.select("session"), "session", "left_semi").withColumn("_searched", text), None
    known = content_index.live(spark, index).where("state = 'indexed'").join(
        asked.select("session"), "session", "left_semi"
    )
    hits = _durable(
        reduce(lambda a, b: a.unionByName(b), found).distinct().join(known.select("session"), "session", "left_semi")
    )
    unknown = asked.select("session").join(known.select("session"), "session", "left_anti")
    some = of_sessions(messages, hits).join(hits, ["session", "message"], "left_semi").withColumn("_searched", text)
    rest = of_sessions(messages, unknown).withColumn("_searched", text)
    sizes = known.select(F.col("messages").alias("n"), "chars").unionByName(
        rest.select(F.lit(1).cast("long").alias("n"), F.length("_searched").cast("long").alias("chars"))
    )
    return some.unionByName(rest), sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")
    )


def _regex_plan(asked: DataFrame, regex: str, index: str | None, budget: int | None) -> DataFrame:
    """session, state: which sessions a regular expression is tried on (see scan_plan). With an index only those that
    hold its literals, and those that the index does not know."""
    may, spark = None, asked.sparkSession
    if index and (literals := required_literals(regex)):
        known = content_index.live(spark, index).where("state = 'indexed'").select("session")
        if (held := content_index.holding(spark, index, literals)) is not None:
            may = held.unionByName(asked.select("session").join(known, "session", "left_anti"))
    if budget is None:
        ids = asked.select("session") if may is None else asked.select("session").join(may, "session", "left_semi")
        return ids.withColumn("state", F.lit("scanned"))
    return scan_plan(asked, may, budget).select("session", "state")


def search_sessions(
    sessions: DataFrame,
    messages: DataFrame,
    query: str = "",
    more: list[str] | None = None,
    regex: str | None = None,
    scope: str = "any",
    agents: list[str] | None = None,
    projects: list[str] | None = None,
    start=None,
    end=None,
    now_ms: int = 0,
    limit: int = 20,
    budget: int = BUDGET_BYTES,
    tool_outputs: bool = True,
    index: str | None = None,
    scan_bytes: int | None = None,
) -> DataFrame:
    """Sessions that the query hits, the best first: both kinds of hit, then content by score, then metadata; without
    content hits the newest first. Any of the patterns may hit, all terms of it in one message (or in the metadata);
    what tools said (tool_text, where there is one) is part of a message unless `tool_outputs` is false.

    Columns: place, session, tool, title, dir, updated, record_count, model, matched_in, content_match_count, rows (the
    best three hits), total_matches, has_more, and, of the scan of texts, scanned_sessions, skipped_sessions (beyond
    `scan_bytes`, the newest first; None for no bound) and unindexed_sessions. At most `limit` rows and `budget` bytes
    of them as JSON. With `index` (the path of a content index) only the messages that it finds are read, and those of
    sessions that it does not know; hits and scores are those of a scan.
    """
    limit = bounded_int(limit, 20, 1, 50, "limit")
    needles = patterns(query, more)
    if scope not in SCOPES or scope == "content" and not needles and not regex:
        raise ValueError(f"scope is one of {SCOPES}; content needs a query, patterns or a regular expression")
    if regex is not None and (needles or not 0 < len(regex) <= 500):
        raise ValueError("a regular expression has at most 500 characters and stands alone")
    spark = sessions.sparkSession
    asked = restricted(
        sessions,
        string_set(agents, "agents", 8, 32),
        string_set(projects, "projects", 50, 1024),
        time_ms(start, now_ms),
        time_ms(end, now_ms)
    )
    groups = [query_terms(n) or [n.lower()] for n in needles]
    has_needle, of_content = bool(groups or regex), bool(groups or regex) and scope != "metadata"
    sources = ["text", "tool_text"] if tool_outputs and "tool_text" in messages.columns else ["text"]
    metadata, hits, counts = F.lit(False), None, {"scanned": None, "skipped": 0}
    if regex:
        metadata = regex_span(haystack(), regex)["at"] > 0
        if of_content:
            plan = _durable(_regex_plan(asked, regex, index, scan_bytes))
            counts |= {r.state: r["count"] for r in plan.groupBy("state").count().collect()}
            said = of_sessions(messages, plan.where("state = 'scanned'"))
            for k, c in enumerate(sources):
                said = said.withColumn(f"_span{k}", regex_span(F.col(c), regex))
            windows = [regex_snippet(F.col(c), F.col(f"_span{k}")) for k, c in enumerate(sources)]
            hits = said.withColumn("snippet", F.coalesce(*windows)).where("snippet is not null").withColumn(
                "score", F.lit(None).cast("double")
            )
    elif groups:
        metadata = any_of([all_terms(haystack(), g) for g in groups])
        if of_content:
            said, corpus = _term_rows(
                asked, messages, groups, index, content_index.searched_text(messages, tool_outputs)
            )
            window = F.coalesce(
                *(F.when(contains(F.col(c), t), snippet(F.col(c), t)) for c in sources for g in groups for t in g)
            )
            hits = group_score(said, "_searched", groups, corpus).withColumn("snippet", window)
    out = asked.withColumn("metadata_hit", metadata)
    if of_content:
        found = content_hits(hits.withColumn("snippet", F.substring("snippet", 1, 320)))
        out = out.join(found, "session", "left")
    else:
        out = out.select(
            "*",
            *(
                F.lit(None).cast(t).alias(c) for c,
                t in (
                    ("content_match_count", "long"),
                    ("best_score", "double"),
                    ("rows", "array<struct<message:long,role:string,snippet:string>>")
                )
            )
        )
    content = F.col("content_match_count").isNotNull()
    wanted = {"any": F.col("metadata_hit") | content, "metadata": F.col("metadata_hit"), "content": content}[scope]
    rank = F.when(content & F.col("metadata_hit"), 0).when(content, 1).otherwise(2)
    # texts are read once: the page, its totals and its turns come from what is written here
    out = _durable((out.where(wanted) if has_needle else out).withColumn("_rank", rank))
    best = ["_rank", F.desc_nulls_last("best_score"), F.desc("updated"), "session"]
    page = out.orderBy(*best).limit(limit).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*best)))  # at most 50 rows
    page = _with_turns(page, messages)
    kinds = F.array_compact(F.array(F.when(F.col("metadata_hit"), "metadata"), F.when(content, "content")))
    title, model = bounded(F.col("title"), 200)[0], bounded(F.col("model"), 120)[0]
    page = page.select(
        "place",
        "session",
        "tool",
        title.alias("title"),
        "dir",
        "updated",
        F.col("count").alias("record_count"),
        model.alias("model"),
        kinds.alias("matched_in"),
        "content_match_count",
        "rows"
    )
    used = F.sum(F.octet_length(F.to_json(F.struct("*")))).over(
        Window.partitionBy().orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fits = page.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")
    total = out.count()
    returned = F.count(F.lit(1)).over(Window.partitionBy())  # at most 50 rows
    unknown = asked.select("session").join(
        content_index.live(spark, index).where("state = 'indexed'"), "session", "left_anti"
    ).count() if index else None
    fits = fits.withColumn("total_matches", F.lit(total).cast("long")).withColumn("has_more", F.lit(total) > returned)
    number = lambda n: F.lit(n).cast("long")
    return fits.select(
        "*",
        number(counts["scanned"]).alias("scanned_sessions"),
        number(counts["skipped"]).alias("skipped_sessions"),
        number(unknown).alias("unindexed_sessions")
    )


def _with_turns(page: DataFrame, messages: DataFrame) -> DataFrame:
    """The page (50 sessions at most) with the turns of its rows: only its sessions' messages are counted."""
    turns = numbered(of_sessions(messages, page.where("rows is not null"))).select("session", "message", "turn")
    flat = page.select("session", F.posexplode("rows").alias("pos", "r")).select(
        "session",
        "pos",
        F.col("r.message").alias("message"),
        F.col("r.role").alias("role"),
        F.col("r.snippet").alias("snippet")
    )
    flat = flat.join(turns, ["session", "message"])
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "message", "turn", "role", "snippet"))),
        lambda r: F.struct(
            r["message"].alias("message"),
            r["turn"].alias("turn"),
            r["role"].alias("role"),
            r["snippet"].alias("snippet")
        )
    )
    return page.drop("rows").join(flat.groupBy("session").agg(rows.alias("rows")), "session", "left")


def result_rows(found: DataFrame, most: int = 160) -> DataFrame:
    """Found sessions for a list of one line each: the best hit's snippet, cut."""
    best = F.get("rows", F.lit(0))
    kinds = F.when(F.size("matched_in") > 0, F.col("matched_in")).otherwise(F.array(F.lit("metadata")))
    return found.select(
        "place",
        "session",
        "tool",
        "title",
        "dir",
        "updated",
        kinds.alias("matched_in"),
        F.coalesce("content_match_count", F.lit(0)).cast("long").alias("match_count"),
        F.coalesce(F.substring(best["snippet"], 1, most), F.lit("")).alias("snippet"),
        best["message"].alias("message"),
        best["role"].alias("role")
    )


def scan_plan(sessions: DataFrame, candidates: DataFrame | None = None, budget: int = SCAN_BYTES) -> DataFrame:
    """Which sessions a scan of raw texts reads, the newest first within `budget` bytes (the first is read always):
    state is scanned, skipped or not_candidate. The running sum is by ranges of the order, not in one task."""
    out = sessions.withColumn("_may", F.lit(True))
    if candidates is not None:
        known = candidates.select("session").distinct().withColumn("_hit", F.lit(True))
        out = sessions.join(known, "session", "left").withColumn("_may", F.col("_hit").isNotNull()).drop("_hit")
    # sizes by hour first, so that the ordered sum over all sessions is over few rows; then within the hour
    hour = F.floor(F.col("updated") / 3_600_000)
    out = out.withColumn("_hour", hour).withColumn(
        "_bytes", F.when(F.col("_may"), F.coalesce("size", F.lit(0))).otherwise(0)
    )
    newer = Window.partitionBy().orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = out.groupBy("_hour").agg(F.sum("_bytes").alias("_sum")).select(
        "_hour", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("_hour").orderBy(F.desc("updated"), "session").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = out.join(hours, "_hour").withColumn("_upto", F.col("_before") + F.sum("_bytes").over(within))
    fits = (F.col("_upto") <= budget) | (F.col("_upto") == F.col("_bytes"))
    state = F.when(~F.col("_may"), "not_candidate").when(fits, "scanned").otherwise("skipped")
    return out.select("session", "updated", "size", state.alias("state"))


def regex_candidates(indexed: DataFrame, wanted: DataFrame, regex: str) -> DataFrame:
    """Sessions whose indexed rows hold every literal of the pattern, and those that are not indexed."""
    return sessions_to_scan(indexed, wanted, "session", "text", required_literals(regex))


def capped(hits: DataFrame, order: list[Column], most: int = 50_000) -> DataFrame:
    """At most `most` hits, and whether there were more."""
    more = hits.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("rows_capped"))
    return hits.orderBy(*order).limit(most).join(F.broadcast(more))


def displayed(messages: DataFrame, compactions: DataFrame) -> DataFrame:
    """Messages without those that are the summaries of compactions (by source_id)."""
    inner = compactions.where("summary_message_id is not null").select(
        "session", F.col("summary_message_id").alias("source_id")
    )
    return messages.join(inner.distinct(), ["session", "source_id"], "left_anti")


def compaction_turns(compactions: DataFrame, messages: DataFrame) -> DataFrame:
    """Compactions with their sequence and the turn after which they lie (0 where the message is not known)."""
    at = numbered(messages).where("source_id is not null").groupBy("session", "source_id").agg(
        F.max_by("turn", "message").alias("_turn")
    )
    at = at.withColumnRenamed("source_id", "after_message_id")
    sequence = F.row_number().over(Window.partitionBy("session").orderBy("ordinal")).cast("long")
    out = compactions.join(at, ["session", "after_message_id"], "left")
    return out.withColumn("sequence", sequence).withColumn(
        "after_turn", F.coalesce("_turn", F.lit(0)).cast("long")
    ).drop("_turn")


def context_status(sessions: DataFrame, compactions: DataFrame) -> DataFrame:
    """session, state (full, in_progress, incomplete, compacted), compaction_count, summary_status of the latest."""
    any_ = lambda s: F.max(F.col("state") == s)
    c = compactions.groupBy("session").agg(
        any_("in_progress").alias("_p"),
        any_("incomplete").alias("_i"),
        F.count(F.lit(1)).alias("_n"),
        F.max_by("summary_status", "ordinal").alias("_s")
    )
    state = F.when(
        F.col("_n").isNull(), "full"
    ).when(F.col("_p"), "in_progress").when(F.col("_i"), "incomplete").otherwise("compacted")
    out = sessions.select("session").join(c, "session", "left")
    return out.select(
        "session",
        state.alias("state"),
        F.coalesce("_n", F.lit(0)).alias("compaction_count"),
        F.coalesce("_s", F.lit("not_applicable")).alias("summary_status")
    )


def tail_pointer(compactions: DataFrame) -> DataFrame:
    """The last compaction of each session that replaced its history."""
    return compactions.where("replaces").groupBy("session").agg(
        F.max_by(F.struct("id", "ordinal"), "ordinal").alias("r")
    ).select("session", "r.id", "r.ordinal")


def timeline(rounds: DataFrame, compactions: DataFrame, has_more: bool = False) -> DataFrame:
    """Rounds and groups of compactions in the order of display: (session, place, kind, n, ids). Compactions of turn 0
    come first, others behind their round; those beyond the last round come last, and not yet where more is to load."""
    last = rounds.groupBy("session").agg(F.max("n").alias("_last"))
    groups = compactions.groupBy("session", F.col("after_turn").alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sequence", "id"))), lambda x: x["id"]).alias("ids")
    )
    groups = groups.join(last, "session", "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    if has_more:
        groups = groups.where("n <= _last")
    known = groups.join(
        rounds.select("session", "n"), ["session", "n"], "left_semi"
    ).unionByName(groups.where("n = 0 or n > _last")).distinct()
    rows = rounds.select(
        "session", "n", F.lit("round").alias("kind"), F.array().cast("array<string>").alias("ids")
    ).unionByName(known.select("session", "n", F.lit("compaction").alias("kind"), "ids"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("n", F.desc("kind")))
    return rows.select("session", place.cast("long").alias("place"), "kind", "n", "ids")


def shown(messages: DataFrame, from_message: int = 1, limit: int | None = 30) -> DataFrame:
    """A page of each session by turns: (session, turn, user, replies, first, last, next_from_message). A page ends at
    `limit` messages or later, before a user message; replies are the assistant texts up to the next user message."""
    w = Window.partitionBy("session")
    m = numbered(messages).withColumn(
        "_n", F.row_number().over(w.orderBy("message"))
    ).withColumn("_total", F.count(F.lit(1)).over(w))
    end = F.col("_total") if limit is None else F.least("_total", F.lit(from_message - 1 + max(1, limit)))
    stop = F.min(F.when((F.col("_n") > end) & (F.col("role") == "user"), F.col("_n") - 1)).over(w)
    m = m.withColumn("_last", F.when(end >= F.col("_total"), F.col("_total")).otherwise(F.coalesce(stop, "_total")))
    page = m.where((F.col("_n") >= from_message) & (F.col("_n") <= F.col("_last")))
    # a reply before the page's first user message belongs to no turn of the page
    opened = F.max(F.when(F.col("role") == "user", 1)).over(
        w.orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    page = page.withColumn("_open", opened).where("_open = 1")
    replies = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("_n", "text"))))
    out = page.groupBy("session", "turn").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user"),
        F.transform(replies, lambda x: x["text"]).alias("replies"),
        F.min("_n").cast("long").alias("first"),
        F.max("_n").cast("long").alias("last"),
        F.max("_last").alias("_l"),
        F.max("_total").alias("_t")
    )
    return out.withColumn(
        "next_from_message", F.when(F.col("_l") < F.col("_t"), F.col("_l") + 1).cast("long")
    ).drop("_l", "_t")


def assets(blocks: DataFrame, asset_id: str) -> DataFrame:
    """The image of this id: one row, or none."""
    return blocks.where(
        (F.col("kind") == "image") & (F.col("image_id") == asset_id)
    ).select("mime_type", "data", "filename").limit(1)


def resolved(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Handles to rows: (handle, state found, stale or unknown, session). A handle names a session and its revision."""
    out = wanted.join(index.select("handle", "session", F.col("revision").alias("_now")), "handle", "left")
    state = F.when(F.col("session").isNull(), "unknown").when(
        F.col("revision") == F.col("_now"), "found"
    ).otherwise("stale")
    return out.select("handle", state.alias("state"), "session")


def handle(tool: Column, ref: Column) -> Column:
    """A stable name of a session that does not show where it lies; the same after every run."""
    return F.sha2(F.concat(tool, F.lit("\0"), ref), 256)


def library(
    sessions: DataFrame,
    tools: list[str],
    needle: str = "",
    tag: str | None = None,
    repo: str | None = None,
    migrated: bool = False,
    children: bool = False
) -> DataFrame:
    """Sessions of a library view: by tool, tag, repository, whether migrated, whether with children, and a text in
    title, name, tags, directory or id."""
    hay = F.lower(
        F.concat_ws(
            "\n",
            F.coalesce("title", F.lit("")),
            F.coalesce("name", F.lit("")),
            F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\n"),
            F.coalesce("dir", F.lit("")),
            "session"
        )
    )
    out = sessions.where(F.col("tool").isin(*tools))
    out = out.where(F.array_contains("tags", tag)) if tag else out
    out = out.where(F.element_at(F.filter(F.split("dir", "/"), lambda x: x != ""), -1) == repo) if repo else out
    out = out.where("migrated") if migrated else out
    out = out.where("tree_count > 1") if children else out
    return out.where(F.contains(hay, F.lit(needle.strip().lower()))) if needle.strip() else out
