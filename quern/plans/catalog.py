"""The library's operators applied to whole test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import library as L
from ..operators import search as S
from ..operators import state as R
from ..operators import timeseries as T
from ..operators import topology as G
from ..operators import turns as M
from ..operators import usage as U

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = "2024-01-30 00:00:00"
PRICES = [
    ("acme/alpha-2", 3.0, 15.0, 0.3, 3.75),
    ("beta", 1.0, 5.0, 0.1, 1.25),
    ("gamma-mini", 0.25, 2.0, 0.025, 0.3),
    ("delta.pro", 10.0, 40.0, 1.0, 12.5)
]
MODELS = ("ALPHA-2", "beta", "beta-20240101", "gamma-mini", "x/delta.pro", "unlisted")

_PRICES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {a!r}::DECIMAL(10,6), {b!r}::DECIMAL(10,6), {c!r}::DECIMAL(10,6), {d!r}::DECIMAL(10,6), {k})" for k,
    (n, a, b, c, d) in enumerate(PRICES)
) + ") t(name, price_input, price_output, price_cache_read, price_cache_write, ordinal)"
_MODEL_SQL = "CASE user_id % 6 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MODELS)) + " END"
_USAGE_SQL = f"""
    prices AS ({_PRICES_SQL}),
    rows0 AS (
        SELECT concat(user_id, '/', CAST(ts AS DATE)) AS session, event_type AS tool, concat('p', user_id % 12) AS project, {_MODEL_SQL} AS model, ts, event_id,
               CAST(event_id % 1000 AS BIGINT) AS input, CAST(event_id % 97 AS BIGINT) AS output, CAST(user_id % 13 AS BIGINT) AS cache_read, CAST(event_id % 7 AS BIGINT) AS cache_write
        FROM events),
    names AS (SELECT DISTINCT model, lower(split_part(model, '/', -1)) AS m FROM rows0 WHERE model IS NOT NULL),
    pairs AS (
        SELECT n.model, p.*, lower(split_part(p.name, '/', -1)) AS p, n.m,
               CASE WHEN n.model = p.name THEN 0 WHEN n.m = lower(split_part(p.name, '/', -1)) THEN 1
                    WHEN starts_with(n.m, lower(split_part(p.name, '/', -1))) AND substr(n.m, length(split_part(p.name, '/', -1)) + 1, 1) IN ('-', '_', '.', ':') THEN 2
                    WHEN starts_with(lower(split_part(p.name, '/', -1)), n.m) AND substr(lower(split_part(p.name, '/', -1)), length(n.m) + 1, 1) IN ('-', '_', '.', ':') THEN 2 END AS rank
        FROM names n CROSS JOIN prices p),
    matched AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rank, abs(length(m) - length(p)), ordinal) AS best FROM pairs WHERE rank IS NOT NULL) WHERE best = 1),
    priced AS (
        SELECT r.*, k.name AS priced_as,
               coalesce((r.input::INTEGER * k.price_input + r.output::INTEGER * k.price_output + r.cache_read::INTEGER * k.price_cache_read + r.cache_write::INTEGER * k.price_cache_write) * 0.000001::DECIMAL(7,6), 0) AS cost
        FROM rows0 r LEFT JOIN matched k ON r.model = k.model)"""
_SUMS_SQL = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*p, k) for k, p in enumerate(PRICES)],
        "name string, price_input double, price_output double, price_cache_read double, price_cache_write double, ordinal int"
    )


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("user_id") % 6 + 1).cast("int"))
    rows = e.select(
        F.concat_ws("/", "user_id", F.to_date("ts")).alias("session"),
        F.col("event_type").alias("tool"),
        F.concat(F.lit("p"), F.col("user_id") % 12).alias("project"),
        model.alias("model"),
        "ts",
        "event_id",
        (F.col("event_id") % 1000).alias("input"),
        (F.col("event_id") % 97).alias("output"),
        (F.col("user_id") % 13).alias("cache_read"),
        (F.col("event_id") % 7).alias("cache_write")
    )
    return rows


def usage_priced(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return U.cells(usage_rows(spark, sf_dir), prices(spark), list(keys))


# turns -----------------------------------------------------------------------------------------

_RUN = "sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"


@query(
    f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS message, CAST({_RUN} AS BIGINT) AS turn_no FROM conversations"
)
def turn_numbering(spark, sf_dir):
    return M.turn_numbers(
        load(spark, sf_dir, "conversations"), "conv_id", "turn"
    ).select("conv_id", "message", "turn_no")


@query(f"SELECT conv_id, turn, CAST(greatest(1, {_RUN}) AS BIGINT) AS round_no FROM conversations")
def round_numbering(spark, sf_dir):
    return M.round_numbers(
        load(spark, sf_dir, "conversations"), "conv_id", "turn"
    ).select("conv_id", "turn", "round_no")


@query("""
    WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, CAST(pos AS BIGINT) AS start, CAST(coalesce(lead(pos) OVER (PARTITION BY conv_id ORDER BY pos), n) AS BIGINT) AS "end" FROM c WHERE role = 'user'""")
def turn_spans(spark, sf_dir):
    return M.turn_spans(load(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(
    "SELECT conv_id, CAST(coalesce(min(CASE WHEN role = 'user' AND turn >= 3 THEN turn END), count(*)) AS BIGINT) AS page_end FROM conversations GROUP BY conv_id"
)
def page_to_turn_boundary(spark, sf_dir):
    return M.page_ends(load(spark, sf_dir, "conversations"), "conv_id", "turn", 3)


@query("""
    WITH a AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS change FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    b AS (SELECT *, CAST(sum(change) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM a)
    SELECT conv_id, chunk, min(role) AS role, count(*) AS parts, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM b GROUP BY conv_id, chunk""")
def chunk_merge(spark, sf_dir):
    return M.merge_chunks(
        load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"
    ).select("conv_id", "chunk", "role", "parts", F.md5("text").alias("text_md5"))


@query("""
    WITH c AS (SELECT conv_id, turn AS call_at, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'user'),
    r AS (SELECT conv_id, turn AS result_at, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'assistant')
    SELECT conv_id, CAST(nth AS BIGINT) AS nth, call_at, result_at, CASE WHEN result_at IS NULL THEN 'unpaired_call' WHEN call_at IS NULL THEN 'orphan_result' ELSE 'paired' END AS state
    FROM c FULL JOIN r USING (conv_id, nth)""")
def pair_calls_results(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("ordinal"))
    part = lambda role: c.where(F.col("role") == role).drop("role")
    return M.pair_calls(part("user"), part("assistant"), ["conv_id"]).select(
        "conv_id", F.col("nth").cast("long").alias("nth"), "call_at", "result_at", "state"
    )


@query("""
    WITH a AS (SELECT conv_id, turn, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, turn, used_bytes FROM a WHERE used_bytes <= 1000 OR n = 1""")
def byte_budget_prefix(spark, sf_dir):
    return M.byte_budget(
        load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 1000
    ).select("conv_id", "turn", "used_bytes")


@query("""
    WITH a AS (SELECT conv_id, turn, length(text) % 5 * 10 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, turn, CAST(max(t - n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + n AS BIGINT) AS t FROM a""")
def increasing_timestamps(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.length("text") % 5 * 10).cast("long").alias("t")
    )
    return M.strictly_increasing(c, "conv_id", "turn", "t")


@query("""
    WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_bytes FROM conversations WHERE turn >= 1),
    b AS (SELECT * FROM a WHERE n <= 3 AND (used_bytes <= 2000 OR n = 1)), e AS (SELECT conv_id, max(turn) AS fin FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, max(turn) AS last FROM b GROUP BY conv_id)
    SELECT conv_id, turn, used_bytes, CASE WHEN last < fin THEN last + 1 END AS next_message FROM b JOIN l USING (conv_id) JOIN e USING (conv_id)""")
def context_page(spark, sf_dir):
    return M.page(
        load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 1, 3, 2000
    ).select("conv_id", "turn", "used_bytes", "next_message")


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, greatest(1, {_RUN}) AS r FROM conversations) WHERE r <= 2")
def keep_first_rounds(spark, sf_dir):
    return M.keep_rounds(load(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")


# search ----------------------------------------------------------------------------------------

TERMS = ["the", "ing"]


@query(f"""
    WITH m AS (SELECT conv_id, turn, text, CAST({_RUN} AS BIGINT) AS turn_no, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS message FROM conversations)
    SELECT conv_id, message, turn_no, concat(CASE WHEN contains(lower(text), 'the') THEN 'the' ELSE '' END, '+', CASE WHEN contains(lower(text), 'ing') THEN 'ing' ELSE '' END) AS matched
    FROM m WHERE contains(lower(text), 'the') OR contains(lower(text), 'ing')""")
def session_term_search(spark, sf_dir):
    m = M.turn_numbers(load(spark, sf_dir, "conversations"), "conv_id", "turn")
    hit = [X.contains(F.col("text"), t) for t in TERMS]
    matched = F.concat(F.when(hit[0], TERMS[0]).otherwise(""), F.lit("+"), F.when(hit[1], TERMS[1]).otherwise(""))
    return m.where(hit[0] | hit[1]).select("conv_id", "message", "turn_no", matched.alias("matched"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'thea') AND contains(lower(text), 'tion')")
def content_search_and(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(S.all_terms(F.col("text"), ["thea", "tion"])).select("doc_id", "lang")


@query("""
    SELECT doc_id, CAST(min(p) AS INTEGER) AS best_pattern FROM (
        SELECT doc_id, 0 AS p FROM documents WHERE contains(lower(text), 'worthless')
        UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version')
        UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(lower(text), 'eaux')) GROUP BY doc_id""")
def content_search_or_patterns(spark, sf_dir):
    return S.any_pattern(
        load(spark, sf_dir, "documents"), "doc_id", "text", [["worthless"], ["license", "version"], ["eaux"]]
    ).select("doc_id", "best_pattern")


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(lower(text), 'ñ') GROUP BY lang")
def short_term_scan(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(
        X.contains(F.col("text"), "Ñ")
    ).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_TF = "CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT)"


@query(f"""
    SELECT conv_id, turn, tf, CAST(hit_no AS BIGINT) AS hit_no FROM (
        SELECT conv_id, turn, {_TF} AS tf, row_number() OVER (PARTITION BY conv_id ORDER BY {_TF} DESC, turn) AS hit_no FROM conversations WHERE contains(lower(text), 'the')) WHERE hit_no <= 3""")
def search_top3_hits(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("tf", X.occurrences(F.col("text"), "the")).where("tf > 0")
    return S.top_hits(c, "conv_id", [F.desc("tf"), F.col("turn")]).select("conv_id", "turn", "tf", "hit_no")


@query(
    f"SELECT conv_id, count(*) AS hits, max({_TF}) AS best FROM conversations WHERE contains(lower(text), 'the') GROUP BY conv_id"
)
def hit_buckets(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("tf", X.occurrences(F.col("text"), "the")).where("tf > 0")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("hits"), F.max("tf").alias("best"))


_BM25 = """
    d AS (SELECT doc_id, source, CAST(length(text) AS DOUBLE) AS size, CAST((length(lower(text)) - length(replace(lower(text), 'thea', ''))) / 4 AS BIGINT) AS tf FROM documents),
    s AS (SELECT count(*) AS n, avg(size) AS a, count(CASE WHEN tf > 0 THEN 1 END) AS df FROM d),
    c AS (SELECT doc_id, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a)) AS score FROM d CROSS JOIN s WHERE tf > 0),
    h AS (SELECT doc_id, source, CASE WHEN contains(lower(source), 'src1') THEN 1 ELSE 0 END AS meta, score FROM (SELECT doc_id, source FROM documents) LEFT JOIN c USING (doc_id)),
    g AS (SELECT *, CASE WHEN meta = 1 AND score IS NOT NULL THEN 0 WHEN score IS NOT NULL THEN 1 WHEN meta = 1 THEN 2 END AS hit_group FROM h)"""


@query(f"""
    WITH {_BM25}
    SELECT doc_id, CAST(hit_group AS INTEGER) AS hit_group, round(score, 6) AS score, (SELECT count(*) FROM g WHERE hit_group IS NOT NULL) AS total_matches
    FROM g WHERE hit_group IS NOT NULL ORDER BY hit_group, round(score, 6) DESC NULLS LAST, doc_id DESC LIMIT 50""")
def search_ranked(spark, sf_dir):
    return S.ranked_rows(
        load(spark, sf_dir, "documents"), "doc_id", "text", ["thea"], X.contains(F.col("source"), "src1"), 50
    )


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'ERTION!+')")
def regex_scan(spark, sf_dir):
    return S.regex_scan(load(spark, sf_dir, "documents"), "text", "ERTION!+").select("doc_id")


@query(
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR doc_id NOT IN (SELECT doc_id FROM labels)"
)
def regex_prefilter_candidates(spark, sf_dir):
    """Documents with labels stand for the indexed ones."""
    d = load(spark, sf_dir, "documents")
    indexed = d.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return S.candidates(indexed, d.select("doc_id"), "doc_id", "text", ["license"])


@query(
    "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang)), 'src1') AND contains(lower(concat_ws(' ', source, lang)), 'en')"
)
def metadata_search(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(
        S.all_terms(F.concat_ws(" ", "source", "lang"), ["src1", "en"])
    ).select("doc_id")


@query("""
    SELECT doc_id, contains(lower(source), 'src2') AS metadata_hit, contains(lower(text), 'idiot') AS content_hit FROM documents
    WHERE contains(lower(source), 'src2') OR contains(lower(text), 'idiot')""")
def scope_any(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        X.contains(F.col("source"), "src2").alias("metadata_hit"),
        X.contains(F.col("text"), "idiot").alias("content_hit")
    ).where("metadata_hit or content_hit")


@query(
    "SELECT lang, count(CASE WHEN length(text) > 16000 THEN 1 END) AS clipped, CAST(sum(length(substr(text, 1, 16000))) AS BIGINT) AS kept_chars FROM documents GROUP BY lang"
)
def clipped_records(spark, sf_dir):
    part, more = X.bounded(F.col("text"), 16_000)
    return load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.when(more, 1)).alias("clipped"), F.sum(F.length(part)).cast("long").alias("kept_chars")
    )


@query("""
    WITH a AS (SELECT doc_id, text, strpos(lower(text), 'tion') AS pos, length(text) AS n FROM documents),
    b AS (SELECT *, greatest(1, pos - 120) AS lo, least(n, pos + 3 + 240) AS hi FROM a)
    SELECT doc_id, CASE WHEN pos > 0 THEN concat(CASE WHEN lo > 1 THEN '…' ELSE '' END, substr(text, lo, hi - lo + 1), CASE WHEN hi < n THEN '…' ELSE '' END) ELSE substr(text, 1, 240) END AS snippet FROM b""")
def snippet_window(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "tion").alias("snippet"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') AND contains(lower(text), 'idiot')")
def trigram_index_hits(spark, sf_dir):
    """The whole index is built and stored; the search reads the folders of its trigrams and verifies what they find."""
    docs, path = load(spark, sf_dir, "documents").select("doc_id", "text"), G.scratch(spark)
    S.write_postings(S.trigram_postings(docs, "doc_id", "text"), path)
    return S.stored_hits(spark, path, docs, "doc_id", "text", ["worthless", "idiot"]).select("doc_id")


# usage -----------------------------------------------------------------------------------------


@query(
    f"WITH {_USAGE_SQL} SELECT {_SUMS_SQL}, count(DISTINCT session) AS sessions, CAST(round(sum(cost), 4) AS DOUBLE) AS cost FROM priced"
)
def usage_total(spark, sf_dir):
    return U.total(usage_rows(spark, sf_dir), prices(spark))


def _by(key: str) -> str:
    return f"WITH {_USAGE_SQL} SELECT coalesce(nullif({key}, ''), 'unknown') AS {key}, {_SUMS_SQL}, CAST(round(sum(cost), 6) AS DOUBLE) AS cost FROM priced GROUP BY 1"


@query(_by("tool"))
def usage_by_agent(spark, sf_dir):
    return U.by(usage_priced(spark, sf_dir, "tool"), "tool")


@query(_by("model"))
def usage_by_model(spark, sf_dir):
    return U.by(usage_priced(spark, sf_dir), "model")


@query(_by("project"))
def usage_by_project(spark, sf_dir):
    return U.by(usage_priced(spark, sf_dir, "project"), "project")


@query(
    f"WITH {_USAGE_SQL}, b AS (SELECT project, {_SUMS_SQL}, CAST(round(sum(cost), 6) AS DOUBLE) AS cost FROM priced GROUP BY 1) SELECT *, input + output + cache_read + cache_write AS tokens FROM b ORDER BY cost DESC, tokens DESC, project LIMIT 15"
)
def top_by_cost(spark, sf_dir):
    return U.top_by_cost(usage_priced(spark, sf_dir, "project"), "project")


@query(
    f"WITH {_USAGE_SQL} SELECT DISTINCT model FROM priced WHERE priced_as IS NULL AND model IS NOT NULL ORDER BY model LIMIT 20"
)
def unpriced_models(spark, sf_dir):
    return U.unpriced_models(usage_priced(spark, sf_dir))


@query(
    f"WITH {_USAGE_SQL} SELECT CASE WHEN grouping(tool) = 0 THEN 'tool' WHEN grouping(model) = 0 THEN 'model' WHEN grouping(project) = 0 THEN 'project' ELSE 'total' END AS grouped_by, CASE WHEN grouping(tool) = 0 THEN coalesce(nullif(tool, ''), 'unknown') WHEN grouping(model) = 0 THEN coalesce(nullif(model, ''), 'unknown') WHEN grouping(project) = 0 THEN coalesce(nullif(project, ''), 'unknown') END AS name, {_SUMS_SQL}, CAST(round(sum(cost), 6) AS DOUBLE) AS cost FROM priced GROUP BY GROUPING SETS ((), (tool), (model), (project))"
)
def usage_grouping_sets(spark, sf_dir):
    return U.grouping_sets(usage_priced(spark, sf_dir, "tool", "project"), ["tool", "model", "project"])


@query("""
    WITH t AS (SELECT user_id AS session, event_type AS model, CAST(sum(event_id % 1000 + event_id % 97 + 2 * (user_id % 13)) AS BIGINT) AS tokens, min(event_id) AS pos FROM events GROUP BY ALL)
    SELECT session, model, tokens FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tokens DESC, pos) AS n FROM t) WHERE n = 1""")
def dominant_model(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        F.col("event_type").alias("model"),
        (F.col("event_id") % 1000).alias("input"),
        (F.col("event_id") % 97).alias("output"),
        (F.col("user_id") % 13).alias("cache_read"),
        (F.col("user_id") % 13).alias("cache_write"),
        F.col("event_id").alias("first_at")
    )
    return U.dominant_model(e, "session")


@query(f"WITH {_USAGE_SQL} SELECT model, name FROM matched")
def price_match(spark, sf_dir):
    return U.match_prices(usage_rows(spark, sf_dir), prices(spark)).select("model", "name")


_T = "(input + output + cache_read + cache_write)"
_CUR, _PREV = "ts >= TIMESTAMP '2024-01-23'", "ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-23'"


@query(
    f"""WITH {_USAGE_SQL} SELECT {", ".join(f"count(CASE WHEN {w} THEN 1 END) AS {n}_rows, CAST(coalesce(sum(CASE WHEN {w} THEN {_T} END), 0) AS BIGINT) AS {n}_tokens, coalesce(CAST(round(sum(CASE WHEN {w} THEN cost END), 6) AS DOUBLE), 0.0) AS {n}_cost" for n, w in (("current", _CUR), ("previous", _PREV)))} FROM priced"""
)
def kpi_period_delta(spark, sf_dir):
    return U.period_delta(usage_priced(spark, sf_dir, "session", "ts"), "ts", NOW, 7)


@query(
    f"WITH {_USAGE_SQL}, s AS (SELECT {_SUMS_SQL} FROM priced), u AS (UNPIVOT s ON input, output, cache_read, cache_write INTO NAME part VALUE tokens) SELECT part, tokens, round(tokens / sum(tokens) OVER () * 100, 4) AS pct FROM u"
)
def token_composition(spark, sf_dir):
    return U.composition(usage_rows(spark, sf_dir))


@query(
    f"WITH {_USAGE_SQL} SELECT lower(split_part(model, '/', -1)) AS model, CAST(round(sum(cost), 6) AS DOUBLE) AS cost, CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens FROM priced WHERE priced_as IS NOT NULL GROUP BY 1 ORDER BY cost DESC, model LIMIT 5"
)
def cost_table(spark, sf_dir):
    return U.cost_table(usage_priced(spark, sf_dir))


@query(
    f"WITH {_USAGE_SQL} SELECT count(DISTINCT model) AS models, CAST(coalesce(sum(input + output + cache_read + cache_write), 0) AS BIGINT) AS tokens FROM priced WHERE priced_as IS NULL AND model IS NOT NULL"
)
def unpriced_summary(spark, sf_dir):
    return U.unpriced_summary(usage_priced(spark, sf_dir))


# time ------------------------------------------------------------------------------------------


@query("""
    WITH h AS (SELECT CAST(range AS INTEGER) AS hour FROM range(24)), c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1),
    a AS (SELECT hour, coalesce(n, 0) AS n FROM h LEFT JOIN c USING (hour))
    SELECT hour, n, hour = (SELECT hour FROM a ORDER BY n DESC, hour LIMIT 1) AS peak FROM a""")
def clock_histogram(spark, sf_dir):
    return T.clock(load(spark, sf_dir, "events"), "ts")


@query(
    "SELECT count(CASE WHEN hour(ts) >= 21 OR hour(ts) <= 4 THEN 1 END) AS night, count(*) AS total, round(count(CASE WHEN hour(ts) >= 21 OR hour(ts) <= 4 THEN 1 END) / count(*), 6) AS share FROM events"
)
def night_share(spark, sf_dir):
    return T.night_share(load(spark, sf_dir, "events"), "ts")


@query("""
    WITH d AS (SELECT CAST(range AS INTEGER) AS id, CAST(DATE '2024-01-29' - 357 + CAST(range AS INTEGER) AS DATE) AS day FROM range(364)), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
    SELECT CAST(id // 7 AS INTEGER) AS week, CAST(id % 7 AS INTEGER) AS weekday, day, CAST(CASE WHEN day > DATE '2024-01-30' THEN -1 ELSE coalesce(n, 0) END AS BIGINT) AS n FROM d LEFT JOIN c USING (day)""")
def heatmap_52w(spark, sf_dir):
    return T.heatmap(load(spark, sf_dir, "events"), "ts", NOW)


def _trend(age: str) -> str:
    return f"""
    WITH b AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(14)), c AS (SELECT CAST({age} AS INTEGER) AS bucket, count(*) AS n, sum(value) AS value FROM events GROUP BY 1)
    SELECT bucket, coalesce(n, 0) AS n, round(coalesce(value, 0.0), 6) AS value FROM b LEFT JOIN c USING (bucket)"""


@query(_trend("DATE '2024-01-30' - CAST(ts AS DATE)"))
def trends_14d(spark, sf_dir):
    return T.trends(load(spark, sf_dir, "events"), "ts", NOW)


@query(_trend("floor((epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts)) / 86400000000)"))
def trends_14d_midnight(spark, sf_dir):
    return T.trends(load(spark, sf_dir, "events"), "ts", NOW, parity=True)


@query("""
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
    r AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM i GROUP BY ALL)
    SELECT user_id, max(n) AS longest, coalesce(max(CASE WHEN DATE '2024-01-30' - last BETWEEN 0 AND 1 THEN n END), 0) AS current FROM r GROUP BY 1""")
def activity_streaks(spark, sf_dir):
    return T.streaks(load(spark, sf_dir, "events"), "user_id", "ts", NOW)


@query("""
    WITH e AS (SELECT l_shipmode_or AS model, CAST(date_trunc('month', d) AS DATE) AS month, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT o_orderpriority AS l_shipmode_or, o_orderdate AS d, o_orderkey % 1000 AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1998-02-01') GROUP BY ALL),
    t AS (SELECT model, sum(tokens) AS total FROM e GROUP BY 1 ORDER BY total DESC, model LIMIT 4), p AS (SELECT *, row_number() OVER (ORDER BY total DESC, model) AS place, count(*) OVER () AS k FROM t),
    g AS (SELECT model, place, CAST(DATE '1998-02-01' + to_months(CAST(range AS INTEGER)) AS DATE) AS month FROM p, range(6) WHERE k >= 2),
    f AS (SELECT g.model, g.month, g.place, CAST(coalesce(e.tokens, 0) AS BIGINT) AS tokens FROM g LEFT JOIN e ON g.model = e.model AND g.month = e.month)
    SELECT model, month, tokens, CAST(row_number() OVER (PARTITION BY month ORDER BY tokens DESC, place) AS BIGINT) AS rank FROM f""")
def model_bump(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model"), "o_orderdate", (F.col("o_orderkey") % 1000).alias("tokens")
    )
    return T.bump(o, "o_orderdate", "1998-07-15 00:00:00")


# library ---------------------------------------------------------------------------------------

EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


@query(
    "SELECT concat('p', user_id % 12) AS project, count(*) AS n, " + ", ".join(
        f"count(CASE WHEN event_type = '{t}' THEN 1 END) AS n_{t}" for t in EVENT_TYPES
    ) + " FROM events GROUP BY 1 ORDER BY n DESC, project LIMIT 6"
)
def repo_ranking_pivot(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("project", F.concat(F.lit("p"), F.col("user_id") % 12))
    return L.ranking(e, "project", "event_type", EVENT_TYPES)


@query("""
    SELECT r_name AS src, o_orderstatus AS dst, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2 ORDER BY n DESC, src, dst LIMIT 5""")
def migration_flows(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    place = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    moves = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return L.flows(moves.select(F.col("r_name").alias("src"), F.col("o_orderstatus").alias("dst")), "src", "dst")


@query("SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_left_join(spark, sf_dir):
    return L.with_metadata(
        load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), ["doc_id"]
    )


@query(
    "SELECT d.doc_id, CASE WHEN quality = 0 THEN 'pinned' WHEN toxic = 1 THEN 'archived' WHEN source = 'src3' THEN 'tagged' END AS cause FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def protected_rows(spark, sf_dir):
    d = metadata_left_join(spark, sf_dir)
    return d.select(
        "doc_id", L.protection(F.col("quality") == 0, F.col("toxic") == 1, F.col("source") == "src3").alias("cause")
    )


@query("""
    WITH p AS (SELECT n_chars, CASE WHEN quality = 0 THEN 'pinned' WHEN toxic = 1 THEN 'archived' WHEN source = 'src3' THEN 'tagged' END AS cause FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT count(CASE WHEN cause IS NULL THEN 1 END) AS deletable, CAST(coalesce(sum(CASE WHEN cause IS NULL THEN n_chars END), 0) AS BIGINT) AS bytes, count(cause) AS protected FROM p""")
def delete_preview(spark, sf_dir):
    return L.delete_preview(
        protected_rows(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"),
        "cause",
        "n_chars"
    )


_BUCKET = "CASE WHEN DATE '2024-01-30' - CAST(ts AS DATE) <= 0 THEN 'today' WHEN DATE '2024-01-30' - CAST(ts AS DATE) = 1 THEN 'yesterday' WHEN DATE '2024-01-30' - CAST(ts AS DATE) < 7 THEN 'last7' WHEN DATE '2024-01-30' - CAST(ts AS DATE) < 30 THEN 'last30' ELSE 'earlier' END"


@query(
    f"SELECT CASE WHEN event_type = 'signup' THEN 'pinned' ELSE {_BUCKET} END AS group_name, count(*) AS n FROM events GROUP BY 1"
)
def library_groups(spark, sf_dir):
    g = L.groups(load(spark, sf_dir, "events"), F.col("event_type") == "signup", T.time_bucket("ts", NOW))
    return g.groupBy("group_name").agg(F.count(F.lit(1)).alias("n"))


@query("""
    (SELECT event_type AS value, count(*) AS n, min(event_id) AS first_at, 'tool' AS facet FROM events GROUP BY 1)
    UNION ALL (SELECT CAST(user_id AS VARCHAR), count(*), min(event_id) AS f, 'place' FROM events GROUP BY 1 ORDER BY f LIMIT 6)""")
def library_facets(spark, sf_dir):
    return L.facets(
        load(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string")),
        "event_type",
        "user_id",
        "event_id"
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rolled_back' WHEN o_orderpriority = '1-URGENT' THEN 'probe_failed' WHEN nullif(o_custkey % 7, 0) IS NOT NULL THEN 'done' ELSE 'failed' END AS status
    FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' AND contains(lower(o_orderpriority), 'u')""")
def history_filter(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where(
        F.col("o_orderdate").between(
            F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz")
        ) & X.contains(F.col("o_orderpriority"), "U")
    )
    return o.select(
        "o_orderkey",
        L.history_status(
            F.col("o_orderstatus") == "P",
            F.col("o_orderpriority") == "1-URGENT",
            F.nullif(F.col("o_custkey") % 7, F.lit(0))
        ).alias("status")
    )


@query(
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
)
def merge_newest(spark, sf_dir):
    return L.newest(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


# snapshots -------------------------------------------------------------------------------------

_SNAP = """
    a AS (SELECT doc_id, md5(text) AS rev FROM documents),
    b AS (SELECT CASE WHEN quality = 0 THEN -1 - l.doc_id ELSE l.doc_id END AS doc_id, CASE WHEN toxic = 1 THEN 'old' ELSE md5(text) END AS rev FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    r AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'missing' WHEN a.rev = b.rev THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _snapshots(spark, sf_dir):
    """Now: the documents. Stored: those with labels, bad ones under another id, toxic ones with an old revision."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("rev"))
    known = d.join(load(spark, sf_dir, "labels"), "doc_id")
    stored = known.select(
        F.when(F.col("quality") == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("toxic") == 1, "old").otherwise(F.col("rev")).alias("rev")
    )
    return d, stored


@query(f"WITH {_SNAP} SELECT * FROM r")
def index_reconcile(spark, sf_dir):
    return R.reconcile(*_snapshots(spark, sf_dir), ["doc_id"], "rev")


@query(
    f"WITH {_SNAP} SELECT doc_id, CASE WHEN state = 'missing' THEN 'removal' ELSE 'upsert' END AS op FROM r WHERE state <> 'same'"
)
def delta_upserts_removals(spark, sf_dir):
    after, before = _snapshots(spark, sf_dir)
    return R.delta(before, after, ["doc_id"], "rev")


# topology --------------------------------------------------------------------------------------

_NODES = """
    nodes AS (
        SELECT concat('r', r_regionkey) AS id, CAST(NULL AS VARCHAR) AS parent_id, 1 AS count, length(r_name) AS size, r_regionkey AS updated, 5 AS tokens FROM region
        UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 2, length(n_name), n_nationkey, 7 FROM nation
        UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 1, c_custkey % 100, c_custkey, 1 FROM customer),
    closure AS (SELECT id AS ancestor, id AS node, 0 AS depth FROM nodes UNION ALL SELECT c.ancestor, n.id, c.depth + 1 FROM closure c JOIN nodes n ON n.parent_id = c.node)"""


def tree(spark, sf_dir):
    t = lambda n: load(spark, sf_dir, n)
    row = lambda df, k, p, count, size, up, tok: df.select(
        k.alias("id"),
        p.alias("parent_id"),
        F.lit(count).cast("long").alias("count"),
        size.cast("long").alias("size"),
        up.cast("long").alias("updated"),
        F.lit(tok).cast("long").alias("tokens")
    )
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    r = row(
        t("region"), key("r", "r_regionkey"), F.lit(None).cast("string"), 1, F.length("r_name"), F.col("r_regionkey"), 5
    )
    n = row(
        t("nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), 2, F.length("n_name"), F.col("n_nationkey"), 7
    )
    c = row(
        t("customer"),
        key("c", "c_custkey"),
        key("n", "c_nationkey"),
        1,
        F.col("c_custkey") % 100,
        F.col("c_custkey"),
        1
    )
    return r.unionByName(n).unionByName(c)


@query(f"""
    WITH RECURSIVE {_NODES}
    SELECT a.id, CAST(a.tokens AS BIGINT) AS tokens, CAST(sum(n.count) AS BIGINT) AS count, CAST(sum(n.size) AS BIGINT) AS size, CAST(max(n.updated) AS BIGINT) AS updated, count(*) AS tree_count, count(CASE WHEN depth = 1 THEN 1 END) AS child_count
    FROM closure c JOIN nodes n ON c.node = n.id JOIN nodes a ON c.ancestor = a.id GROUP BY a.id, a.tokens""")
def tree_rollup(spark, sf_dir):
    return G.rollup(tree(spark, sf_dir))


@query(f"WITH RECURSIVE {_NODES} SELECT ancestor, node, CAST(depth AS BIGINT) AS depth FROM closure")
def ancestor_closure(spark, sf_dir):
    return G.closure(tree(spark, sf_dir))


@query("""
    WITH RECURSIVE n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (3, 4, 5) THEN CASE n_nationkey WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 3 END WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey - 1 END AS parent_id FROM nation),
    w AS (SELECT id AS start, parent_id AS pos FROM n WHERE parent_id IS NOT NULL UNION SELECT w.start, n.parent_id FROM w JOIN n ON n.id = w.pos WHERE n.parent_id IS NOT NULL)
    SELECT CAST(id AS BIGINT) AS id FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n) OR id IN (SELECT start FROM w WHERE start = pos)""")
def cycle_roots(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    parent = F.when(k == 3, 4).when(k == 4, 5).when(k == 5, 3).when(
        k % 4 == 0, F.lit(None).cast("long")
    ).otherwise(k - 1)
    return G.roots(load(spark, sf_dir, "nation").select(k.alias("id"), parent.cast("long").alias("parent_id")))


@query("""
    WITH RECURSIVE r AS (SELECT conv_id, turn, concat(conv_id, ':', turn) AS id, CASE WHEN turn > 0 THEN concat(conv_id, ':', greatest(0, turn - 1 - turn % 2)) END AS parent_id FROM conversations),
    b AS (SELECT conv_id, id, parent_id, 0 AS d FROM r WHERE (conv_id, turn) IN (SELECT (conv_id, max(turn)) FROM r GROUP BY conv_id) UNION ALL SELECT r.conv_id, r.id, r.parent_id, d + 1 FROM b JOIN r ON r.id = b.parent_id)
    SELECT conv_id, id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) AS BIGINT) AS step FROM b""")
def active_branch(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    r = c.select(
        "conv_id",
        "turn",
        F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.when(
            F.col("turn") > 0,
            F.concat_ws(":", F.col("conv_id"), F.greatest(F.lit(0), F.col("turn") - 1 - F.col("turn") % 2))
        ).alias("parent_id")
    )
    return G.active_branch(r, "conv_id", "id", "parent_id", "turn")
