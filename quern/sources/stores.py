"""Readers of stores that are not line files: SQLite databases (a Python data source) and session bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.table = [f.name for f in schema.fields], options["table"]
        self.paths = options["path"].split(",")

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        import sqlite3

        names = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True, timeout=5) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table.replace(chr(34), chr(34) * 2)}"')


class SqliteSource(DataSource):
    """`spark.read.format("quern_sqlite")` with a schema and the options path (files, comma-separated, one task
    each; every executor must reach them) and table. Opens read-only."""

    @classmethod
    def name(cls) -> str:
        return "quern_sqlite"

    def reader(self, schema):
        return _Reader(schema, self.options)


def sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("quern_sqlite").schema(schema).option("path", path).option("table", table).load()


def database_rows(session: DataFrame, message: DataFrame) -> DataFrame:
    """Session rows of a database: message counts, tokens of assistant messages from their JSON, the model of most
    tokens; a session without messages counts 0 and is dropped where it is a root."""
    m = message.withColumn(
        "d",
        F.from_json(
            "data",
            "role string, modelID string, model string, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>"
        )
    )
    n = lambda c: F.coalesce(F.col(f"d.tokens.{c}"), F.lit(0))
    used = m.where("d.role = 'assistant'").select(
        "session_id",
        "time_created",
        F.coalesce("d.modelID", "d.model", F.lit("")).alias("model"),
        n("input").alias("input"),
        (n("output") + n("reasoning")).alias("output"),
        n("cache.read").alias("cache_read"),
        n("cache.write").alias("cache_write")
    )
    parts = ("input", "output", "cache_read", "cache_write")
    by_model = used.groupBy("session_id", "model").agg(
        *(F.sum(p).alias(p) for p in parts), F.min("time_created").alias("at")
    )
    tokens = by_model.groupBy("session_id").agg(
        *(F.sum(p).alias(p) for p in parts),
        F.max_by(
            "model",
            F.struct(
                (F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("t"),
                (-F.col("at")).alias("early")
            )
        ).alias("model")
    )
    counts = message.groupBy("session_id").agg(F.count(F.lit(1)).alias("count"))
    s = session.withColumnRenamed("id", "session_id").join(
        counts, "session_id", "left"
    ).join(tokens, "session_id", "left").fillna(0, ["count", *parts])
    s = s.where((F.col("count") > 0) | F.col("parent_id").isNotNull())
    return s.select(
        F.lit("opencode").alias("tool"),
        F.col("session_id").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("directory", F.lit("")).alias("dir"),
        F.col("time_updated").alias("updated_ms"),
        F.col("time_created").alias("created_ms"),
        "count",
        "parent_id",
        *parts,
        "model"
    )


def bundle_rows(spark: SparkSession, path: str) -> DataFrame:
    """Session rows of bundle folders by their summary.json: format 1 with an id and a directory, else left out."""
    schema = "info struct<id:string,cwd:string>, generated_title string, session_summary string, created_at string, updated_at string, num_chat_messages bigint, num_messages bigint, current_model_id string, parent_session_id string, root_session_id string, chat_format_version int"
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="summary.json")
    r = raw.select(
        F.from_json("value", schema).alias("r"),
        F.col("_metadata.file_size").alias("size"),
        F.unix_millis("_metadata.file_modification_time").alias("modified_ms"),
        F.col("_metadata.file_path").alias("file")
    )
    r = r.select("r.*", "size", "modified_ms", "file").where(
        "chat_format_version = 1 and info.id is not null and info.cwd is not null"
    )
    ms = lambda c: F.unix_millis(F.try_to_timestamp(c))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return r.select(
        F.lit("grok").alias("tool"),
        F.col("info.id").alias("id"),
        F.coalesce(filled("generated_title"), filled("session_summary"), F.lit("")).alias("title"),
        F.col("info.cwd").alias("dir"),
        F.coalesce(ms("updated_at"), "modified_ms").alias("updated_ms"),
        ms("created_at").alias("created_ms"),
        F.coalesce("num_chat_messages", "num_messages", F.lit(0)).alias("count"),
        "size",
        F.col("parent_session_id").alias("parent_id"),
        F.coalesce("root_session_id", "info.id").alias("root_id"),
        F.coalesce("current_model_id", F.lit("")).alias("model")
    )
