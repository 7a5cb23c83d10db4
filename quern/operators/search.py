"""Search: content and metadata hits, several patterns, ranking, regular expressions with a literal prefilter."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains, java_regex, occurrences, required_literals

K1, B = 1.2, 0.75


def all_terms(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [contains(text, t) for t in terms])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def any_pattern(rows: DataFrame, key: str, text: str, patterns: list[list[str]]) -> DataFrame:
    """Rows that match a pattern (all of its terms), with the number of the first that does. One scan: the
    union of the patterns' hits, deduplicated by the best, is the least matching number."""
    best = reduce(
        lambda out,
        p: F.when(all_terms(F.col(text), p[1]), p[0]).otherwise(out),
        reversed(list(enumerate(patterns))),
        F.lit(None).cast("int")
    )
    return rows.withColumn("best_pattern", best).where("best_pattern is not null")


def bm25(rows: DataFrame, text: str, terms: list[str], size: Column | None = None) -> DataFrame:
    """`rows` that hold all terms with a bm25 score over substring terms (larger is better)."""
    size = size if size is not None else F.length(text)
    counted = rows.select(
        "*",
        size.cast("double").alias("_size"),
        *(occurrences(F.col(text), t).alias(f"_tf{k}") for k, t in enumerate(terms))
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_size").alias("_avg"),
        *(F.count(F.when(F.col(f"_tf{k}") > 0, 1)).alias(f"_df{k}") for k in range(len(terms)))
    )
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5)))
        tf = F.col(f"_tf{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_size") / F.col("_avg")))
    hit = reduce(lambda a, b: a & b, [F.col(f"_tf{k}") > 0 for k in range(len(terms))])
    # the statistics are one row
    joined = counted.where(hit).join(F.broadcast(stats))
    return joined.withColumn("score", score).drop(*(c for c in joined.columns if c.startswith("_")))


def combine_hits(rows: DataFrame, metadata: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """`rows` with flags of both kinds of hit and the rank group: 0 both, 1 content, 2 metadata."""
    m = metadata.select(key).distinct().withColumn("metadata_hit", F.lit(True))
    c = content.select(key, "score").withColumn("content_hit", F.lit(True))
    out = rows.join(m, key, "left").join(c, key, "left").fillna(False, ["metadata_hit", "content_hit"])
    group = F.when(
        F.col("metadata_hit") & F.col("content_hit"), 0
    ).when(F.col("content_hit"), 1).when(F.col("metadata_hit"), 2)
    return out.withColumn("hit_group", group).where("hit_group is not null")


def ranked(hits: DataFrame, newest: str, limit: int) -> DataFrame:
    """Best group first, then better score, then newer; `total` counts before the limit."""
    order = [F.col("hit_group"), F.desc_nulls_last("score"), F.desc(newest)]
    total = hits.agg(F.count(F.lit(1)).alias("total_matches"))
    return hits.orderBy(*order).limit(limit).join(F.broadcast(total))


def ranked_rows(rows: DataFrame, key: str, text: str, terms: list[str], metadata: Column, limit: int) -> DataFrame:
    """`key`, hit_group (0 both kinds of hit, 1 content, 2 metadata), score, total_matches: the best `limit` rows, by
    group, then score, then larger key. One pass for the statistics, which also count the hits, and one for the rows."""
    tf = [f"_tf{k}" for k in range(len(terms))]
    base = rows.select(
        key,
        metadata.alias("_meta"),
        F.length(text).cast("double").alias("_size"),
        *(occurrences(F.col(text), t).alias(c) for t, c in zip(terms, tf, strict=True))
    )
    held = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in tf])
    stats = base.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_size").alias("_avg"),
        F.count(F.when(F.col("_meta") | held, 1)).alias("total_matches"),
        *(F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}d") for c in tf)
    )
    score = F.lit(0.0)
    for c in tf:
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"{c}d") + 0.5) / (F.col(f"{c}d") + 0.5)))
        score = score + idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("_size") / F.col("_avg")))
    group = F.when(F.col("_meta") & held, 0).when(held, 1).otherwise(2)
    # the statistics are one row
    hits = base.where(F.col("_meta") | held).join(F.broadcast(stats)).withColumn("hit_group", group).withColumn(
        "score", F.when(held, F.round(score, 6))
    )
    return hits.orderBy(
        "hit_group", F.desc_nulls_last("score"), F.desc(key)
    ).limit(limit).select(key, "hit_group", "score", "total_matches")


def top_hits(hits: DataFrame, session: str, order: list[Column], k: int = 3) -> DataFrame:
    w = Window.partitionBy(session).orderBy(*order)
    return hits.withColumn("hit_no", F.row_number().over(w)).where(F.col("hit_no") <= k).withColumn(
        "hit_no", F.col("hit_no").cast("long")
    )


def regex_scan(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose text the pattern matches. Literals that every match must hold are tested first; a pattern that
    Java reads differently goes through a vectorised Python function."""
    for literal in required_literals(pattern):
        rows = rows.where(F.contains(F.col(text), F.lit(literal)))
    return rows.where(regex_span(F.col(text), pattern)["at"] > 0)


def regex_span(text: Column, pattern: str) -> Column:
    """Where the pattern first matches: (at, from 1, and length), zeros where it does not. Patterns that Java reads
    differently are matched, and placed, by one vectorised Python function."""
    if (java := java_regex(pattern)) is not None:
        at = F.coalesce(F.regexp_instr(text, F.lit(java)), F.lit(0))
        return F.struct(
            at.alias("at"), F.coalesce(F.length(F.regexp_substr(text, F.lit(java))), F.lit(0)).alias("length")
        )
    held = re.compile(pattern)

    @F.pandas_udf("at int, length int")
    def span(texts: pd.Series) -> pd.DataFrame:
        found = [held.search(t) if t is not None else None for t in texts]
        return pd.DataFrame(
            {"at": [m.start() + 1 if m else 0 for m in found], "length": [len(m[0]) if m else 0 for m in found]}
        )

    return span(text)


def holding_all(rows: DataFrame, key: str, text: str, literals: list[str]) -> DataFrame:
    """Keys (sessions) whose rows hold every literal, be it in different rows: one flag a literal, kept by maximum."""
    flags = [F.max(contains(F.col(text), x)).alias(f"_l{k}") for k, x in enumerate(literals)]
    every = reduce(lambda a, b: a & b, [F.col(f"_l{k}") for k in range(len(literals))], F.lit(True))
    return (rows.groupBy(key).agg(*flags) if flags else rows.select(key).distinct()).where(every).select(key)


def sessions_to_scan(indexed: DataFrame, wanted: DataFrame, key: str, text: str, literals: list[str]) -> DataFrame:
    """`candidates` where there are literals; else every wanted key."""
    return candidates(indexed, wanted, key, text, literals) if literals else wanted.select(key)


def candidates(indexed: DataFrame, wanted: DataFrame, key: str, text: str, literals: list[str]) -> DataFrame:
    """Keys to scan: indexed ones whose rows together hold every literal, and all that are not indexed."""
    holding = holding_all(indexed, key, text, literals)
    return wanted.join(holding, key, "left_semi").select(key).union(wanted.join(indexed, key, "left_anti").select(key))


def grams_of(terms: list[str]) -> list[str]:
    return sorted({t[i : i + 3].lower() for t in terms for i in range(len(t) - 2)})


def text_grams(text: Column) -> Column:
    """The distinct lower-case trigrams of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), 1))


def trigram_postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram): the inverted index of lower-case character trigrams."""
    return rows.select(key, F.explode(text_grams(F.col(text))).alias("gram"))


def posting_hits(postings: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys that hold every trigram of every term (a superset of the true hits)."""
    grams = grams_of(terms)
    return postings.where(F.col("gram").isin(grams)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("n") == len(grams)).select(key)


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Stores an index by buckets of grams; each bucket is a folder, so that a search reads only its grams' folders."""
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
    postings.withColumn("bucket", bucket).repartition(
        "bucket", F.pmod(F.xxhash64(postings.columns[0]), F.lit(8))
    ).write.partitionBy("bucket").parquet(path)


def stored_hits(
    spark, path: str, rows: DataFrame, key: str, text: str, terms: list[str], buckets: int = 64
) -> DataFrame:
    """Rows that hold every term: candidates from the stored index, verified on their texts."""
    grams = spark.createDataFrame([(g,) for g in grams_of(terms)], "gram string")
    wanted = sorted(
        r[0] for r in grams.select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).distinct().collect()
    )
    found = posting_hits(spark.read.parquet(path).where(F.col("bucket").isin(wanted)), key, terms)
    return rows.join(found, key, "left_semi").where(all_terms(F.col(text), terms))
