"""The registered query of each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity, url_filter
from .common import WORD, load, materialize, scratch_dir
from .mixing import mix
from .near_dup import near_duplicates
from .packing import pack
from .quality import fit, score
from .quality_rules import judge
from .sharding import ShardTable
from .topk import quantized, top_k
from .vector_codes import compressed
from .warc import archived
from .whitening import whitened


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as small shards and are compacted; the result is what the last version reads."""
    table = ShardTable(spark, scratch_dir(spark))
    table.append(load(spark, sf_dir, "documents"))
    table.compact()
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    return table.read().select("doc_id", "lang", "source", "n_chars", n_bytes, F.md5("text").alias("text_md5"))


def op1_sharding_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests of op1_sharding's table say, by step: rows that the version holds, whether its shards are
    fewer than those that arrived, whether any tier still has shards to merge, rows that lie in more than one shard.

    Here the rows arrive in shards of 100, so that tables of a thousand rows have something to merge.
    """
    table = ShardTable(spark, scratch_dir(spark))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    arrived = table.append(docs, 100)
    steps = [("arrived", arrived), ("compacted", table.compact())]
    before, out = len(table.manifest(arrived)["shards"]), None
    for step, version in steps:
        m = table.manifest(version)
        rows = table.read(version).select("doc_id", F.col("_metadata.file_path").alias("file"))
        one = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
        one = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("files") > 1, 1)).alias("rows_in_two"))
        one = one.select(F.lit(step).alias("step"), "rows", F.lit(len(m["shards"]) < before).alias("fewer_shards"), F.lit(bool(table.plan(m))).alias("to_merge"), "rows_in_two")
        out = one if out is None else out.unionByName(one)
    return out


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, held out or not, with its predicted language; rows with a null id are not held out."""
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.where(~held))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and its offending sentences; without labels of both kinds every score is 0.5."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = load(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.where(~held), labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of every query vector, repeated rows counted each. Vectors that are null or hold a null or non-finite
    component take no part."""
    vectors = quantized(load(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20, each_row=True)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page. Labels are the quality labels of `labels` for the number of the page (see the README)."""
    pages = load(spark, sf_dir, "pages")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_filter.judge(pages, pages.select("page_id", "url").join(labels, "page_id")).drop("confidence")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; a null or empty text has none."""
    placed, spans = mix(load(spark, sf_dir, "documents"))
    taken = spans.groupBy("k", "at").agg(F.sum("length").alias("taken"))
    sized = placed.where("size > 0").join(taken, ["k", "at"], "left")
    rows = sized.unionByName(placed.where("size = 0").withColumn("taken", F.lit(None).cast("long")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; a null or empty text is scored too, without positives every score is 0.5."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = load(spark, sf_dir, "labels")
    model = fit(docs.where(~held), labels.where(~held & (F.col("quality") == 1)).select("doc_id"))
    out = score(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdict; a null or empty text fails."""
    return judge(load(spark, sf_dir, "documents"))


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document; a null or empty text is its end id alone."""
    pieces = pack(load(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and component; a null or blank text is its own component."""
    return near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its eight leading components; without any the result is empty."""
    return whitened(load(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its code; without any the result is empty."""
    return compressed(load(spark, sf_dir, "embeddings"))


def op13_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archives give it back; a null html is an empty payload."""
    return archived(load(spark, sf_dir, "pages"), scratch_dir(spark))


# parts of the operators' results that SQL can express, each from the whole operator ----------------


def op2_language_mixture_und(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have no language."""
    out = op2_language_mixture(spark, sf_dir)
    return out.select("doc_id", (F.col("lang_pred") == "und").alias("und"), (F.col("score") == 0).alias("zero"))


def op4_mix_sources_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets, whether each document keeps its bound, and whether each source's taken words come within two
    blocks of its target."""
    out = op4_mix_sources(spark, sf_dir).transform(materialize)
    sums = out.groupBy("source").agg(F.sum("taken").alias("words"))
    bounded = (F.col("taken") <= 2 * F.col("size")).alias("bounded")
    near = (F.abs(F.col("words") - F.col("target")) <= 256).alias("near")
    out = out.join(F.broadcast(sums.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), bounded, near)


def op7_pack_sequences_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document: whether its pieces cover it, and whether its sequences stay within 2048 tokens without a gap."""
    out = op7_pack_sequences(spark, sf_dir).transform(materialize)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    good = out.join(full, "sequence_id").groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("covered"), F.every((F.col("n") <= 2048) & (F.col("n") == F.col("end"))).alias("gapless"))
    return good


def op8_url_rules_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and fixed rules, with the verdict where a fixed rule decides."""
    out = op8_url_rules(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op9_minhash_near_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents of equal text share a component, and whether the kept one is the smallest of its component."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"))
    out = op9_minhash_near_dedup(spark, sf_dir).join(docs, "doc_id")
    return out.groupBy("m").agg(F.count(F.lit(1)).alias("n"), (F.min("component_id") == F.max("component_id")).alias("together"), F.every(F.col("kept") == (F.col("doc_id") == F.col("component_id"))).alias("smallest"))


def op10_quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op11_embedding_whitening_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By row and component: the exact columns, and whether the whitened values of the component have mean 0 and
    variance 1, its share lies within 0 and 1 and the identity is met."""
    out = op11_embedding_whitening(spark, sf_dir).transform(materialize)
    good = [F.abs(F.avg("whitened")) < 1e-6, F.abs(F.avg(F.col("whitened") * F.col("whitened")) - 1) < 1e-4]
    good += [F.min("explained") == F.max("explained"), F.max("explained") < 1, F.min("explained") > 0, F.max("identity_error") <= 1e-4]
    sound = F.lit(True)
    for test in good:
        sound &= test
    checks = out.groupBy("component").agg(sound.alias("sound"))
    return out.join(F.broadcast(checks), "component").select("vec_id", "component", "n", "deviation", "sound")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op1_sharding_manifest": op1_sharding_manifest,
        "op2_language_mixture": op2_language_mixture,
        "op6_toxicity_mil": op6_toxicity_mil,
        "op3_threshold_topk": op3_threshold_topk,
        "op8_url_rules": op8_url_rules,
        "op4_mix_sources": op4_mix_sources,
        "op5_quality_pu": op5_quality_pu,
        "op10_quality_rules": op10_quality_rules,
        "op7_pack_sequences": op7_pack_sequences,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_vector_codes": op12_vector_codes,
        "op13_warc_transactions": op13_warc_transactions,
        "op11_embedding_whitening_exact": op11_embedding_whitening_exact,
        "op2_language_mixture_und": op2_language_mixture_und,
        "op4_mix_sources_sizes": op4_mix_sources_sizes,
        "op7_pack_sequences_cover": op7_pack_sequences_cover,
        "op8_url_rules_fixed": op8_url_rules_fixed,
        "op9_minhash_near_dedup_exact": op9_minhash_near_dedup_exact,
        "op10_quality_rules_base": op10_quality_rules_base,
    }


USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The codebooks and codes of op12 by plain comparison of every part with every entry."""
    out = [
        f"""
            WITH v AS (
                SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
                       list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings WHERE {USABLE}),
            s AS (SELECT r, v, unnest(range({parts})) AS part, len(v) // {parts} AS w FROM v),
            p AS (SELECT r, part, v[part * w + 1:(part + 1) * w] AS x FROM s),
            c0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries})"""
    ]
    for k in range(rounds + 1):
        out.append(f"""
            a{k} AS (
                SELECT r, part, min(dist) AS dist, arg_min(entry, dist * {entries} + entry) AS entry
                FROM (SELECT p.r, p.part, c.entry,
                             CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS dist
                      FROM p JOIN c{k} c ON p.part = c.part)
                GROUP BY r, part)""")
        if k < rounds:
            out.append(f"""
            m{k} AS (
                SELECT part, entry, list(mean ORDER BY pos) AS x
                FROM (SELECT part, entry, pos, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS mean
                      FROM (SELECT a.part, a.entry, unnest(p.x) AS y, unnest(range(len(p.x))) AS pos
                            FROM a{k} a JOIN p ON a.r = p.r AND a.part = p.part)
                      GROUP BY part, entry, pos)
                GROUP BY part, entry),
            c{k + 1} AS (
                SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)""")
    out.append(f"""
            h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
            e AS (SELECT r, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
                  FROM a{rounds} GROUP BY r)
            SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
            FROM v JOIN e ON v.r = e.r CROSS JOIN h""")
    return ",".join(out[:-1]) + "," + out[-1]


def oracle_sql() -> dict[str, str]:
    return {
        "op11_embedding_whitening_exact": f"""
            WITH v AS (
                SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) + 100000) AS x
                FROM embeddings WHERE {USABLE}),
            c AS (SELECT r, unnest(x) AS x, unnest(range(len(x))) AS pos FROM v),
            s AS (SELECT pos, count(*) AS n, CAST(sum(x) AS HUGEINT) AS s FROM c GROUP BY pos),
            d AS (SELECT c.r, CAST(sum((s.n * c.x - s.s) * (s.n * c.x - s.s)) AS BIGINT) AS deviation FROM c JOIN s ON c.pos = s.pos GROUP BY c.r)
            SELECT v.vec_id, CAST(k.component AS INTEGER) AS component, (SELECT count(*) FROM v) AS n, d.deviation, true AS sound
            FROM v JOIN d ON v.r = d.r JOIN range(1, 9) k(component) ON k.component <= len(v.x)""",
        "op12_vector_codes": _codes_sql(),
        "op13_warc_transactions": """
            WITH p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS html FROM pages),
            f AS (SELECT r, page_id, url, html, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST, r) AS nth,
                         first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST, r) AS first_page FROM p),
            b AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(sha1(html), 5 * g + 1, 5) AS BIGINT)) AS bits FROM f)
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
                   array_to_string(list_transform(range(32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((bits[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
                   CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_page END AS refers_to, url
            FROM b""",
        "op1_sharding": "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents",
        "op1_sharding_manifest": """
            SELECT s.step, (SELECT count(*) FROM documents) AS rows, s.step = 'compacted' AND d.n >= 1000 AS fewer_shards,
                   s.step = 'arrived' AND d.n >= 1000 AS to_merge, CAST(0 AS BIGINT) AS rows_in_two
            FROM (VALUES ('arrived'), ('compacted')) s(step) CROSS JOIN (SELECT count(*) AS n FROM documents) d""",
        "op3_threshold_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id,
                       CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
            r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
                FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op2_language_mixture_und": r"SELECT doc_id, NOT coalesce(regexp_matches(text, '\p{L}'), false) AS und, NOT coalesce(regexp_matches(text, '\p{L}'), false) AS zero FROM documents",
        # a source is full where the level at which the sources from it on would share what is left lies above twice its size
        "op4_mix_sources_sizes": f"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
            s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
            w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
            o AS (SELECT *, row_number() OVER (ORDER BY 2 * words / weight, k) AS n FROM w),
            v AS (SELECT *, (1.5 * sum(words) OVER () - coalesce(sum(2 * words) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                            / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
            f AS (SELECT min(CASE WHEN level * weight <= 2 * words THEN n END) AS first FROM v),
            t AS (SELECT v.source, CASE WHEN v.n < f.first THEN 2 * v.words ELSE v.weight * (SELECT level FROM v x WHERE x.n = f.first) END AS target FROM v CROSS JOIN f)
            SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (PARTITION BY d.source) AS BIGINT) AS source_size, round(target, 4) AS target,
                   true AS bounded, true AS near
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
        "op9_minhash_near_dedup": f"""
            WITH RECURSIVE d AS (
                SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
                FROM documents),
            s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [md5(array_to_string(w, ' '))]
                         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d),
            n AS (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
            e AS (SELECT r, unnest(s) AS h FROM s WHERE doc_id IS NOT NULL),
            p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.r < b.r GROUP BY 1, 2),
            l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON p.a = x.r JOIN n y ON p.b = y.r WHERE 100 * k >= 85 * (x.n + y.n - k)),
            u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            g AS (SELECT a AS start, b AS x FROM u UNION SELECT g.start, u.b FROM g JOIN u ON g.x = u.a),
            c AS (SELECT start, min(x) AS least FROM g GROUP BY start)
            SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c.least, n.doc_id)) AS component_id,
                   n.doc_id IS NULL OR n.doc_id <= coalesce(c.least, n.doc_id) AS kept
            FROM n LEFT JOIN c ON n.doc_id = c.start""",
        "op7_pack_sequences_cover": "SELECT DISTINCT doc_id, true AS covered, true AS gapless FROM documents",
        "op8_url_rules_fixed": r"""
            WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
            r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(kind, rh, rp)),
            f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(kind, length(rh || rp)) AS verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
            SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN f ON h.page_id = f.page_id""",
        "op9_minhash_near_dedup_exact": "SELECT md5(text) AS m, count(*) AS n, true AS together, true AS smallest FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "op10_quality_rules_base": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
            w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
            l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM w),
            g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
            k AS (SELECT r, i, list_aggregate(w[i:i + 4], 'string_agg', chr(0)) AS k FROM g),
            n AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k) WHERE c > 1),
            c AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS spot FROM n) GROUP BY 1)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
            FROM w JOIN l USING (r) LEFT JOIN c USING (r)""",
    }
