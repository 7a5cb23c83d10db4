"""URL filtering: fixed host and path rules first, then association rules mined from labelled URLs.

FP-growth finds the frequent token combinations of the labelled URLs together with their label; combinations
that imply "bad" with enough confidence and support become rules, without those that a shorter rule covers.
A rule is indexed by its rarest token; a URL looks up its tokens and checks the rules it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, with_fields

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BAD = "label=bad"
#: Bad URLs that must hold a combination, its confidence, and its tokens at most.
LEAST = 10
CONFIDENCE = 0.6
TOKENS = 3
#: Tokens of one URL that a run of FP-growth is given, about: it makes 2 to their number of combinations. Where URLs hold
#: more tokens worth mining, the tokens are dealt into groups and every TOKENS groups are mined together.
RUN_TOKENS = 12
#: Share of the labelled URLs that the count may not fall below, so that the rules stay bounded on large tables.
SUPPORT = 0.0002
#: Standard errors by which the lower bound of a rule's confidence (Wilson) lies under it; it must exceed the share of bad URLs.
ERRORS = 3.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end.
    Null, or no ://: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: the host's labels and domain suffixes, the path's parts, the names of query parameters."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffix = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda k: F.concat(F.lit("domain="), F.array_join(F.slice(labels, n - k + 1, k), ".")))).otherwise(F.array().cast("array<string>"))
    name = F.transform(labels, lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    asked = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1), lambda x: F.concat(F.lit("query="), x))
    return F.array_distinct(F.concat(name, suffix, parts, asked))


def _surely(bad: int, n: int) -> float:
    """Lower bound of a share of which `bad` of `n` were seen."""
    p, z = bad / n, ERRORS
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _mined_tokens(usable: DataFrame, least: float, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens that are rules by themselves (token, n_bad), one row per labelled URL that holds any other: its tokens
    worth mining (with BAD where it is bad), and which token stands for which others (token, others).

    A token is worth mining where `least` bad URLs hold it, however few of its URLs are bad: together with others it may
    be sure. One that all of the `total` URLs hold changes no count and is left out. Of tokens that the same URLs hold (a
    host, its suffixes, a path of its own) the shortest stands for all. A token of which all URLs are bad is a rule that
    no longer combination can be surer than, so it is in none.
    """
    host, path = host_and_path(F.col("url"))
    numbered = usable.select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64("url").alias("mark"))
    rows = numbered.select("row", "bad", "mark", F.explode(tokens(host, path, F.col("url"))).alias("token"))
    # URLs that hold a token are known by their number and a sum of hashes (of 32 bits, so that it cannot overflow)
    same = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_bad"), F.sum(F.pmod("mark", F.lit(1 << 32))).alias("mark")]
    known = rows.groupBy("token").agg(*same).where((F.col("n_bad") >= least) & ((F.col("n") < total) | (F.col("n_bad") == F.col("n"))))
    alike = F.array_sort(F.collect_list(F.struct(F.length("token").alias("size"), "token")))
    known = known.groupBy("n", "n_bad", "mark").agg(alike.alias("alike"))
    known = materialize(known.select(F.col("alike")[0]["token"].alias("token"), "n", "n_bad", F.expr("transform(slice(alike, 2, size(alike)), x -> x.token)").alias("others")))
    sure = known.where("n = n_bad").select("token", "n_bad")
    mined = known.where("n > n_bad").select("token")
    held = rows.select("row", "bad", "token").join(mined, "token").groupBy("row", "bad").agg(F.collect_list("token").alias("held"))
    items = F.concat("held", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    return sure, held.select(items.alias("items")), known.where(F.size("others") > 0).select("token", "others")


def _combinations(rows: DataFrame, fewest: float, confidence: float) -> list[tuple[tuple[str, ...], float, int]]:
    """(tokens, confidence, bad URLs) of all combinations of TOKENS tokens at most that `fewest` bad rows hold.

    Any TOKENS tokens lie in some TOKENS of the groups, and every row is mined with its tokens of those groups, so
    nothing is lost, and how many tokens a run sees of a URL does not grow.
    """
    m, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    if not m:
        return []
    groups = 1 if longest <= RUN_TOKENS else max(TOKENS, math.ceil(TOKENS * longest / RUN_TOKENS))
    wanted = (F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") <= TOKENS)
    found: dict[tuple[str, ...], tuple[float, int]] = {}
    for chosen in combinations(range(groups), min(TOKENS, groups)):
        part = rows
        if groups > 1:
            of = lambda x: (x == BAD) | F.pmod(F.xxhash64(x), F.lit(groups)).isin(*chosen)  # noqa: B023, E731
            part = rows.select(F.filter("items", of).alias("items"))
        # half a URL less: the share is multiplied and rounded up again
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(fewest) - 0.5) / m), minConfidence=confidence).fit(part)
        rules = model.associationRules.where(wanted).select(F.array_sort("antecedent"), "confidence", "support").collect()
        found |= {tuple(a): (c, round(s * m)) for a, c, s in rules}
    return [(a, c, n) for a, (c, n) in sorted(found.items())]


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> list[tuple[tuple[str, ...], float, float]]:
    """(tokens, confidence, share of the labelled URLs) of the rules mined from `labelled` (url, bad boolean)."""
    return mine_alike(labelled, support, confidence, least)[0]


def mine_alike(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> tuple[list[tuple[tuple[str, ...], float, float]], dict[str, str]]:
    """The rules mined from `labelled` (url, bad boolean) as (tokens, confidence, share of the labelled URLs), and the
    token that stands in them for each other token of the same labelled URLs: those are in the same rules.

    A rule holds for at least `least` bad URLs, in a large table for a share of `support`, and the lower bound of its
    confidence lies above the share of bad URLs. Null urls and labels are left out, repeated URLs count each. The
    number of tokens mined is bounded by the support (1/s times the tokens of a URL), and that of their combinations by
    TOKENS, so what comes to the driver does not grow with the URLs.
    """
    usable = labelled.where("url is not null and bad is not null").select(F.col("url").cast("string").alias("url"), "bad")
    n, n_bad = usable.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    if n_bad < least:
        return [], {}
    fewest = max(support * n, least)
    singles, rows, alike = _mined_tokens(usable, fewest, n)
    found = [((r.token,), 1.0, r.n_bad) for r in singles.orderBy("token").collect()]
    found += _combinations(materialize(rows), fewest, confidence)
    sure = [(a, c, k / n) for a, c, k in found if _surely(k, round(k / c)) > n_bad / n]
    kept: dict[tuple[str, ...], tuple[tuple[str, ...], float, float]] = {}
    for rule in sorted(sure, key=lambda r: (len(r[0]), r[0])):
        # a longer combination must be surer than every rule it contains
        if all(rule[1] > kept[part][1] for k in range(1, len(rule[0])) for part in combinations(rule[0], k) if part in kept):
            kept[rule[0]] = rule
    used = {t for rule in kept for t in rule}
    stand_in = {x: r.token for r in alike.collect() if r.token in used for x in r.others} if used else {}
    return list(kept.values()), stand_in


def _matcher(rules: list[tuple[tuple[str, ...], float, float]], stand_in: dict[str, str]):
    used: dict[str, int] = {}
    for a, _, _ in rules:
        for t in a:
            used[t] = used.get(t, 0) + 1
    index: dict[str, list[tuple[frozenset[str], float]]] = {}
    for a, c, _ in rules:
        index.setdefault(min(a, key=lambda t: (used[t], t)), []).append((frozenset(a), c))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for items in batch.column(batch.num_columns - 1).to_pylist():
                have = {stand_in.get(t, t) for t in items}
                best.append(max((c for t in have for need, c in index.get(t, ()) if need <= have), default=0.0))
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(best, pa.float64())], [*names, "confidence"])

    return match


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest fixed rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), confidence: one row per row of `pages` (page_id, url).

    The longest fixed rule decides; where none fits, a URL that a mined rule matches is blocked and any other
    allowed. A null url, or one without ://, has an empty host and path and is allowed. Rows are judged one by
    one, so repeated rows and null ids stay; without labels nothing is mined; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"), tokens(host, path, F.col("url")).alias("items"))
    out = rows.transform(map_texts, _matcher(*mine_alike(labelled)), with_fields(rows.drop("items"), confidence="double"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")
