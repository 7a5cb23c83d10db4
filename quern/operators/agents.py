"""Trees of agents: descendants of sessions, spawn calls and the children they started, edges with their certainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topology import _durable, closure, forest

#: States of an edge by the result of its call, and how sure an association is.
EDGE_STATES = {
    "open": "open",
    "in_progress": "open",
    "queued": "open",
    "closed": "closed",
    "completed": "closed",
    "failed": "closed",
    "cancelled": "closed",
    "canceled": "closed"
}
SPAWNED, BY_REGISTRY, BY_HEADER = 1.0, 0.95, 0.75
#: Longest piece of an identity by which it is looked up in texts.
GRAM = 8
#: Identities for which a partition of pieces is made; a task holds those of its partition.
NAMED = 20_000


def _by_sorting(df: DataFrame) -> DataFrame:
    """`df` for a join by sorting: files of ids are small and grow in memory, and what grows with the sessions is not to
    be collected for a broadcast."""
    return df.hint("merge")


def parents(headers: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, parent_id, association, and the other columns of `headers`): the parent that a session's own header names,
    else the one that the registry (child, parent, status) has for it. Of repeated children the greatest parent counts."""
    known = registry.where(
        "child is not null and parent is not null"
    ).groupBy(F.col("child").alias("id")).agg(F.max("parent").alias("_parent"))
    out = headers.join(_by_sorting(known), "id", "left")
    own = F.nullif(F.col("parent_id"), F.lit(""))
    association = F.when(own.isNotNull(), "parent-metadata").when(F.col("_parent").isNotNull(), "sqlite-parent")
    return out.withColumn("association", association).withColumn(
        "parent_id", F.coalesce(own, "_parent")
    ).drop("_parent")


def descendants(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of all sessions (id, parent_id) below each of `roots` (id), the root itself included.

    Pointers are doubled up to the nearest asked root, so a chain takes the logarithm of its length; only asked roots
    are then paired with the asked roots above them. A session without a known parent, or on a cycle that no asked root
    cuts, is below none but itself.
    """
    asked = roots.select(F.col("id").alias("_asked")).distinct()
    flagged = sessions.select("id", "parent_id").join(asked, F.col("id") == F.col("_asked"), "left")
    cut = flagged.select("id", F.when(F.col("_asked").isNull(), F.col("parent_id")).alias("parent_id"))
    tree = _durable(forest(cut).select("node", "top"))
    near = tree.join(asked, F.col("top") == F.col("_asked")).select(
        F.col("top").alias("root"), F.col("node").alias("id")
    )
    # an asked root lies below the asked root that its own parent is nearest to
    links = flagged.where("_asked is not null and parent_id is not null").select(
        F.col("id").alias("_root"), F.col("parent_id").alias("root_parent")
    )
    above = links.join(
        near.select(F.col("id").alias("root_parent"), F.col("root").alias("_above")), "root_parent"
    ).select(F.col("_root").alias("id"), F.col("_above").alias("parent_id"))
    pairs = closure(asked.select(F.col("_asked").alias("id")).join(above, "id", "left"))
    out = near.join(pairs.select("ancestor", F.col("node").alias("root")), "root")
    return out.select(F.col("ancestor").alias("root"), "id").distinct()


def _grams(text, length: int):
    """All distinct pieces of this many characters of a text."""
    last = F.length(text) - length + 1
    return F.when(
        last > 0,
        F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(text, k, F.lit(length))))
    )


def containing(texts: DataFrame, identities: DataFrame, key: str, text: str, identity: str) -> DataFrame:
    """The rows of `texts` and `identities` of one `key` where the text holds the identity.

    An identity is looked up by that of its pieces of GRAM characters (all of it, if shorter) which the fewest
    identities of its key share, so pairs that share no such piece never meet. Empty identities are in no text.
    """
    named = identities.where(F.col(identity) != "").withColumn("_n", F.least(F.length(identity), F.lit(GRAM)))
    counts = {r["_n"]: r["count"] for r in named.groupBy("_n").count().collect()}
    lengths = sorted(counts)
    if not lengths:
        return texts.join(identities, key).limit(0)
    by_length = lambda c: F.coalesce(*(F.when(F.col("_n") == n, _grams(c, n)) for n in lengths))
    mine = named.select(key, F.col(identity).alias("_identity"), "_n").distinct()
    mine = mine.withColumn("_gram", F.explode(by_length(F.col("_identity"))))
    shared = mine.groupBy(key, "_n", "_gram").agg(F.count(F.lit(1)).alias("_shared"))
    rarest = mine.join(_by_sorting(shared), [key, "_n", "_gram"]).groupBy(key, "_identity").agg(
        F.min(F.struct("_shared", "_gram")).alias("_r")
    ).select(key, F.col("_identity").alias(identity), F.xxhash64(key, "_r._gram").alias("_gram"))
    pieces = F.concat(*(F.coalesce(_grams(F.col(text), n), F.array().cast("array<string>")) for n in lengths))
    # hashes of a piece and of its text meet; the texts of a hash are looked at afterwards
    hashed = F.xxhash64(text).alias("_hash")
    cut = texts.select(key, text).distinct().select(
        hashed, F.explode(F.array_distinct(F.transform(pieces, lambda g: F.xxhash64(key, g)))).alias("_gram")
    )
    # pieces are many times the identities: they pass by a bounded number of these in each task, and are not sorted
    n = max(texts.sparkSession.sparkContext.defaultParallelism, sum(counts.values()) // NAMED)
    sought = rarest.repartition(n, "_gram").hint("shuffle_hash")
    near = cut.repartition(n, "_gram").join(sought, "_gram").select(key, "_hash", identity)
    near = near.repartition(n, key, "_hash").distinct()
    found = texts.select("*", hashed).join(_by_sorting(near), [key, "_hash"]).where(
        F.contains(F.col(text), F.col(identity))
    )
    return found.join(_by_sorting(named.drop("_n")), [key, identity]).drop("_hash")


def spawn_matches(calls: DataFrame, children: DataFrame) -> DataFrame:
    """Spawn calls and child sessions of a parent, one to one: a call's text holds an identity of the child (a child
    may have a row for each). In the calls' order each takes the first child that is left. Calls: parent, call_id,
    haystack, ordinal; children: parent, child, identity, ordinal.

    A pair where each is the other's first is sure; the rest is matched again without it. Every round fixes at least
    the earliest open call of each parent, and mostly all of them.
    """
    c = calls.select("parent", "call_id", "haystack", F.col("ordinal").alias("_a"))
    d = children.select("parent", "child", "identity", F.col("ordinal").alias("_b"))
    pairs = containing(c, d, "parent", "haystack", "identity")
    pairs = _durable(pairs.groupBy("parent", "call_id", "child").agg(F.min("_a").alias("_a"), F.min("_b").alias("_b")))
    found = pairs.limit(0).select("parent", "call_id", "child")
    while not pairs.isEmpty():
        first = pairs.groupBy("parent", "call_id").agg(F.min(F.struct("_b", "child")).alias("x"))
        second = pairs.groupBy("parent", "child").agg(F.min(F.struct("_a", "call_id")).alias("y"))
        both = first.select("parent", "call_id", F.col("x.child").alias("child")).join(
            _by_sorting(second.select("parent", "child", F.col("y.call_id").alias("_call"))), ["parent", "child"]
        )
        sure = _durable(both.where("call_id = _call").select("parent", "call_id", "child"))
        found = found.unionByName(sure)
        for key in ("call_id", "child"):
            pairs = pairs.join(_by_sorting(sure.select("parent", key)), ["parent", key], "left_anti")
        pairs = _durable(pairs)
    return found


def session_edges(sessions: DataFrame, calls: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, losses) of every parent and child. Sessions: id, parent_id, association, agent_id, agent_path, agent_type;
    calls: session, call_id, message_id, result_id, ordinal, input (JSON), output, status, of those that spawn agents.

    A child belongs to the first call in order that names its id, agent or path and is not another's; its edge is then
    sure. Others are edges by the registry or by their header, and a loss where their parent made any spawn call.
    Edges are numbered as children are listed: by their call, those without one last by path and id.
    """
    child = sessions.where("parent_id is not null and parent_id <> id")
    child = child.join(
        _by_sorting(sessions.select(F.col("id").alias("parent_id")).distinct()), "parent_id", "left_semi"
    )
    rank = F.row_number().over(
        Window.partitionBy("parent_id").orderBy(F.coalesce("agent_path", F.lit("")), "id")
    ).cast("long")
    child = _durable(child.withColumn("listed", rank))
    names = child.select(
        F.col("parent_id").alias("parent"),
        F.col("id").alias("child"),
        F.col("listed").alias("ordinal"),
        F.explode(F.array("id", "agent_id", "agent_path")).alias("identity")
    )
    haystack = F.concat_ws("\n", "input", "output")
    made = calls.select(F.col("session").alias("parent"), "call_id", haystack.alias("haystack"), "ordinal")
    matched = spawn_matches(made, names.where("identity is not null and identity <> ''"))
    states = F.create_map(*(F.lit(x) for kv in EDGE_STATES.items() for x in kv))
    of_call = calls.select(
        F.col("session").alias("parent_id"),
        "call_id",
        "message_id",
        "result_id",
        F.col("ordinal").alias("call_at"),
        F.get_json_object("input", "$.prompt").alias("prompt"),
        F.try_element_at(states, F.col("status")).alias("call_state")
    )
    of_call = of_call.join(
        _by_sorting(matched.select(F.col("parent").alias("parent_id"), "call_id", F.col("child").alias("id"))),
        ["parent_id", "call_id"]
    )
    told = registry.groupBy(F.col("child").alias("id")).agg(F.max("status").alias("told"))
    e = child.join(_by_sorting(of_call), ["parent_id", "id"], "left").join(_by_sorting(told), "id", "left")
    sure = F.col("call_id").isNotNull()
    place = F.row_number().over(
        Window.partitionBy("parent_id").orderBy(F.asc_nulls_last("call_at"), "listed")
    ).cast("long")
    by = F.when(sure, "spawn-call").otherwise(F.coalesce("association", F.lit("parent-metadata")))
    confidence = F.when(sure, SPAWNED).when(F.col("association") == "sqlite-parent", BY_REGISTRY).otherwise(BY_HEADER)
    edges = e.select(
        F.col("parent_id").alias("session"), place.alias("ordinal"), F.col("id").alias(
            "child_session_id"
        ), F.col("call_id").alias("source_call_id"),
        F.col("message_id").alias("spawn_message_id"), F.col("result_id").alias(
            "result_message_id"
        ), "agent_id", "agent_path", "agent_type",
        F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce(
            "call_state", "told"
        ).alias("status"), by.alias("association"), confidence.alias("confidence"),
    )
    spawning = calls.select("session").distinct()
    lost = edges.where("source_call_id is null").join(_by_sorting(spawning), "session", "left_semi")
    return edges, lost.select(
        "session", F.lit("session.subagent_unlinked").alias("code"), F.col("child_session_id").alias("detail")
    )
