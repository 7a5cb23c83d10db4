"""Session trees as adjacency tables: closure, roll-ups, cycles, branches, shape."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder that the session names; for local masters it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file:///tmp/checkpoints/quern"
    return f"{root.rstrip('/')}/tree-{uuid.uuid4().hex}"


def _durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again."""
    return _counted(df, None)[0]


def _counted(df: DataFrame, column: str | None) -> tuple[DataFrame, int]:
    """_durable, and how many values of `column` are not null, counted while they are written."""
    spark: SparkSession = df.sparkSession
    path = scratch(spark)
    seen = Observation()
    (df if column is None else df.observe(seen, F.count(column).alias("n"))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), 0 if column is None else seen.get["n"]


def closure(nodes: DataFrame, node: str = "id", parent: str = "parent_id", rounds: int = 40) -> DataFrame:
    """(ancestor, node, depth) with each node its own ancestor at depth 0, by doubling: after r rounds every pair up
    to 2^r apart is there, so deep chains take few joins. A node of a cycle ends at itself."""
    step = nodes.select(
        F.col(parent).alias("ancestor"), F.col(node).alias("node"), F.lit(1).cast("long").alias("depth")
    ).where("ancestor is not null and ancestor <> node")
    pairs, count = _durable(step), -1
    for round_no in range(rounds + 1):
        n = pairs.count()
        if n == count:
            break
        if round_no == rounds:
            raise RuntimeError(f"the closure is not complete after {rounds} rounds")
        count = n
        left, right = pairs.alias("l"), pairs.alias("r")
        longer = left.join(right, F.col("l.node") == F.col("r.ancestor")).select(
            F.col("l.ancestor"), F.col("r.node"), (F.col("l.depth") + F.col("r.depth")).alias("depth")
        ).where("ancestor <> node")
        pairs = _durable(pairs.unionByName(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
    own = nodes.select(F.col(node).alias("ancestor"), F.col(node).alias("node"), F.lit(0).cast("long").alias("depth"))
    return pairs.unionByName(own)


def _doubled(state: DataFrame, sums: list[str], maxima: list[str]) -> DataFrame:
    """One round: (node, up, top, depth, ...) with `up` the ancestor 2^k steps above becomes that 2^(k + 1) above, and
    what is folded over the nearest 2^k levels below a node becomes that of twice as many."""
    below = [F.sum(c).alias(f"_{c}") for c in sums] + [F.max(c).alias(f"_{c}") for c in maxima]
    if below:
        given = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(*below)
        both = state.join(given, "node", "left")
        more = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {c: F.greatest(c, f"_{c}") for c in maxima}
    else:
        both, more = state, {}
    far = state.select(
        F.col("node").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("depth").alias("_depth")
    )
    moved = both.where("up is not null").join(far, "up")
    step = (F.col("reach") + F.col("_depth")).alias("depth")
    kept = [more.get(c, F.col(c)).alias(c) for c in [*sums, *maxima]]
    moved = moved.select(
        "node", F.col("_up").alias("up"), F.col("_top").alias("top"), step, (2 * F.col("reach")).alias("reach"), *kept
    )
    still = both.where("up is null").select("node", "up", "top", "depth", "reach", *kept)
    return moved.unionByName(still)


def _placed(state: DataFrame, start: DataFrame) -> DataFrame:
    return state.drop("up", "reach").join(start.select("node", F.col("up").alias("parent")), "node")


def forest(
    nodes: DataFrame, node: str = "id", parent: str = "parent_id", sums: dict | None = None, maxima: dict | None = None
) -> DataFrame:
    """Every node once (node), with its parent in the forest (`parent`, null for a root), its root (`top`), its `depth`,
    and for each name in `sums` and `maxima` the sum or maximum of a column expression over its subtree.

    A parent that is unknown, or the node itself, makes a root, and so does being a member of a cycle. Of rows that share
    an id the greatest counts; rows without one are left out; an empty table gives no rows. Pointers are
    doubled with partial sums beside them: nodes times the logarithm of the depth, never pairs of nodes.
    """
    sums, maxima = sums or {}, maxima or {}
    values = [v.alias(k) for k, v in (sums | maxima).items()]
    own = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up"), *values)
    # a repeated id would double in every join
    own = own.groupBy("node").agg(
        F.max(F.struct(*(c for c in own.columns if c != "node"))).alias("r")
    ).select("node", "r.*")
    known = own.select(F.col("node").alias("_known")).distinct()
    own = own.join(known, F.col("up") == F.col("_known"), "left").withColumn(
        "up", F.when(F.col("_known") != F.col("node"), F.col("_known"))
    ).drop("_known")
    own, n = _counted(own, "node")
    cut = None
    while True:
        start = own if cut is None else own.join(cut, "node", "left").withColumn(
            "up", F.when(F.col("_in_cycle").isNull(), F.col("up"))
        ).drop("_in_cycle")
        one = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
        state = start.select(
            "node",
            "up",
            F.coalesce("up", "node").alias("top"),
            one.alias("depth"),
            F.lit(1).cast("long").alias("reach"),
            *sums,
            *maxima
        )
        reach, left = 1, n
        while reach <= n and left:
            state, left = _counted(_doubled(state, list(sums), list(maxima)), "up")
            reach *= 2
        if not left:
            return _placed(state, start)
        # more steps than nodes: whoever is still reached lies on a cycle
        circles = state.where("up is not null").select(F.col("up").alias("node")).distinct()
        cut = _durable(circles.withColumn("_in_cycle", F.lit(True)))


def settled(hops: DataFrame) -> DataFrame:
    """(node, up) with `up` the first on the way up that is not itself a node of `hops` (node, up); null where the way
    ends or runs in a circle. Ways are halved each round, so long ones take few joins."""
    now, reach = _durable(hops.select("node", "up")), 1
    n = now.count()
    while True:
        far = now.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        open_ways = now.join(far, F.col("up") == F.col("_node"))
        if open_ways.isEmpty():
            return now
        if reach > n:
            circling = open_ways.select(F.col("node").alias("_node")).distinct()
            both = now.join(circling, F.col("node") == F.col("_node"), "left")
            return both.select("node", F.when(F.col("_node").isNull(), F.col("up")).alias("up"))
        both = now.join(far, F.col("up") == F.col("_node"), "left")
        now = _durable(
            both.select("node", F.when(F.col("_node").isNotNull(), F.col("_up")).otherwise(F.col("up")).alias("up"))
        )
        reach *= 2


def rollup(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Sums of count and size and the newest update over each subtree; tokens are the node's own."""
    values = {
        "count": F.col("count").cast("long"), "size": F.col("size").cast("long"), "tree_count": F.lit(1).cast("long")
    }
    tree = forest(nodes, node, parent, values, {"updated": F.col("updated")})
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("child_count")
    )
    tokens = nodes.select(F.col(node).alias("node"), "tokens")
    out = tree.join(children, "node", "left").join(tokens, "node")
    return out.select(
        F.col("node").alias(node),
        "tokens",
        "count",
        "size",
        "updated",
        "tree_count",
        F.coalesce("child_count", F.lit(0)).cast("long").alias("child_count")
    )


def roots(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes without a known parent, and every member of a cycle."""
    return forest(nodes, node, parent).where("parent is null").select(F.col("node").alias(node))


def active_branch(records: DataFrame, session: str, node: str, parent: str, order: str) -> DataFrame:
    """The path from the last record of each session up to its root, in order from the root; sessions may use the same
    ids. Where records share an id the last is followed; a path ends at a root, at an unknown parent or where it would
    meet a node again.

    Pointers are doubled (the parent, the 2nd, 4th, ... ancestor of every record). The leaf's ancestor at each distance
    is then found by the pointers of the distance's binary digits: records times the logarithm of the longest session,
    never all pairs.
    """
    last = F.max_by(F.struct(F.col(node).alias("node"), F.col(parent).alias("up")), order).alias("r")
    nodes = records.where(F.col(node).isNotNull()).groupBy(
        session, F.col(node).alias("_id")
    ).agg(last, F.max(order).alias("_at"))
    nodes = _durable(nodes.select(F.col(session).alias("s"), "r.node", "r.up", "_at"))
    leaves = nodes.groupBy("s").agg(F.max_by("node", "_at").alias("node"), F.count(F.lit(1)).alias("n"))
    longest = nodes.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    path = leaves.select("s", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("depth"))
    known = nodes.select("s", F.col("node").alias("up"))
    pointer, k = nodes.select("s", "node", "up").join(known, ["s", "up"]).select("s", "node", "up"), 0
    while 2**k < longest:
        pointer = _durable(pointer)
        digit = F.shiftright("depth", k).bitwiseAND(1).cast("int")
        hop = pointer.withColumn("hops", F.lit(1))
        path = path.withColumn("hops", digit).join(hop, ["s", "node", "hops"], "left")
        path = path.select(
            "s", F.when(F.col("hops") == 1, F.col("up")).otherwise(F.col("node")).alias("node"), "depth"
        ).where("node is not null")
        further = pointer.alias("a").join(
            pointer.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.up") == F.col("b.node"))
        )
        pointer, k = further.select("a.s", "a.node", "b.up"), k + 1
    path = path.groupBy("s", "node").agg(F.min("depth").alias("depth"))
    step = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("depth"))).cast("long")
    return path.select(F.col("s").alias(session), F.col("node").alias(node), step.alias("step"))


def relinked(nodes: DataFrame, removed: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Surviving nodes with their nearest surviving ancestor as parent; null where there is none."""
    gone = removed.select(F.col(node).alias("_gone")).distinct()
    hops = nodes.select(
        F.col(node).alias("node"), F.col(parent).alias("up")
    ).join(gone, F.col("node") == F.col("_gone"), "left_semi")
    near = settled(hops).select(F.col("node").alias("_from"), F.col("up").alias("_near"))
    known = nodes.select(F.col(node).alias("_known")).distinct()
    alive = nodes.join(
        gone, F.col(node) == F.col("_gone"), "left_anti"
    ).join(near, F.col(parent) == F.col("_from"), "left")
    alive = alive.withColumn(parent, F.when(F.col("_from").isNotNull(), F.col("_near")).otherwise(F.col(parent)))
    out = alive.join(known, F.col(parent) == F.col("_known"), "left").withColumn(parent, F.col("_known"))
    return out.select(*(c for c in nodes.columns if c != parent), parent)


def shape(nodes: DataFrame, label: str, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """An order-free digest of each tree: equal where the trees have equal labels level by level under equal parents.
    Digests are folded upwards one level at a time, so the number of joins is the height of the tallest tree."""
    placed = forest(nodes, node, parent).select(
        F.col("node").alias(node), F.col("parent").alias(parent), F.col("depth").alias("level")
    )
    now = _durable(
        nodes.select(node, label).join(placed, node).select(
            node, parent, "level", F.sha2(F.col(label), 256).alias("digest")
        )
    )
    top = now.agg(F.max("level")).first()[0] or 0
    for level in range(top, 0, -1):
        kids = now.where(F.col("level") == level).groupBy(F.col(parent).alias("_p")).agg(
            F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("kids")
        )
        now = now.join(kids, now[node] == kids["_p"], "left").select(
            node,
            parent,
            "level",
            F.when(
                F.col("kids").isNotNull(), F.sha2(F.concat_ws("|", "digest", "kids"), 256)
            ).otherwise(F.col("digest")).alias("digest")
        )
        now = _durable(now)
    return now.where("level = 0").select(node, "digest")
