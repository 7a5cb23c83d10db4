"""References in nested JSON, handles over generations, settled changes in any cut of a stream."""

import json
import os
import random

from pyspark.sql import functions as F

from quern.operators import records as R
from quern.operators import references as RF
from quern.streaming import settled as S


def test_references_at_any_depth(spark):
    deep = json.dumps({"output": json.dumps([{"x": {"thread_id": "d"}}])})
    for _ in range(3):
        deep = json.dumps({"arguments": deep})
    records = [
        ("s", json.dumps({"thread_id": "a", "other": "b", "list": [{"threadId": ["c", ["e"], {"none": "f"}]}]})),
        ("s", deep), ("s", '{"input": "{\\"session_id\\": \\"g\\"}", "text": "{\\"session_id\\": \\"h\\"}"}'),
        ("t", '{"state": "[1, {torn", "metadata": " {\\"thread_id\\": \\"a\\"}", "forked_from_id": 7}'), ("t", None), ("t", "{torn"), ("u", '"a"'),
    ]
    known = spark.createDataFrame([(x,) for x in "abcdefgh"], "id string")
    got = RF.thread_references(spark.createDataFrame(records, "session string, raw string"), known)
    assert sorted(tuple(r) for r in got.select("session", "ref").collect()) == [("s", "a"), ("s", "c"), ("s", "d"), ("s", "e"), ("s", "g")]
    assert RF.thread_references(spark.createDataFrame([], "session string, raw string"), known).collect() == []


def test_pruning_takes_whole_subtrees_of_direct_children(spark):
    nodes = spark.createDataFrame([("p", None), ("a", "p"), ("b", "p"), ("a1", "a"), ("a2", "a1"), ("b1", "b"), ("q", None), ("q1", "q")], "id string, parent_id string")
    names = spark.createDataFrame([("a",), ("b1",), ("q1",), ("zz",)], "ref string")
    kept, removed = RF.pruned(nodes, spark.createDataFrame([("p",)], "id string"), names)
    assert {r.id for r in removed.collect()} == {"a", "a1", "a2"} and {r.id for r in kept.collect()} == {"p", "b", "b1", "q", "q1"}


def test_a_returned_session_keeps_its_handle(spark):
    log = spark.createDataFrame([], "tool string, session string, handle string, generation int, present boolean")
    for generation, active in enumerate(("ab", "b", "abc", "abc"), 1):
        new = R.handle_log(log, spark.createDataFrame([("t", x) for x in active], "tool string, session string"), generation)
        log = spark.createDataFrame(log.unionByName(new).collect(), log.schema)
    assert log.count() == 5
    at = lambda g: {r.session: (r.handle, r.present, r.since) for r in R.handles_as_of(log, g).collect()}
    assert at(2)["a"][1:] == (False, 2) and at(3)["a"][1:] == (True, 3) and at(1)["a"][0] == at(4)["a"][0]
    assert set(at(2)) == {"a", "b"} and at(4)["b"][1:] == (True, 1)


def test_rules_of_settled_changes():
    state, out = (None,) * 4, []
    for at, token in ((0, "x"), (2500, "x"), (5000, "y"), (7500, "z"), (10_000, "z"), (12_500, "a"), (15_000, "b"), (20_000, "c"), (27_500, "d"), (30_000, "d"), (32_500, None), (310_000, "d")):
        state, reason = S.decided(state, at, token, False)
        if reason:
            out.append((at, reason))
    assert out == [(10_000, "settled"), (27_500, "overdue"), (310_000, "reconcile")]
    state, reason = S.decided(state, 313_000, "d", True)
    assert reason is None and S.decided(state, 315_000, "d", True)[1] == "reconcile"


def test_any_cut_into_batches_decides_the_same(spark, tmp_path):
    rng, rows = random.Random(2), []
    for k in range(240):
        rows.append((f"s{k % 3}", k * 900, rng.choice([None, "a", "a", "b", "c"]), rng.random() < 0.05))
    schema = "source string, at_ms long, token string, nudge boolean"
    want = sorted(map(tuple, S.settled_changes(spark.createDataFrame(rows, schema)).collect()))
    assert want
    for cut in (7, 60):
        path = tmp_path / f"in{cut}"
        path.mkdir()
        for n, lo in enumerate(range(0, len(rows), cut)):
            lines = [json.dumps(dict(zip(("source", "at_ms", "token", "nudge"), r, strict=True))) for r in rows[lo : lo + cut]]
            (path / f"{n:04d}.json").write_text("\n".join(lines))
            os.utime(path / f"{n:04d}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # the order of arrival
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{path}")
        query = S.settled_changes(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out{cut}").option("checkpointLocation", f"file://{tmp_path}/at{cut}").trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = spark.read.parquet(f"file://{tmp_path}/out{cut}").select("source", "at_ms", "reason", "token")
        assert sorted(map(tuple, got.collect())) == want
        assert got.where(F.col("reason") == "settled").count() > 0


def test_polls_do_not_depend_on_the_zone_of_the_session(spark, tmp_path):
    from quern.queries import queries

    hours = [(k, "2024-03-10 %02d:30:00.250" % (k // 4), 7, "ab"[k // 3 % 2]) for k in range(24)] + [(99, "2024-03-10 00:00:00", None, "a")]
    events = spark.createDataFrame(hours, "event_id long, ts string, user_id long, event_type string")
    events.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    run = lambda: sorted(map(tuple, queries()["settled_changes"](spark, str(tmp_path)).collect()))
    want, zone = run(), spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # no hour from 2 to 3 on that day
        assert run() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r[1] for r in want} >= {360} and {r[0] for r in want} == {"7"}
