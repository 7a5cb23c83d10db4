"""Queries over sessions, messages and records that are derived from the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import agents as A
from ..operators import content_index as I
from ..operators import edits as E
from ..operators import library as L
from ..operators import preview as PV
from ..operators import migration as K
from ..operators import records as R
from ..operators import references as RF
from ..operators import search as S
from ..operators import sessions as C
from ..operators import tools as TL
from ..operators import topology as G
from ..sources import canonical as N
from ..sources import updates as N2
from ..streaming import settled as ST
from .catalog import load, query

# stand-ins: a conversation is a session, its rows are messages -----------------------------------

_MESSAGES = """
    msg AS (SELECT concat('c', conv_id) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message, role, text, concat('m', conv_id, '.', turn) AS source_id FROM conversations),
    num AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY message ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM msg)"""
_SESSIONS = """
    ses AS (SELECT concat('c', conv_id) AS session, CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'pi' END AS tool, substr(min_by(text, turn), 1, 40) AS title,
                   concat('/w/P', conv_id % 5) AS dir, concat('model-', conv_id % 4) AS model, 1700000000000 + conv_id * 7200000 AS updated, CAST(sum(strlen(text)) AS BIGINT) AS size, count(*) AS count
            FROM conversations GROUP BY conv_id)"""


def messages(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    w = C.Window.partitionBy("conv_id").orderBy("turn")
    return c.select(
        F.concat(F.lit("c"), "conv_id").alias("session"),
        F.row_number().over(w).cast("long").alias("message"),
        "role",
        "text",
        F.concat(F.lit("m"), F.concat_ws(".", "conv_id", "turn")).alias("source_id")
    )


def sessions(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.substring(F.min_by("text", "turn"), 1, 40).alias("title"),
        F.sum(F.octet_length("text")).cast("long").alias("size"),
        F.count(F.lit(1)).alias("count")
    )
    k = F.col("conv_id")
    tool = F.when(k % 3 == 0, "claude").when(k % 3 == 1, "codex").otherwise("pi")
    return c.select(
        F.concat(F.lit("c"), k).alias("session"),
        tool.alias("tool"),
        "title",
        F.concat(F.lit("/w/P"), k % 5).alias("dir"),
        F.concat(F.lit("model-"), k % 4).alias("model"),
        (F.lit(1_700_000_000_000) + k * 7_200_000).alias("updated"),
        "size",
        "count"
    )


# search ------------------------------------------------------------------------------------------

_TFM = "CAST((length(lower(text)) - length(replace(lower(text), 'thea', ''))) / 4 AS BIGINT)"


@query(f"""
    WITH {_MESSAGES}, {_SESSIONS},
    d AS (SELECT *, CAST(length(text) AS DOUBLE) AS size, {_TFM} AS tf FROM num),
    st AS (SELECT count(*) AS n, avg(size) AS a, count(CASE WHEN tf > 0 THEN 1 END) AS df FROM d),
    sc AS (SELECT session, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a)) AS score FROM d CROSS JOIN st WHERE tf > 0),
    hit AS (SELECT session, count(*) AS k, max(score) AS best FROM sc GROUP BY 1),
    m AS (SELECT ses.*, hit.k, hit.best, contains(lower(concat_ws(' ', title, dir, tool, model)), 'thea') AS meta FROM ses LEFT JOIN hit USING (session)),
    r AS (SELECT *, CASE WHEN k IS NOT NULL AND meta THEN 0 WHEN k IS NOT NULL THEN 1 ELSE 2 END AS grp FROM m WHERE k IS NOT NULL OR meta),
    p AS (SELECT *, count(*) OVER () AS total_matches, row_number() OVER (ORDER BY grp, best DESC NULLS LAST, updated DESC, session) AS place FROM r)
    SELECT CAST(place AS INTEGER) AS place, session, tool, title, updated, k AS content_match_count, concat_ws('+', CASE WHEN meta THEN 'metadata' END, CASE WHEN k IS NOT NULL THEN 'content' END) AS matched_in,
           total_matches, total_matches > least(20, total_matches) AS has_more FROM p WHERE place <= 20""")
def search_sessions(spark, sf_dir):
    out = C.search_sessions(sessions(spark, sf_dir), messages(spark, sf_dir), "thea")
    return out.select(
        "place",
        "session",
        "tool",
        "title",
        "updated",
        "content_match_count",
        F.array_join("matched_in", "+").alias("matched_in"),
        "total_matches",
        "has_more"
    )


@query(f"""
    WITH {_MESSAGES}, {_SESSIONS}, h AS (SELECT session, count(*) AS k, min(message) AS first FROM msg WHERE regexp_matches(text, 'tion[a-z]*[.]') GROUP BY 1),
    m AS (SELECT ses.*, k, first FROM ses JOIN h USING (session) WHERE lower(dir) IN ('/w/p1', '/w/p3') AND updated >= 1700000000000),
    p AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN regexp_matches(concat_ws(' ', title, dir, tool, model), 'tion[a-z]*[.]') THEN 0 ELSE 1 END, updated DESC, session) AS place FROM m)
    SELECT CAST(place AS INTEGER) AS place, session, k AS content_match_count, first AS first_message FROM p WHERE place <= 10""")
def search_sessions_regex(spark, sf_dir):
    out = C.search_sessions(
        sessions(spark, sf_dir),
        messages(spark, sf_dir),
        regex="tion[a-z]*[.]",
        scope="content",
        projects=["/w/p1", "/W/P3"],
        start=1_700_000_000_000,
        limit=10
    )
    return out.select(
        "place", "session", "content_match_count", F.get("rows", F.lit(0))["message"].alias("first_message")
    )


@query(f"""
    WITH {_SESSIONS}, m AS (SELECT * FROM ses WHERE contains(lower(concat_ws(' ', title, dir, tool, model)), 'codex') AND contains(lower(concat_ws(' ', title, dir, tool, model)), 'p2') AND tool = 'codex'),
    p AS (SELECT *, row_number() OVER (ORDER BY updated DESC, session) AS place FROM m)
    SELECT CAST(place AS INTEGER) AS place, session, dir, 'metadata' AS matched_in, CAST(0 AS BIGINT) AS match_count, '' AS snippet FROM p WHERE place <= 20""")
def search_result_rows(spark, sf_dir):
    found = C.search_sessions(
        sessions(spark, sf_dir), messages(spark, sf_dir), "codex p2", scope="metadata", agents=["codex"]
    )
    return C.result_rows(found).select(
        "place", "session", "dir", F.array_join("matched_in", "+").alias("matched_in"), "match_count", "snippet"
    )


# an index that is synced three times: first all sessions of before, then removals and changes, then what was left ----

_SEARCH = """
    d AS (SELECT *, CAST(length(text) AS DOUBLE) AS size, CAST((length(lower(text)) - length(replace(lower(text), 'thea', ''))) / 4 AS BIGINT) AS tf FROM num),
    st AS (SELECT count(*) AS n, avg(size) AS a, count(CASE WHEN tf > 0 THEN 1 END) AS df FROM d),
    sc AS (SELECT session, message, text, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a)) AS score FROM d CROSS JOIN st WHERE tf > 0),
    hit AS (SELECT session, count(*) AS k, max(score) AS best FROM sc GROUP BY 1)"""


def tool_messages(spark, sf_dir):
    """What system messages say is what tools said."""
    m = messages(spark, sf_dir)
    said = F.col("role") == "system"
    return m.withColumn("tool_text", F.when(said, F.col("text"))).withColumn("text", F.when(~said, F.col("text")))


def synced(spark, sf_dir):
    """(path, actions of the last sync): the index knew every session by an older revision or not at all, and one more."""
    path, now = G.scratch(spark), sessions(spark, sf_dir).select(
        "tool", "session", F.md5("title").alias("revision"), "updated", "size"
    )
    k = F.xxhash64("session") % 3
    old = now.where(k != 0).withColumn("revision", F.when(k == 1, F.lit("old")).otherwise(F.col("revision")))
    more = now.where("session = 'c0'").withColumn("session", F.lit("gone"))
    said = tool_messages(spark, sf_dir)
    stale = said.withColumn(
        "text", F.when(F.xxhash64("session") % 3 == 1, F.lit("thea as it was")).otherwise(F.col("text"))
    )
    I.sync(spark, path, old.unionByName(more), stale, 1_000_000, 1 << 40)
    I.sync(spark, path, now, said, 20, 1 << 40)
    return path, I.sync(spark, path, now, said, 1_000_000, 1 << 40)


@query(f"""
    WITH {_MESSAGES}, {_SESSIONS}, {_SEARCH},
    r AS (SELECT session, updated, k, best, row_number() OVER (ORDER BY best DESC, updated DESC, session) AS place, count(*) OVER () AS total_matches FROM ses JOIN hit USING (session))
    SELECT CAST(place AS INTEGER) AS place, session, k AS content_match_count, round(best, 9) AS score, total_matches, CAST(0 AS BIGINT) AS unindexed_sessions FROM r WHERE place <= 50""")
def search_sessions_indexed(spark, sf_dir):
    path, _ = synced(spark, sf_dir)
    blank = sessions(spark, sf_dir).withColumn("title", F.lit(""))
    out = C.search_sessions(
        blank, tool_messages(spark, sf_dir), "thea", scope="content", limit=50, budget=1 << 20, index=path
    )
    scores = C.group_score(
        tool_messages(spark, sf_dir).withColumn("_all", I.searched_text(tool_messages(spark, sf_dir))),
        "_all",
        [["thea"]]
    ).groupBy("session").agg(F.round(F.max("score"), 9).alias("score"))
    return out.join(scores, "session").select(
        "place", "session", "content_match_count", "score", "total_matches", "unindexed_sessions"
    )


@query(f"""
    WITH {_MESSAGES}, {_SESSIONS}, h AS (SELECT session, count(*) AS k, min(message) AS first FROM msg WHERE regexp_matches(text, 'thea[a-z]+ [a-z]') GROUP BY 1),
    p AS (SELECT session, k, first, row_number() OVER (ORDER BY updated DESC, session) AS place, count(*) OVER () AS total_matches FROM ses JOIN h USING (session))
    SELECT CAST(place AS INTEGER) AS place, p.session, k AS content_match_count, first AS first_message, turn AS first_turn, true AS snippet_holds_it, total_matches, true AS fewer_scanned
    FROM p JOIN num ON p.session = num.session AND p.first = num.message WHERE place <= 50""")
def search_regex_indexed(spark, sf_dir):
    """A pattern that needs Python (a named group), tried only on the sessions that may hold its literal."""
    path, _ = synced(spark, sf_dir)
    blank = sessions(spark, sf_dir).withColumn("title", F.lit("")).withColumn("model", F.lit(""))
    out = C.search_sessions(
        blank,
        tool_messages(spark, sf_dir),
        regex="(?P<before>x?)thea[a-z]+ [a-z]",
        scope="content",
        limit=50,
        budget=1 << 20,
        index=path
    )
    first, n = F.get("rows", F.lit(0)), blank.count()
    return out.select(
        "place",
        "session",
        "content_match_count",
        first["message"].alias("first_message"),
        first["turn"].alias("first_turn"),
        first["snippet"].rlike("thea[a-z]+ [a-z]").alias("snippet_holds_it"),
        "total_matches",
        (F.col("scanned_sessions") < n).alias("fewer_scanned")
    )


@query(f"WITH {_SESSIONS} SELECT tool, session, 'keep' AS action FROM ses")
def index_after_syncs(spark, sf_dir):
    """After the third sync nothing is left to do: a fourth one keeps every session."""
    path, _ = synced(spark, sf_dir)
    now = sessions(spark, sf_dir).select("tool", "session", F.md5("title").alias("revision"), "updated", "size")
    return I.sync(spark, path, now, tool_messages(spark, sf_dir)).select("tool", "session", "action")


@query(f"""
    WITH {_MESSAGES}, {_SESSIONS}, {_SEARCH},
    b AS (SELECT session, text, row_number() OVER (PARTITION BY session ORDER BY score DESC, message) AS nth FROM sc),
    a AS (SELECT session, text, strpos(lower(text), 'thea') AS pos, length(text) AS n FROM b WHERE nth = 1),
    s AS (SELECT session, concat(CASE WHEN pos > 121 THEN '…' ELSE '' END, substr(text, greatest(1, pos - 120), least(n, pos + 3 + 240) - greatest(1, pos - 120) + 1), CASE WHEN pos + 243 < n THEN '…' ELSE '' END) AS snippet FROM a),
    r AS (SELECT session, k, row_number() OVER (ORDER BY best DESC, updated DESC, session) AS place FROM ses JOIN hit USING (session))
    SELECT CAST(place AS INTEGER) AS place, r.session, k AS match_count, substr(snippet, 1, 160) AS snippet FROM r JOIN s ON r.session = s.session WHERE place <= 50""")
def search_result_snippets(spark, sf_dir):
    blank = sessions(spark, sf_dir).withColumn("title", F.lit(""))
    found = C.search_sessions(blank, messages(spark, sf_dir), "thea", scope="content", limit=50, budget=1 << 20)
    return C.result_rows(found).select("place", "session", "match_count", "snippet")


@query(
    f"WITH {_MESSAGES} SELECT session FROM msg GROUP BY session HAVING bool_or(contains(lower(text), 'thea')) AND bool_or(contains(lower(text), 'tion')) AND bool_or(contains(lower(text), 'what'))"
)
def and_across_messages(spark, sf_dir):
    return S.holding_all(messages(spark, sf_dir), "session", "text", ["thea", "tion", "what"])


@query(f"""
    WITH {_SESSIONS}, r AS (SELECT session, updated, size, sum(size) OVER (ORDER BY updated DESC, session ROWS UNBOUNDED PRECEDING) AS upto FROM ses)
    SELECT session, updated, size, CASE WHEN upto <= 20000 OR upto = size THEN 'scanned' ELSE 'skipped' END AS state FROM r""")
def scan_byte_budget(spark, sf_dir):
    return C.scan_plan(sessions(spark, sf_dir), budget=20_000)


@query(
    f"WITH {_MESSAGES} SELECT session, message, (SELECT count(*) > 25 FROM msg WHERE role = 'user') AS rows_capped FROM msg WHERE role = 'user' ORDER BY session, message LIMIT 25"
)
def hit_row_cap(spark, sf_dir):
    hits = messages(spark, sf_dir).where("role = 'user'").select("session", "message")
    return C.capped(hits, [F.col("session"), F.col("message")], 25)


@query(f"""
    WITH {_SESSIONS}, cur AS (SELECT tool, session, md5(title) AS revision, updated, size FROM ses), sto AS (SELECT tool, session, CASE WHEN tool = 'pi' THEN 'old' ELSE md5(title) END AS revision FROM ses WHERE dir <> '/w/P1' UNION ALL SELECT 'claude', 'gone', 'x'),
    st AS (SELECT coalesce(c.tool, s.tool) AS tool, coalesce(c.session, s.session) AS session, CASE WHEN s.session IS NULL THEN 'new' WHEN c.session IS NULL THEN 'missing' WHEN c.revision = s.revision THEN 'same' ELSE 'changed' END AS state, updated, size
           FROM cur c FULL JOIN sto s ON c.tool = s.tool AND c.session = s.session),
    w AS (SELECT *, row_number() OVER (ORDER BY updated DESC, tool, session) AS n, sum(size) OVER (ORDER BY updated DESC, tool, session ROWS UNBOUNDED PRECEDING) AS used FROM st WHERE state IN ('new', 'changed'))
    SELECT st.tool, st.session, CASE st.state WHEN 'same' THEN 'keep' WHEN 'missing' THEN 'remove' ELSE CASE WHEN n <= 8 AND used <= 12000 THEN 'index_now' ELSE 'index_later' END END AS action
    FROM st LEFT JOIN w ON st.tool = w.tool AND st.session = w.session""")
def index_sync(spark, sf_dir):
    current = sessions(spark, sf_dir).select(
        "tool", "session", F.md5("title").alias("revision"), "updated", "size", "dir"
    )
    stored = current.where("dir <> '/w/P1'").select(
        "tool", "session", F.when(F.col("tool") == "pi", "old").otherwise(F.col("revision")).alias("revision")
    )
    stored = stored.unionByName(spark.createDataFrame([("claude", "gone", "x")], stored.schema))
    return I.index_plan(current.drop("dir"), stored, 8, 12_000)


@query(f"""
    WITH {_SESSIONS}, i AS (SELECT sha256(concat(tool, chr(0), session)) AS handle, session, md5(title) AS revision, tool FROM ses), w AS (SELECT handle, CASE WHEN tool = 'pi' THEN 'x' ELSE revision END AS revision FROM i UNION ALL SELECT 'nothing', 'y')
    SELECT w.handle, CASE WHEN i.session IS NULL THEN 'unknown' WHEN i.revision = w.revision THEN 'found' ELSE 'stale' END AS state, i.session FROM w LEFT JOIN i ON w.handle = i.handle""")
def handle_resolution(spark, sf_dir):
    index = sessions(spark, sf_dir).select(
        C.handle(F.col("tool"), F.col("session")).alias("handle"), "session", F.md5("title").alias("revision"), "tool"
    )
    wanted = index.select("handle", F.when(F.col("tool") == "pi", "x").otherwise(F.col("revision")).alias("revision"))
    return C.resolved(wanted.unionByName(spark.createDataFrame([("nothing", "y")], wanted.schema)), index)


@query(f"""
    WITH {_SESSIONS} SELECT session FROM ses WHERE tool IN ('codex', 'pi') AND contains(lower(concat_ws(chr(10), title, dir, tool, dir, session)), 'th') AND dir = '/w/P2' AND count > 1 AND tool = 'pi'""")
def library_filter(spark, sf_dir):
    s = sessions(spark, sf_dir)
    s = s.select(
        "*",
        F.lit(None).cast("string").alias("name"),
        F.array("tool").alias("tags"),
        (F.col("dir") == "/w/P2").alias("migrated"),
        F.col("count").alias("tree_count")
    )
    return C.library(s, ["codex", "pi"], " TH ", tag="pi", repo="P2", migrated=True, children=True).select("session")


@query(
    f"WITH {_SESSIONS} SELECT session FROM ses WHERE tool = 'claude' AND lower(dir) IN ('/w/p0', '/w/p4') AND updated BETWEEN 1700000000000 AND 1700500000000"
)
def session_filters(spark, sf_dir):
    return C.restricted(
        sessions(spark, sf_dir), {"claude"}, {"/W/P0", "/w/p4"}, 1_700_000_000_000, 1_700_500_000_000
    ).select("session")


@query(f"WITH {_MESSAGES} SELECT session, message, turn FROM num WHERE role IN ('assistant')")
def role_filter(spark, sf_dir):
    return C.numbered(messages(spark, sf_dir)).where(
        F.col("role").isin("assistant")
    ).select("session", "message", "turn")


# pages and context -------------------------------------------------------------------------------


@query(f"""
    WITH {_MESSAGES}, t AS (SELECT *, count(*) OVER (PARTITION BY session) AS total FROM num),
    e AS (SELECT session, CASE WHEN 3 >= max(total) THEN max(total) ELSE coalesce(min(CASE WHEN message > 3 AND role = 'user' THEN message - 1 END), max(total)) END AS fin FROM t GROUP BY 1),
    p AS (SELECT t.*, fin FROM t JOIN e USING (session) WHERE message <= fin AND turn > 0)
    SELECT session, turn, max(CASE WHEN role = 'user' THEN md5(text) END) AS user_md5, md5(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY message), '')) AS replies_md5,
           min(message) AS first, max(message) AS last, CAST(CASE WHEN max(fin) < max(total) THEN max(fin) + 1 END AS BIGINT) AS next_from_message FROM p GROUP BY session, turn""")
def session_show(spark, sf_dir):
    out = C.shown(messages(spark, sf_dir), 1, 3)
    return out.select(
        "session",
        "turn",
        F.md5("user").alias("user_md5"),
        F.md5(F.array_join("replies", "\n")).alias("replies_md5"),
        "first",
        "last",
        "next_from_message"
    )


_COMPACTIONS = """
    cmp AS (SELECT session, concat('k', message) AS id, message AS ordinal, lag(source_id) OVER (PARTITION BY session ORDER BY message) AS after_message_id, CASE WHEN length(text) % 3 = 0 THEN 'in_progress' WHEN length(text) % 3 = 1 THEN 'incomplete' ELSE 'complete' END AS state,
                   CASE WHEN length(text) % 2 = 0 THEN 'available' ELSE 'missing' END AS summary_status, source_id AS summary_message_id, length(text) % 2 = 0 AS replaces, role FROM msg)"""


def compactions(spark, sf_dir):
    """Every system message stands for a compaction behind the message before it."""
    m, w = messages(spark, sf_dir), C.Window.partitionBy("session").orderBy("message")
    n = F.length("text") % 3
    state = F.when(n == 0, "in_progress").when(n == 1, "incomplete").otherwise("complete")
    even = F.length("text") % 2 == 0
    out = m.select(
        "session",
        F.concat(F.lit("k"), "message").alias("id"),
        F.col("message").alias("ordinal"),
        F.lag("source_id").over(w).alias("after_message_id"),
        state.alias("state"),
        F.when(even, "available").otherwise("missing").alias("summary_status"),
        F.col("source_id").alias("summary_message_id"),
        even.alias("replaces"),
        "role"
    )
    return out.where("role = 'system' or length(id) % 2 = 0").drop("role")


_CMP = "(SELECT * FROM cmp WHERE role = 'system' OR length(id) % 2 = 0)"


@query(f"""
    WITH {_SESSIONS}, {_MESSAGES}, {_COMPACTIONS}, c AS (SELECT session, bool_or(state = 'in_progress') AS p, bool_or(state = 'incomplete') AS i, count(*) AS n, max_by(summary_status, ordinal) AS s FROM {_CMP} GROUP BY 1)
    SELECT session, CASE WHEN n IS NULL THEN 'full' WHEN p THEN 'in_progress' WHEN i THEN 'incomplete' ELSE 'compacted' END AS state, coalesce(n, 0) AS compaction_count, coalesce(s, 'not_applicable') AS summary_status FROM ses LEFT JOIN c USING (session)""")
def context_status(spark, sf_dir):
    return C.context_status(sessions(spark, sf_dir), compactions(spark, sf_dir))


@query(f"""
    WITH {_MESSAGES}, {_COMPACTIONS} SELECT c.session, c.id, row_number() OVER (PARTITION BY c.session ORDER BY ordinal) AS sequence, coalesce(n.turn, 0) AS after_turn FROM {_CMP} c LEFT JOIN num n ON c.session = n.session AND c.after_message_id = n.source_id""")
def compaction_turns(spark, sf_dir):
    return C.compaction_turns(
        compactions(spark, sf_dir), messages(spark, sf_dir)
    ).select("session", "id", "sequence", "after_turn")


@query(
    f"WITH {_MESSAGES}, {_COMPACTIONS} SELECT session, message FROM msg WHERE (session, source_id) NOT IN (SELECT (session, summary_message_id) FROM {_CMP})"
)
def without_summaries(spark, sf_dir):
    return C.displayed(messages(spark, sf_dir), compactions(spark, sf_dir)).select("session", "message")


@query(
    f"WITH {_MESSAGES}, {_COMPACTIONS} SELECT session, max_by(id, ordinal) AS id, max(ordinal) AS ordinal FROM {_CMP} WHERE replaces GROUP BY 1"
)
def active_compaction(spark, sf_dir):
    return C.tail_pointer(compactions(spark, sf_dir))


@query(f"""
    WITH {_MESSAGES}, {_COMPACTIONS}, c AS (SELECT c.session, c.id, ordinal, coalesce(n.turn, 0) AS n FROM {_CMP} c LEFT JOIN num n ON c.session = n.session AND c.after_message_id = n.source_id),
    r AS (SELECT DISTINCT session, turn AS n FROM num WHERE turn > 0), g AS (SELECT session, n, string_agg(id, '+' ORDER BY ordinal) AS ids FROM c GROUP BY 1, 2),
    l AS (SELECT session, max(n) AS last FROM r GROUP BY 1),
    k AS (SELECT g.* FROM g LEFT JOIN l USING (session) WHERE n = 0 OR n > coalesce(last, 0) OR (session, n) IN (SELECT (session, n) FROM r)),
    a AS (SELECT session, n, 'round' AS kind, '' AS ids FROM r UNION ALL SELECT session, n, 'compaction', ids FROM k)
    SELECT session, row_number() OVER (PARTITION BY session ORDER BY n, kind DESC) AS place, kind, n, ids FROM a""")
def compaction_timeline(spark, sf_dir):
    m = messages(spark, sf_dir)
    rounds = C.numbered(m).where("turn > 0").select("session", F.col("turn").alias("n")).distinct()
    out = C.timeline(rounds, C.compaction_turns(compactions(spark, sf_dir), m))
    return out.select("session", "place", "kind", "n", F.array_join("ids", "+").alias("ids"))


@query(
    "SELECT concat('image/', lang) AS mime_type, substr(text, 1, 20) AS data FROM documents WHERE concat('a', doc_id) = 'a17'"
)
def session_asset(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    blocks = d.select(
        F.lit("image").alias("kind"),
        F.concat(F.lit("a"), "doc_id").alias("image_id"),
        F.concat(F.lit("image/"), "lang").alias("mime_type"),
        F.substring("text", 1, 20).alias("data"),
        F.lit("f").alias("filename")
    )
    return C.assets(blocks, "a17").select("mime_type", "data")


# scalars -----------------------------------------------------------------------------------------


@query(
    "SELECT doc_id, strlen(text) > 101 AS cut, substr(text, 1, list_max(list_filter(range(0, 102), lambda k: strlen(substr(text, 1, CAST(k AS BIGINT))) <= 101))) AS clip FROM documents"
)
def byte_clips(spark, sf_dir):
    clip, cut = X.byte_clip(F.col("text"), 101)
    return load(spark, sf_dir, "documents").select("doc_id", cut.alias("cut"), clip.alias("clip"))


@query("""
    WITH a AS (SELECT conv_id, turn, text, length(text) AS n, CASE WHEN contains(lower(text), 'thea') THEN strpos(lower(text), 'thea') END AS x, CASE WHEN contains(lower(text), 'tion') THEN strpos(lower(text), 'tion') END AS y FROM conversations),
    b AS (SELECT *, least(coalesce(x, y), coalesce(y, x)) AS pos FROM a), c AS (SELECT *, greatest(1, pos - 240) AS lo, least(n, pos - 1 + 560) AS hi FROM b)
    SELECT conv_id, turn, substr(concat(CASE WHEN lo > 1 THEN '…' ELSE '' END, substr(text, lo, hi - lo + 1), CASE WHEN hi < n THEN '…' ELSE '' END), 1, 900) AS snippet FROM c WHERE pos IS NOT NULL""")
def session_snippets(spark, sf_dir):
    snippet = X.session_snippet(F.col("text"), ["thea", "tion"])
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", snippet.alias("snippet")
    ).where("snippet is not null")


@query("""
    WITH a AS (SELECT doc_id, text, length(text) AS n, regexp_extract(text, 'ERTION!+') AS m FROM documents WHERE regexp_matches(text, 'ERTION!+')),
    b AS (SELECT *, greatest(1, strpos(text, m) - 120) AS lo, least(n, strpos(text, m) - 1 + length(m) + 240) AS hi FROM a)
    SELECT doc_id, concat(CASE WHEN lo > 1 THEN '…' ELSE '' END, substr(text, lo, hi - lo + 1), CASE WHEN hi < n THEN '…' ELSE '' END) AS snippet FROM b""")
def regex_snippets(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", X.regex_snippet(F.col("text"), S.regex_span(F.col("text"), "ERTION!+")).alias("snippet")
    ).where("snippet is not null")


@query(
    """SELECT doc_id, sha256(concat('{"file_identity":null,"ref":"', source, '/', doc_id, '","size":', n_chars, ',"tool":"', lang, '","updated":', doc_id * 10, '}')) AS revision FROM documents"""
)
def revision_digests(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    ref = F.concat(F.col("source"), F.lit("/"), F.col("doc_id"))
    return d.select("doc_id", X.revision(F.col("lang"), ref, F.col("doc_id") * 10, F.col("n_chars")).alias("revision"))


@query(
    "SELECT conv_id, sha256(string_agg(md5(text), chr(10) ORDER BY md5(text))) AS digest FROM conversations GROUP BY 1"
)
def tree_digests(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(X.ordered_digest(F.md5("text")).alias("digest"))


@query("""
    SELECT conv_id, md5(coalesce(string_agg(CASE role WHEN 'user' THEN text WHEN 'assistant' THEN concat('{"turn":', turn, '}') END, chr(10) ORDER BY turn), '')) AS text_md5 FROM conversations GROUP BY 1""")
def tool_result_texts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "json").otherwise("image")
    block = F.struct(
        "turn",
        kind.alias("kind"),
        F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("text"),
        F.to_json(F.struct("turn")).alias("data")
    )
    blocks = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return blocks.select("conv_id", F.md5(X.result_text(F.col("blocks"))).alias("text_md5"))


@query("""
    WITH a AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role <> 'assistant' THEN text END, chr(10) ORDER BY turn), '') AS t, coalesce(string_agg(CASE WHEN role = 'assistant' THEN concat('[tool t', turn, ']', chr(10), text) END, chr(10) ORDER BY turn), '') AS u FROM conversations GROUP BY 1)
    SELECT conv_id, md5(substr(t, 1, 500)) AS text_md5, md5(substr(u, 1, 500)) AS tool_md5, length(t) > 500 OR length(u) > 500 AS clipped FROM a""")
def extracted_texts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    block = F.struct(
        "turn",
        F.when(F.col("role") == "assistant", "tool").otherwise("text").alias("kind"),
        "text",
        F.concat(F.lit("t"), "turn").alias("name"),
        F.col("text").alias("output")
    )
    out = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b")).select(
        "conv_id", X.extracted(F.col("b"), 500).alias("e")
    )
    return out.select("conv_id", F.md5("e.text").alias("text_md5"), F.md5("e.tool_text").alias("tool_md5"), "e.clipped")


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN user_id % 5 = 0 THEN 'interrupted' WHEN user_id % 4 = 0 THEN 'success' WHEN user_id % 4 = 1 THEN 'success' WHEN user_id % 4 = 2 THEN 'running' ELSE 'unknown' END AS claude,
           CASE WHEN user_id % 4 = 1 THEN CASE WHEN event_id % 3 <> 0 THEN 'error' ELSE 'success' END ELSE 'unknown' END AS grok FROM events""")
def result_states(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    k = F.col("user_id") % 4
    native = F.when(k == 1, "completed").when(k == 2, "async_launched").when(k == 3, "other")
    args = native, F.col("event_type") == "error", F.col("user_id") % 5 == 0, (F.col("event_id") % 3).cast("int")
    return e.select(
        "event_id", X.result_status("claude", *args).alias("claude"), X.result_status("grok", *args).alias("grok")
    )


@query("""
    SELECT p_partkey, 'add' AS operation, p_name AS path, NULL AS destination, CAST(0 AS BIGINT) AS hunks FROM part
    UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'move' ELSE 'update' END, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END, CAST(2 AS BIGINT) FROM part""")
def patch_operations(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    move = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("*** Move to: "), "p_type", F.lit("\n"))).otherwise("")
    patch = F.concat(
        F.lit("*** Begin Patch\n*** Add File: "),
        "p_name",
        F.lit("\n+x\n*** Update File: "),
        "p_brand",
        F.lit("\n"),
        move,
        F.lit("@@ a\n-x\n@@ b\n+y\n*** End Patch\n")
    )
    return p.select("p_partkey", F.explode(X.patch_changes(patch)).alias("c")).select("p_partkey", "c.*")


@query("""
    SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, o_orderstatus = 'F' AS flag, CASE WHEN o_orderstatus = 'F' THEN 'dangerously-disable' ELSE 'default' END AS sandbox FROM orders""")
def converted_values(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    flag = X.to_bool(F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("false"))
    return o.select(
        "o_orderkey",
        X.to_int(F.col("o_totalprice").cast("string")).alias("whole"),
        flag.alias("flag"),
        X.sandbox_policy(flag).alias("sandbox")
    )


@query("""
    SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN 'image/png' END AS mime_type, CASE WHEN page_id % 3 <> 1 THEN to_base64(encode(url)) END AS data FROM pages""")
def data_urls(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    url = F.concat(
        F.when(F.col("page_id") % 3 == 1, "data:text/plain;base64,").otherwise("data:IMAGE/PNG;base64,"),
        F.base64(F.encode("url", "UTF-8"))
    )
    return p.select(
        "page_id", X.image_of(F.regexp_replace(url, "[\r\n]", "")).alias("i")
    ).select("page_id", "i.mime_type", "i.data")


@query("""
    SELECT conv_id, turn, concat('[History: tool ', role, ' was previously invoked]', chr(10), 'Input: ', substr(text, 1, 500), chr(10), 'Result:', chr(10), CASE WHEN role = 'system' THEN '(no output)' ELSE substr(text, 1, 2000) END) AS told FROM conversations""")
def narrated_calls(spark, sf_dir):
    output = F.when(F.col("role") == "system", "").otherwise(F.col("text"))
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.narrated(F.col("role"), F.col("text"), output).alias("told")
    )


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND trim(text) <> ''")
def visible_texts(spark, sf_dir):
    text = X.visible_text(F.when(F.col("role") == "system", " \t\n").otherwise(F.col("text")))
    return load(spark, sf_dir, "conversations").where(text.isNotNull()).select("conv_id", "turn")


@query("""
    SELECT p_partkey, concat('cd ', CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9@%+=:,./_-]+') THEN p_name ELSE concat('''', replace(p_name, '''', '''"''"'''), '''') END, ' && ls') AS command FROM part""")
def workdir_commands(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", X.in_workdir(F.lit("ls"), F.col("p_name")).alias("command"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'tag' END, 'name') AS keys FROM labels"""
)
def metadata_patches(spark, sf_dir):
    rows = load(spark, sf_dir, "labels")
    entry = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    now = rows.select(
        "doc_id", entry(quality=F.col("quality").cast("string"), note=F.lit('"old"'), name=F.lit('"n"')).alias("entry")
    )
    patch = rows.select(
        "doc_id", entry(note=F.lit('""'), tag=F.when(F.col("toxic") == 1, '["x"]').otherwise("[]")).alias("entry")
    )
    order = lambda k: F.when(k == "quality", 0).when(k == "tag", 1).otherwise(2)
    out = R.patched_metadata(now, patch, ["doc_id"]).select(
        "doc_id",
        F.array_sort(F.transform(F.map_keys("entry"), lambda k: F.struct(order(k).alias("o"), k.alias("k")))).alias("s")
    )
    return out.select("doc_id", F.array_join(F.transform("s", lambda x: x["k"]), ",").alias("keys"))


@query("SELECT event_id, event_id % 4 <> 1 AS is_object FROM events")
def tool_arguments(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '{"a": 1}').when(k == 1, "[1, 2]").when(k == 2, "")
    return load(spark, sf_dir, "events").select("event_id", X.json_args(raw)[0].alias("is_object"))


@query(
    "SELECT lang, CAST(sum(least(n_chars, 4000)) AS BIGINT) AS chars, count(CASE WHEN length(text) > 4000 THEN 1 END) AS cut FROM documents GROUP BY 1"
)
def runtime_bounds(spark, sf_dir):
    part, cut = X.kept(F.col("text"), "tool_result")
    return load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.sum(F.length(part)).cast("long").alias("chars"), F.count(F.when(cut, 1)).alias("cut")
    )


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'hé' WHEN 2 THEN '' END AS text, CAST(CASE WHEN event_id % 4 = 1 THEN 3 END AS INTEGER) AS exit_code FROM events"""
)
def unwrapped_outputs(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(
        k == 0, F.to_json(F.struct(F.lit("Text").alias("type"), F.col("event_type").alias("text")))
    ).when(k == 1, '{"type":"Bash","output":[104,195,169],"exit_code":3}')
    raw = raw.when(
        k == 2, '{"type":"SearchReplace","EditsApplied":{"old":"a"}}'
    ).otherwise('{"type":"Other","text":"x"}')
    return load(spark, sf_dir, "events").select(
        "event_id", X.unwrapped(raw).alias("u")
    ).select("event_id", "u.text", "u.exit_code")


# records and migration ---------------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events")
def library_sort(spark, sf_dir):
    """All rows of a library and their places, newest first."""
    rows = load(spark, sf_dir, "events").select("event_id", "ts")
    return L.placed(rows, [F.desc_nulls_last("ts"), F.asc_nulls_last("event_id")]).select("event_id", "place")


@query(
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL AND lang IN ('en', 'de')"
)
def index_evictions(spark, sf_dir):
    index = load(spark, sf_dir, "documents").select(F.col("lang").alias("tool"), "doc_id")
    return R.evicted(index, load(spark, sf_dir, "labels"), ["doc_id"], ["en", "de"]).select("doc_id")


@query("""
    SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def message_parts(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = K.nested_parts(
        o,
        load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
        "l_orderkey",
        "l_linenumber"
    )
    return out.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.size("parts").cast("long").alias("n"),
        F.array_join(F.transform("parts", lambda p: p["l_partkey"].cast("string")), ",").alias("parts")
    )


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS migrated FROM documents")
def migrated_flags(spark, sf_dir):
    return K.flagged(
        load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), ["doc_id"], "migrated"
    )


_DIFF = "d AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'lossy' ELSE 'dropped' END AS fidelity, l_linestatus AS role, concat('r', l_partkey % 7) AS reason_code FROM lineitem)"


def differences(spark, sf_dir):
    flag = F.when(
        F.col("l_returnflag") == "A", "exact"
    ).when(F.col("l_returnflag") == "N", "lossy").otherwise("dropped")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        flag.alias("fidelity"),
        F.col("l_linestatus").alias("role"),
        F.concat(F.lit("r"), F.col("l_partkey") % 7).alias("reason_code")
    )


@query(f"WITH {_DIFF} SELECT fidelity, count(*) AS n FROM d GROUP BY 1")
def difference_counts(spark, sf_dir):
    return K.difference_counts(differences(spark, sf_dir))


@query(
    f"WITH {_DIFF} SELECT l_orderkey, l_linenumber FROM d WHERE fidelity = 'lossy' AND contains(lower(concat_ws(' ', role, fidelity, reason_code)), 'y r3')"
)
def difference_filter(spark, sf_dir):
    return K.matching_differences(differences(spark, sf_dir), "Y R3", "lossy").select("l_orderkey", "l_linenumber")


@query("""
    WITH x AS (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM x""")
def difference_groups(spark, sf_dir):
    return K.consecutive_groups(
        load(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type")
    ).select("user_id", "event_id", "group_no")


@query("""
    WITH e AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN concat('t', n_nationkey) END AS c, CASE WHEN n_nationkey % 3 = 1 THEN concat('a', n_nationkey) END AS a, CASE WHEN n_nationkey % 3 = 2 THEN concat('m', n_nationkey % 4) END AS m FROM nation)
    SELECT n_nationkey AS call, CASE WHEN n_nationkey % 3 = 2 AND (SELECT count(*) FROM e x WHERE x.n_regionkey = e.n_regionkey AND x.m = e.m) > 1 THEN NULL ELSE n_nationkey END AS edge_id FROM e""")
def agent_edge_links(spark, sf_dir):
    k = F.col("n_nationkey")
    n = load(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("session"),
        k.alias("edge_id"),
        k.alias("ordinal"),
        F.when(k % 3 == 0, F.concat(F.lit("t"), k)).alias("source_call_id"),
        F.when(k % 3 == 1, F.concat(F.lit("a"), k)).alias("agent_id"),
        F.when(k % 3 == 2, F.concat(F.lit("m"), k % 4)).alias("spawn_message_id")
    )
    edges = n.withColumn("child_session_id", F.lit(None).cast("string"))
    calls = n.select(
        "session",
        F.col("edge_id").alias("call"),
        F.col("source_call_id").alias("call_id"),
        "agent_id",
        F.col("spawn_message_id").alias("message_id")
    )
    return K.linked_edges(calls, edges).select("call", "edge_id")


# agents: nations spawn customers. A nation's calls name customers in another order than the customers are listed, some
# calls name several and some none; a tenth of the customers is known to the registry only

_AGENTS = """
    child AS (SELECT concat('c', c_custkey) AS id, CASE WHEN c_custkey % 10 <> 0 THEN concat('n', c_nationkey) END AS own, concat('n', c_nationkey) AS parent_id, c_custkey AS k, concat('/agents/', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS path FROM customer),
    call AS (SELECT parent_id, k AS ordinal, concat('call', k) AS call_id, CASE WHEN k % 4 = 3 THEN [] WHEN k % 4 = 1 THEN [path, concat('/agents/', lpad(CAST(k + 25 AS VARCHAR), 8, '0'))] ELSE [path] END AS names FROM child WHERE k % 3 <> 0)"""


def _agents(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("parent")
    )
    path = lambda k: F.concat(F.lit("/agents/"), F.lpad(k.cast("string"), 8, "0"))
    none = F.lit(None).cast("string")
    child = c.select(
        F.concat(F.lit("c"), "k").alias("id"),
        F.when(F.col("k") % 10 != 0, F.col("parent")).alias("parent_id"),
        none.alias("agent_id"),
        path(F.col("k")).alias("agent_path"),
        none.alias("agent_type")
    )
    top = c.select("parent").distinct().select(
        F.col("parent").alias("id"),
        none.alias("parent_id"),
        none.alias("agent_id"),
        none.alias("agent_path"),
        none.alias("agent_type")
    )
    registry = c.where("k % 5 = 0").select(
        F.concat(F.lit("c"), "k").alias("child"), "parent", F.lit("open").alias("status")
    )
    named = F.when(F.col("k") % 4 == 3, F.lit("")).when(
        F.col("k") % 4 == 1, F.concat_ws(" and ", path(F.col("k")), path(F.col("k") + 25))
    ).otherwise(path(F.col("k")))
    calls = c.where("k % 3 <> 0").select(
        F.col("parent").alias("session"),
        F.concat(F.lit("call"), "k").alias("call_id"),
        F.concat(F.lit("m"), "k").alias("message_id"),
        none.alias("result_id"),
        F.col("k").alias("ordinal"),
        F.to_json(F.struct(F.concat(F.lit("start "), named).alias("prompt"))).alias("input"),
        none.alias("output"),
        F.when(F.col("k") % 2 == 0, "completed").alias("status")
    )
    return top.unionByName(child), registry, calls


#: Calls in their order, each taking the first child that it names and that is left.
_MATCHED = """
    pair AS (SELECT call.parent_id, call_id, ordinal, child.id, child.path FROM call JOIN child ON call.parent_id = child.parent_id AND list_contains(names, path)),
    ord AS (SELECT parent_id, call_id, ordinal, row_number() OVER (PARTITION BY parent_id ORDER BY ordinal) AS n FROM call),
    st AS (
        SELECT parent_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS got FROM (SELECT DISTINCT parent_id FROM ord)
        UNION ALL
        SELECT s.parent_id, o.n, CASE WHEN g.id IS NULL THEN s.taken ELSE list_append(s.taken, g.id) END, o.call_id, g.id
        FROM st s JOIN ord o ON o.parent_id = s.parent_id AND o.n = s.n + 1
        LEFT JOIN LATERAL (SELECT p.id FROM pair p WHERE p.parent_id = s.parent_id AND p.call_id = o.call_id AND NOT list_contains(s.taken, p.id) ORDER BY p.path, p.id LIMIT 1) g ON true),
    hit AS (SELECT got AS id, st.call_id, ordinal FROM st JOIN ord ON st.parent_id = ord.parent_id AND st.n = ord.n WHERE got IS NOT NULL)"""


@query(f"""
    WITH RECURSIVE {_AGENTS}, {_MATCHED},
    e AS (SELECT child.*, call_id, ordinal AS call_at FROM child LEFT JOIN hit ON child.id = hit.id)
    SELECT parent_id AS session, row_number() OVER (PARTITION BY parent_id ORDER BY call_at NULLS LAST, path, id) AS ordinal, id AS child_session_id, call_id AS source_call_id,
           CASE WHEN call_id IS NOT NULL THEN 'spawn-call' WHEN own IS NULL THEN 'sqlite-parent' ELSE 'parent-metadata' END AS association,
           CASE WHEN call_id IS NOT NULL THEN 1.0::DOUBLE WHEN own IS NULL THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
           CASE WHEN call_at % 2 = 0 THEN 'closed' WHEN k % 5 = 0 THEN 'open' END AS status
    FROM e""")
def session_edges(spark, sf_dir):
    headers, registry, calls = _agents(spark, sf_dir)
    edges, _ = A.session_edges(A.parents(headers, registry), calls, registry)
    return edges.select(
        "session", "ordinal", "child_session_id", "source_call_id", "association", "confidence", "status"
    )


@query(
    f"WITH RECURSIVE {_AGENTS}, {_MATCHED} SELECT parent_id AS parent, st.call_id, got AS child FROM st WHERE got IS NOT NULL"
)
def spawn_matching(spark, sf_dir):
    headers, registry, calls = _agents(spark, sf_dir)
    edges, _ = A.session_edges(A.parents(headers, registry), calls, registry)
    return edges.where("source_call_id is not null").select(
        F.col("session").alias("parent"),
        F.col("source_call_id").alias("call_id"),
        F.col("child_session_id").alias("child")
    )


@query(
    f"WITH {_AGENTS} SELECT call.parent_id AS parent, call_id, child.id AS child FROM call JOIN child ON call.parent_id = child.parent_id AND list_contains(names, path)"
)
def spawn_candidates(spark, sf_dir):
    headers, registry, calls = _agents(spark, sf_dir)
    children = A.parents(headers, registry).where("parent_id is not null")
    names = children.select(
        F.col("parent_id").alias("parent"), F.col("id").alias("child"), F.col("agent_path").alias("identity")
    )
    return A.containing(
        calls.select(F.col("session").alias("parent"), "call_id", "input"), names, "parent", "input", "identity"
    ).select("parent", "call_id", "child")


@query("""
    SELECT r AS root, x AS id FROM (
        SELECT concat('r', n_regionkey) AS r, concat('c', c_custkey) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey) FROM nation
        UNION ALL SELECT concat('r', r_regionkey), concat('r', r_regionkey) FROM region
        UNION ALL SELECT concat('n', n_nationkey), concat('n', n_nationkey) FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer WHERE c_nationkey % 2 = 0)""")
def descendants(spark, sf_dir):
    """Regions and every other nation are asked for."""
    region = load(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")
    )
    nation = load(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id")
    )
    customer = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id")
    )
    asked = region.select("id").unionByName(
        load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(
            F.concat(F.lit("n"), "n_nationkey").alias("id")
        )
    )
    return A.descendants(region.unionByName(nation).unionByName(customer), asked)


@query("""
    SELECT concat('r', r_regionkey) AS root, 1 + count(DISTINCT n_nationkey) AS nodes, CAST(coalesce(sum(c), 0) AS BIGINT) AS messages, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS edges
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1""")
def tree_counts(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id")
    )
    region = load(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")
    )
    said = load(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("session"))
    return K.tree_counts(region.unionByName(nation), said, nation.select(F.col("parent_id").alias("session")))


@query(
    "SELECT n_nationkey, concat('new-r', n_regionkey % 3) AS region, n_name AS name FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, concat('r', n_regionkey), n_name FROM nation WHERE n_regionkey >= 3"
)
def remapped_ids(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("region"), F.col("n_name").alias("name")
    )
    ids = load(spark, sf_dir, "region").where("r_regionkey < 3").select(
        F.concat(F.lit("r"), "r_regionkey").alias("old"), F.concat(F.lit("new-r"), "r_regionkey").alias("new")
    )
    return K.remapped(rows, ["region"], ids)


@query(f"""
    WITH {_MESSAGES}, a AS (SELECT session, concat('t', turn) AS id FROM num WHERE role = 'user'), b AS (SELECT session, concat('t', turn) AS id FROM num WHERE role = 'assistant')
    SELECT session, 'unpaired_call' AS problem, id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT session, 'orphan_result', id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT session, 'unknown_parent', 'start' FROM msg WHERE message = 1""")
def edit_invariants(spark, sf_dir):
    m = C.numbered(messages(spark, sf_dir))
    w = C.Window.partitionBy("session").orderBy("message")
    records = m.select(
        "session",
        F.col("source_id").alias("uuid"),
        F.coalesce(F.lag("source_id").over(w), F.lit("start")).alias("parent")
    )
    kind = F.when(F.col("role") == "user", "tool_use").when(F.col("role") == "assistant", "tool_result")
    return K.broken_invariants(
        records, m.select("session", kind.alias("type"), F.concat(F.lit("t"), "turn").alias("id"))
    )


@query(f"""
    WITH {_MESSAGES}, k AS (SELECT session, message, source_id, lag(source_id) OVER (PARTITION BY session ORDER BY message) AS parent FROM num WHERE turn <> 2)
    SELECT session, source_id AS uuid, parent FROM k""")
def deleted_turn(spark, sf_dir):
    """The second turn of every session goes: a chain closes over it."""
    m = C.numbered(messages(spark, sf_dir))
    up = F.lag("source_id").over(C.Window.partitionBy("session").orderBy("message"))
    records = m.select(
        "session", F.col("source_id").alias("uuid"), up.alias("parent"), "turn", F.col("message").alias("at")
    )
    return E.deleted_turns(records, m.where("turn = 2").select("session", "turn")).select("session", "uuid", "parent")


@query(
    f"WITH {_MESSAGES} SELECT session, source_id AS uuid, CASE WHEN role = 'user' THEN concat('new ', message) ELSE text END AS text FROM msg"
)
def rewritten_messages(spark, sf_dir):
    """Every message has its text twice; those of users are rewritten, the others keep the first."""
    m = messages(spark, sf_dir).withColumnRenamed("source_id", "uuid")
    copies = F.when(F.col("role") == "user", F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    parts = m.select("session", "uuid", F.explode(copies).alias("part"), F.lit("text").alias("type"), "text")
    new = m.where("role = 'user'").select("session", "uuid", F.concat(F.lit("new "), "message").alias("text"))
    return E.rewritten(parts, new)[0].select("session", "uuid", "text")


@query(f"WITH {_MESSAGES} SELECT session, source_id AS edge FROM msg WHERE role = 'user' AND message <= 3")
def kept_children(spark, sf_dir):
    m = messages(spark, sf_dir)
    edges = m.where("role = 'user'").select(
        "session", F.col("source_id").alias("edge"), F.col("source_id").alias("spawn_message_id")
    )
    return K.kept_children(edges, m.where("message <= 3")).select("session", "edge")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'failed' ELSE o_orderpriority END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'EngineRestarted' END AS error_type FROM orders"""
)
def interrupted_plans(spark, sf_dir):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "queued").when(p == "2-HIGH", "applying").otherwise(p)
    plans = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        status.alias("status"),
        F.lit(None).cast("string").alias("error_type"),
        F.lit(0).cast("long").alias("updated_at")
    )
    return R.recovered(plans, 1).select("o_orderkey", "status", "error_type")


@query("""
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL OR d.doc_id % 5 = 0 OR toxic = 1 THEN 'skipped' WHEN lang = 'fr' THEN 'failed' ELSE 'succeeded' END AS outcome,
           CASE WHEN l.doc_id IS NULL THEN 'not_found' WHEN d.doc_id % 5 = 0 THEN 'revision_changed' WHEN toxic = 1 THEN 'pinned' WHEN lang = 'fr' THEN 'io' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def batch_delete_outcomes(spark, sf_dir):
    d, labels = load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels")
    rows = labels.select("doc_id", F.lit("a").alias("current"), F.when(F.col("toxic") == 1, "pinned").alias("cause"))
    asked = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "b").otherwise("a").alias("revision"))
    return R.batch_outcomes(
        asked, rows, d.where("lang = 'fr'").select("doc_id", F.lit("io").alias("error")), ["doc_id"]
    )


@query(
    "SELECT d.doc_id, CASE WHEN quality = 1 THEN md5(text) ELSE 'prior' END AS rev FROM documents d JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
)
def prior_rows_kept(spark, sf_dir):
    d = L.with_metadata(
        load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("rev")),
        load(spark, sf_dir, "labels"),
        ["doc_id"]
    )
    scanned = d.select("doc_id", "rev", F.coalesce(F.col("quality") == 1, F.lit(True)).alias("readable"))
    return R.with_prior(scanned, d.select("doc_id", F.lit("prior").alias("rev")), ["doc_id"])


@query(
    "SELECT doc_id AS path, CASE WHEN toxic = 1 THEN 'new' ELSE 'old' END AS row, CAST(CASE WHEN toxic = 1 THEN 5 ELSE 4 END AS BIGINT) AS modified_ms FROM labels"
)
def scan_cache_merge(spark, sf_dir):
    rows = load(spark, sf_dir, "labels")
    at = F.when(F.col("toxic") == 1, 5).otherwise(3).cast("long")
    old = rows.select(
        F.col("doc_id").alias("path"), F.lit("old").alias("row"), F.lit(4).cast("long").alias("modified_ms")
    )
    return R.cached_scan(
        old, rows.select(F.col("doc_id").alias("path"), F.lit("new").alias("row"), at.alias("modified_ms"))
    )


@query("SELECT event_type AS id, 'found' AS origin FROM events GROUP BY 1 UNION ALL SELECT 'own', 'user'")
def model_catalog(spark, sf_dir):
    found = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(
        F.min("event_id").alias("ordinal")
    ).withColumn("origin", F.lit("found"))
    own = spark.createDataFrame([("own", 0, "user"), ("view", 1, "user")], "id string, ordinal long, origin string")
    return R.model_list(found, own).select("id", "origin")


@query("""
    WITH p AS (SELECT DISTINCT p_brand, p_type, p_size FROM part), c AS (SELECT p_brand AS provider, p_type AS name, max(p_size) AS price FROM p GROUP BY 1, 2),
    n AS (SELECT *, dense_rank() OVER (ORDER BY provider) - 1 AS pos FROM c)
    SELECT name, CAST(arg_min(price, pos) AS DOUBLE) AS price_input, 0.0::DOUBLE AS price_output, CAST(min(pos) AS INTEGER) AS ordinal FROM n GROUP BY name""")
def price_source(spark, sf_dir):
    """Brands as providers, part types as models: the first provider's price of a model counts."""
    p = load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("price"))
    item = F.struct(
        F.col("p_type").alias("key"), F.struct(F.struct(F.col("price").alias("input")).alias("cost")).alias("value")
    )
    of = p.groupBy("p_brand").agg(F.struct(F.map_from_entries(F.collect_list(item)).alias("models")).alias("v"))
    entries = of.agg(F.array_sort(F.collect_list(F.struct("p_brand", F.to_json("v").alias("j")))).alias("e"))
    text = F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(
                "e",
                lambda x: F.concat(
                    F.to_json(F.array(x["p_brand"])).substr(F.lit(2), F.length(F.to_json(F.array(x["p_brand"]))) - 2),
                    F.lit(":"),
                    x["j"]
                )
            ),
            ","
        ),
        F.lit("}")
    )
    return R.price_list(entries.select(text.alias("json"))).select("name", "price_input", "price_output", "ordinal")


@query(
    "SELECT conv_id, turn, turn % 5 NOT IN (1, 2) AS codex, turn % 5 <> 1 AS claude FROM conversations WHERE role = 'user' AND NOT starts_with(ltrim(text), '<') AND NOT starts_with(ltrim(text), '[')"
)
def turn_starts(spark, sf_dir):
    """Users' words, some of which begin as words that a tool puts there."""
    c = load(spark, sf_dir, "conversations").where(
        "role = 'user' and not startswith(ltrim(text), '<') and not startswith(ltrim(text), '[')"
    )
    text = F.when(
        F.col("turn") % 5 == 1, F.concat(F.lit(" <note>"), "text")
    ).when(F.col("turn") % 5 == 2, F.concat(F.lit("[note]"), "text")).otherwise(F.col("text"))
    starts = lambda tool: R.turn_start(tool, F.col("role"), F.lit("text"), text).alias(tool)
    return c.select("conv_id", "turn", starts("codex"), starts("claude"))


@query(
    "SELECT CAST(count(CASE WHEN lang = 'en' THEN 1 END) AS BIGINT) AS processed, count(*) AS total, count(CASE WHEN lang = 'en' THEN 1 END) >= count(*) AS complete FROM documents"
)
def scan_progress(spark, sf_dir):
    by = load(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.when(F.col("lang") == "en", 1)).alias("processed"), F.count(F.lit(1)).alias("total")
    )
    return R.progress(by)


# canonical readers over records that are made of conversations -------------------------------------


def _records(spark, sf_dir, raw):
    c = load(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("c"), "conv_id").alias("file"),
        (F.col("turn") + 1).cast("int").alias("line_no"),
        raw.alias("raw")
    )


def _shown(tables):
    said = F.coalesce("text", F.get_json_object("input", "$.command"))
    return tables.blocks.select("session", "message_idx", "role", "kind", "op", F.md5(said).alias("said_md5"))


_TOOL = "CASE WHEN role = 'system' THEN 'tool' ELSE 'text' END AS kind, CASE WHEN role = 'system' THEN 'shell.exec' END AS op, md5(text) AS said_md5"


@query(
    f"SELECT concat('c', conv_id) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_idx, CASE role WHEN 'system' THEN 'assistant' ELSE role END AS role, {_TOOL} FROM conversations"
)
def canonical_claude(spark, sf_dir):
    role = F.when(F.col("role") == "system", "assistant").otherwise(F.col("role"))
    call = F.array(
        F.struct(
            F.lit("tool_use").alias("type"),
            F.lit("t").alias("id"),
            F.lit("Bash").alias("name"),
            F.struct(F.col("text").alias("command")).alias("input")
        )
    )
    line = lambda content: F.to_json(
        F.struct(
            role.alias("type"),
            F.col("turn").cast("string").alias("uuid"),
            F.struct(role.alias("role"), content.alias("content")).alias("message")
        )
    )
    return _shown(
        N.claude(_records(spark, sf_dir, F.when(F.col("role") == "system", line(call)).otherwise(line(F.col("text")))))
    )


@query(f"""
    WITH a AS (SELECT *, min(CASE WHEN role <> 'system' THEN turn END) OVER w AS nxt, max(turn) OVER (PARTITION BY conv_id) + 1 AS fin FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    b AS (SELECT a.*, n.role AS next_role FROM a LEFT JOIN conversations n ON a.conv_id = n.conv_id AND a.nxt = n.turn),
    c AS (SELECT *, CASE WHEN role = 'system' THEN coalesce(nxt, fin) ELSE turn END AS pos_at, CASE WHEN role = 'system' AND coalesce(next_role, 'user') = 'user' THEN 0 ELSE 1 END AS sub FROM b)
    SELECT concat('c', conv_id) AS session, dense_rank() OVER (PARTITION BY conv_id ORDER BY pos_at, sub) AS message_idx, CASE role WHEN 'system' THEN 'assistant' ELSE role END AS role, {_TOOL} FROM c""")
def canonical_codex(spark, sf_dir):
    call = F.struct(
        F.lit("function_call").alias("type"),
        F.lit("shell").alias("name"),
        F.lit("k").alias("call_id"),
        F.to_json(F.struct(F.col("text").alias("command"))).alias("arguments")
    )
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    said = F.struct(
        F.lit("message").alias("type"), "role", F.array(F.struct(kind.alias("type"), "text")).alias("content")
    )
    line = lambda payload: F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    return _shown(N.codex(_records(spark, sf_dir, F.when(F.col("role") == "system", line(call)).otherwise(line(said)))))


@query(
    f"SELECT concat('c', conv_id) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_idx, CASE role WHEN 'system' THEN 'user' ELSE role END AS role, {_TOOL} FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE turn % 3 = 2 AND (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM conversations))"
)
def canonical_pi(spark, sf_dir):
    """Every third message is left: the next one goes on from the message before it."""
    up = F.when(F.col("turn") % 3 == 0, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    parent = F.when(F.col("turn") > 0, up.cast("string"))
    body = F.when(
        F.col("role") == "system",
        F.to_json(F.struct(F.lit("bashExecution").alias("role"), F.col("text").alias("command")))
    ).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    raw = F.concat(
        F.lit('{"type":"message","id":"'),
        "turn",
        F.lit('","parentId":'),
        F.coalesce(F.concat(F.lit('"'), parent, F.lit('"')), F.lit("null")),
        F.lit(',"message":'),
        body,
        F.lit("}")
    )
    lines = _records(spark, sf_dir, raw)
    head = lines.select("file").distinct().select(
        "file", F.lit(0).alias("line_no"), F.lit('{"type":"session","version":3,"id":"s"}').alias("raw")
    )
    return _shown(N.pi(lines.unionByName(head)))


@query(
    f"SELECT CAST(conv_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_idx, CASE role WHEN 'system' THEN 'assistant' ELSE role END AS role, CASE WHEN role = 'system' THEN 'tool' ELSE 'text' END AS kind, CASE WHEN role = 'system' THEN 'shell.exec' END AS op, md5(text) AS said_md5 FROM conversations"
)
def canonical_database(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat_ws(".", "conv_id", "turn").alias("id"),
        F.col("turn").alias("time_created"),
        F.when(F.col("role") == "system", "assistant").otherwise(F.col("role")).alias("said"),
        "role",
        "text"
    )
    tool = F.struct(
        F.lit("tool").alias("type"),
        F.lit("bash").alias("tool"),
        F.col("id").alias("callID"),
        F.struct(
            F.lit("completed").alias("status"), F.struct(F.col("text").alias("command")).alias("input")
        ).alias("state")
    )
    data = F.when(F.col("role") == "system", F.to_json(tool)).otherwise(
        F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    )
    m = c.select("id", "session_id", F.to_json(F.struct(F.col("said").alias("role"))).alias("data"), "time_created")
    return _shown(
        N.database(
            m,
            c.select(
                F.concat(F.lit("p"), "id").alias("id"),
                F.col("id").alias("message_id"),
                "session_id",
                data.alias("data"),
                "time_created"
            )
        )
    )


@query(
    "SELECT concat('c', conv_id) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_idx, role, 'text' AS kind, md5(text) AS said_md5 FROM conversations WHERE role <> 'system'"
)
def canonical_chat(spark, sf_dir):
    raw = F.to_json(
        F.struct(
            F.when(F.col("role") == "system", "note").otherwise(F.col("role")).alias("type"),
            F.col("text").alias("content")
        )
    )
    return _shown(N.chat(_records(spark, sf_dir, raw))).drop("op")


@query("""
    WITH p AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS pr FROM conversations),
    i AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pr ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, pr, role ORDER BY turn) AS isl FROM p WHERE role <> 'user'),
    b AS (
        SELECT conv_id, pr, 0 AS sub, turn AS place, 'user' AS role, 'text' AS kind, text, NULL AS op FROM p WHERE role = 'user'
        UNION ALL SELECT conv_id, pr, 1, min(turn), 'assistant', 'text', string_agg(text, '' ORDER BY turn), NULL FROM i WHERE role = 'assistant' GROUP BY conv_id, pr, isl
        UNION ALL SELECT conv_id, pr, 1, turn, 'assistant', 'tool', text, 'shell.exec' FROM i WHERE role = 'system')
    SELECT concat('c', conv_id) AS session, dense_rank() OVER (PARTITION BY conv_id ORDER BY pr, sub) AS message_idx,
           row_number() OVER (PARTITION BY conv_id, pr, sub ORDER BY place) - 1 AS block_idx, role, kind, op, md5(text) AS said_md5,
           CASE WHEN kind = 'tool' THEN 'success' END AS status, CASE WHEN kind = 'tool' THEN md5(text) END AS output_md5
    FROM b WHERE text <> ''""")
def canonical_updates(spark, sf_dir):
    """Each message as two chunks or as a call with two updates, prompts named by id or by index alone; then a prompt
    that a marker takes back."""
    w = N.Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf_dir, "conversations").withColumn(
        "pr", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    )
    half = F.floor(F.length("text") / 2).cast("int")
    parts = [F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))]
    named = F.struct(F.concat(F.lit("p"), "pr").alias("promptId"), F.col("pr").alias("promptIndex"))
    line = lambda update, meta: F.to_json(
        F.struct(
            F.lit("session/update").alias("method"),
            F.struct(update.alias("update"), meta.alias("_meta")).alias("params")
        )
    )
    nested = F.struct(F.col("pr").alias("promptIndex")).alias("_meta")
    user = lambda text: F.struct(F.lit("user_message_chunk").alias("sessionUpdate"), text.alias("content"), nested)
    said = lambda text: F.struct(
        F.lit("agent_message_chunk").alias("sessionUpdate"), F.struct(text.alias("text")).alias("content")
    )
    call = F.concat(F.lit("call"), "turn")
    of_call = F.struct(call.alias("toolCallId"), F.lit("Completed").alias("status")).alias("updateParams")
    tool = [
        line(
            F.struct(F.lit("Shell").alias("title"), F.struct(F.col("text").alias("command")).alias("rawInput")),
            F.struct(
                F.lit("ToolCall").alias("updateType"),
                F.concat(F.lit("p"), "pr").alias("promptId"),
                F.struct(call.alias("toolCallId")).alias("updateParams")
            )
        ),
        line(
            F.struct(F.lit("partial").alias("rawOutput")),
            F.struct(F.lit("ToolCallUpdate").alias("updateType"), of_call)
        ),
        line(
            F.struct(F.col("text").alias("content")),
            F.struct(
                F.lit("ToolCallUpdate").alias("updateType"),
                F.struct(call.alias("toolCallId"), F.lit("InProgress").alias("status")).alias("updateParams")
            )
        ),
    ]
    lines = F.when(
        F.col("role") == "user",
        F.array(line(user(parts[0]), named), line(user(parts[1]), F.struct(F.col("pr").alias("promptIndex"))))
    )
    lines = lines.when(F.col("role") == "system", F.array(*tool)).otherwise(
        F.array(line(said(parts[0]), named), line(said(parts[1]), named))
    )
    file = F.concat(F.lit("c"), "conv_id").alias("file")
    rows = c.select(file, "turn", F.posexplode(lines).alias("k", "raw")).select(
        "file", (F.col("turn") * 3 + F.col("k")).cast("int").alias("line_no"), "raw"
    )
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max("pr").alias("pr"))
    undone = F.to_json(
        F.struct(
            F.lit("session/update").alias("method"),
            F.struct(
                F.struct(
                    F.lit("user_message_chunk").alias("sessionUpdate"),
                    F.lit("undone").alias("content"),
                    F.struct(F.lit(100_000).alias("promptIndex")).alias("_meta")
                ).alias("update")
            ).alias("params")
        )
    )
    marker = F.to_json(
        F.struct(
            F.lit("_x.ai/session/update").alias("method"),
            F.struct(
                F.struct(
                    F.lit("rewind_marker").alias("sessionUpdate"), F.col("pr").alias("target_prompt_index")
                ).alias("update")
            ).alias("params")
        )
    )
    ends = ends.select(file, "turn", F.posexplode(F.array(undone, marker)).alias("k", "raw")).select(
        "file", (F.col("turn") * 3 + 3 + F.col("k")).cast("int").alias("line_no"), "raw"
    )
    out = N2.updates(rows.unionByName(ends)).blocks
    text = F.coalesce("text", F.get_json_object("input", "$.command"))
    return out.select(
        "session",
        "message_idx",
        "block_idx",
        "role",
        "kind",
        "op",
        F.md5(text).alias("said_md5"),
        "status",
        F.md5("output").alias("output_md5")
    )


# references, handles, settled changes ---------------------------------------------------------------


@query("""
    WITH k AS (SELECT DISTINCT concat('c', conv_id) AS id FROM conversations), r AS (
        SELECT concat('c', conv_id) AS session, unnest([concat('c', conv_id + 1), concat('c', conv_id + 2), concat('c', conv_id + 3)]) AS ref FROM conversations)
    SELECT DISTINCT session, ref FROM r WHERE ref IN (SELECT id FROM k)""")
def thread_references(spark, sf_dir):
    """Ids in an object, in a list, in JSON in a string in JSON in a string; and one under a key that names no session."""
    c = load(spark, sf_dir, "conversations")
    name = lambda k: F.concat(F.lit("c"), F.col("conv_id") + k)
    inner = F.to_json(
        F.struct(F.to_json(F.struct(F.array(F.struct(name(3).alias("session_id"))).alias("x"))).alias("output"))
    )
    raw = F.to_json(
        F.struct(
            F.struct(
                F.struct(name(1).alias("thread_id"), name(7).alias("title")).alias("a"),
                F.array(name(2), "text").alias("agent_thread_id"),
                inner.alias("arguments"),
                F.lit("{torn").alias("input")
            ).alias("payload")
        )
    )
    known = c.select(F.concat(F.lit("c"), "conv_id").alias("id")).distinct()
    return RF.thread_references(c.select(F.concat(F.lit("c"), "conv_id").alias("session"), raw.alias("raw")), known)


@query("""
    SELECT concat('r', r_regionkey) AS id FROM region UNION ALL SELECT concat('n', n_nationkey) FROM nation WHERE n_regionkey > 1 OR n_nationkey % 2 = 0
    UNION ALL SELECT concat('c', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey > 1 OR n_nationkey % 2 = 0""")
def pruned_subtrees(spark, sf_dir):
    """Two regions are edited; every other nation, and some customers, are named by what is left."""
    t = lambda name: load(spark, sf_dir, name)
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    nodes = t("region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nodes = nodes.unionByName(
        t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"))
    )
    nodes = nodes.unionByName(
        t("customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"))
    )
    named = t("nation").where("n_nationkey % 2 = 1").select(key("n", "n_nationkey").alias("ref")).unionByName(
        t("customer").select(key("c", "c_custkey").alias("ref"))
    )
    return RF.pruned(
        nodes, t("region").where("r_regionkey < 2").select(key("r", "r_regionkey").alias("id")), named
    )[0].select("id")


@query("""
    SELECT lang AS tool, CAST(d.doc_id AS VARCHAR) AS session, sha256(concat(lang, chr(0), d.doc_id)) AS handle, toxic IS DISTINCT FROM 1 AS present,
           CASE WHEN l.doc_id IS NULL THEN 3 WHEN toxic = 1 THEN 3 ELSE 1 END AS since
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL""")
def handle_generations(spark, sf_dir):
    """All documents, then the labelled ones, then all but the toxic: who came back has the handle of before."""
    d = load(spark, sf_dir, "documents").where("lang is not null").select(
        F.col("lang").alias("tool"), F.col("doc_id").cast("string").alias("session")
    )
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("session"), "toxic")
    log = spark.createDataFrame([], "tool string, session string, handle string, generation int, present boolean")
    for generation, active in enumerate(
        (d, d.join(labels, "session", "left_semi"), d.join(labels.where("toxic = 1"), "session", "left_anti")), 1
    ):
        log = G._durable(log.unionByName(R.handle_log(log, active, generation)))
    return R.handles_as_of(log, 3).select("tool", "session", "handle", "present", "since")


@query("""
    WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS source, epoch_ms(ts) AS t, event_type AS token, event_id % 7 = 0 AS nudge, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    p AS (SELECT source, min(t) AS t0 FROM e GROUP BY 1), q AS (SELECT e.source, (t - t0) // 20000 AS t, token, nudge, n FROM e JOIN p ON e.source = p.source),
    s AS (
        SELECT source, n, t AS at_ms, token AS last, token AS synced, CAST(NULL AS BIGINT) AS pending, t AS reconciled, CAST(NULL AS VARCHAR) AS reason FROM q WHERE n = 1
        UNION ALL
        SELECT b.source, b.n, b.t, b.token,
               CASE WHEN b.full_scan OR b.hit THEN b.token ELSE b.synced END, CASE WHEN b.full_scan OR b.hit OR b.token = b.synced THEN NULL ELSE b.since END,
               CASE WHEN b.full_scan THEN b.t ELSE b.reconciled END, CASE WHEN b.full_scan THEN 'reconcile' WHEN b.hit THEN CASE WHEN b.token = b.last THEN 'settled' ELSE 'overdue' END END
        FROM (SELECT q.source, q.n, q.t, q.token, s.last, s.synced, s.reconciled, coalesce(s.pending, q.t) AS since,
                     q.token <> s.synced AND (q.token = s.last OR q.t - coalesce(s.pending, q.t) >= 15000) AS hit,
                     q.t - s.reconciled >= 300000 OR q.nudge AND q.t - s.reconciled >= 5000 AS full_scan
              FROM s JOIN q ON q.source = s.source AND q.n = s.n + 1) b)
    SELECT source, at_ms, reason, last AS token FROM s WHERE reason IS NOT NULL""")
def settled_changes(spark, sf_dir):
    """Users as sources, their events as polls a twenty-thousandth as far apart: types are tokens."""
    e = load(spark, sf_dir, "events").where("user_id is not null")
    at = F.unix_millis("ts")
    if dict(e.dtypes)["ts"] == "timestamp_ntz":  # times without a zone are not to pass through that of the session
        gone = F.col("ts") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        part = lambda name: F.extract(F.lit(name), gone).cast("long")
        rest = F.floor(F.extract(F.lit("SECOND"), gone) * 1000)
        at = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000 + rest
    w = N.Window.partitionBy("user_id")
    first = F.min(at).over(w)
    polls = e.select(
        F.col("user_id").cast("string").alias("source"),
        F.floor((at - first) / 20_000).cast("long").alias("at_ms"),
        F.col("event_type").alias("token"),
        (F.col("event_id") % 7 == 0).alias("nudge"),
        "event_id",
        "ts"
    )
    order = F.row_number().over(N.Window.partitionBy("source").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")))
    return ST.settled_changes(
        polls.withColumn("n", order).sort("source", "n").select("source", "at_ms", "token", "nudge", "n")
    )


@query("""
    WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS m FROM conversations),
    n AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 <> 0 AND conv_id - conv_id % 3 IN (SELECT conv_id FROM conversations) THEN conv_id - conv_id % 3 END AS parent FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY conv_id) - 1 AS place FROM n),
    p AS (SELECT conv_id, concat('n:', CASE WHEN parent IS NULL THEN '0' ELSE concat('0.', place) END) AS node FROM k),
    b AS (SELECT c.conv_id, m, node, greatest(1, u) AS round, role,
                 CASE WHEN role = 'system' AND turn % 5 = 0 THEN 'narrated' WHEN role = 'system' AND c.conv_id % 2 = 0 THEN 'lossy' WHEN role = 'system' THEN 'exact' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'dropped' ELSE 'text' END AS fidelity
          FROM c JOIN p ON c.conv_id = p.conv_id),
    v AS (SELECT DISTINCT conv_id, round FROM b WHERE fidelity <> 'dropped')
    SELECT concat(node, '/m:', m, '/b:0/difference') AS id, CASE WHEN fidelity = 'dropped' THEN 'dropped' ELSE 'degraded' END AS kind, fidelity,
           CASE fidelity WHEN 'dropped' THEN 'unsupported_thinking' WHEN 'lossy' THEN 'unsupported_tool_fields' ELSE 'tool_to_history' END AS reason_code,
           substr(node, 3) AS node_path, CAST(b.round AS BIGINT) AS round_index, CASE WHEN v.round IS NOT NULL THEN concat(node, '/r:', b.round) END AS anchor_id, concat('c', b.conv_id) AS node_id
    FROM b LEFT JOIN v ON b.conv_id = v.conv_id AND b.round = v.round WHERE fidelity NOT IN ('text', 'exact')
    UNION ALL SELECT concat(node, '/loss:0'), 'dropped', 'dropped', 'migration.truncated', substr(node, 3), NULL, NULL, concat('c', conv_id) FROM p WHERE conv_id % 4 = 0""")
def migration_differences(spark, sf_dir):
    """Conversations as small trees; system messages are calls, of which some carry an input that the target lacks and
    some are of an operation without a rule; some assistant messages are thinking."""
    c = load(spark, sf_dir, "conversations").withColumn("session", F.concat(F.lit("c"), "conv_id"))
    ids = c.select("conv_id").distinct()
    above = ids.select(F.col("conv_id").alias("up"))
    k = F.col("conv_id")
    nodes = ids.join(above, (k % 3 != 0) & (k - k % 3 == F.col("up")), "left").select(
        F.concat(F.lit("c"), k).alias("session"),
        F.when(F.col("up").isNotNull(), F.concat(F.lit("c"), "up")).alias("parent"),
        k.alias("ordinal"),
        F.lit("t").alias("title")
    )
    kind = F.when(F.col("role") == "system", "tool").when(
        (F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "thinking"
    ).otherwise("text")
    order = F.row_number().over(N.Window.partitionBy("session").orderBy("turn")).cast("long")
    fetch, more = F.col("turn") % 5 == 0, k % 2 == 0
    given = F.when(fetch, F.to_json(F.struct(F.lit("http://x.test").alias("url")))).when(
        more, F.to_json(F.struct(F.col("text").alias("command"), F.lit(5).alias("timeout_ms")))
    ).otherwise(F.to_json(F.struct(F.col("text").alias("command"))))
    b = c.select(
        "session",
        order.alias("message_idx"),
        F.lit(0).alias("block_idx"),
        "role",
        kind.alias("kind"),
        "text",
        F.lit("Tool").alias("name"),
        F.when(fetch, "web.fetch").otherwise("shell.exec").alias("op"),
        given.alias("input")
    )
    none = F.lit(None).cast("string")
    calls = b.where("kind = 'tool'").withColumns(
        {
            "output": none,
            "status": none,
            "block_kinds": F.array().cast("array<string>"),
            "attachments": F.lit(0),
            "truncated": F.lit(False)
        }
    )
    decided = TL.decide(calls, TL.rules(spark, {"shell.exec": ("exact", ["command"])}), ["success"], ["text"], [])
    losses = nodes.where("ordinal % 4 = 0").select(
        "session", F.lit("migration.truncated").alias("code"), F.lit("x").alias("detail")
    ).unionByName(
        nodes.select("session", F.lit("other.code").alias("code"), F.lit("y").alias("detail"))
    )
    out = PV.differences(nodes, b, decided, losses, "codex")
    return out.select("id", "kind", "fidelity", "reason_code", "node_path", "round_index", "anchor_id", "node_id")
