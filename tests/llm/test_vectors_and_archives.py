"""Whitening, vector codes and WARC transactions against plain loops, and their edge rows."""

import base64
import gzip
import hashlib
import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException

from quern.llm import common, vector_codes, warc, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, part string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash", "clash") for i, v, label in rows], VECTORS)


def vectors(n, width, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * scale).astype(np.float32).tolist()


def odd_rows(width):
    real = vectors(40, width)
    rows = [(k, v, k % 3 if k % 5 else None) for k, v in enumerate(real)]
    bad = [(100, None, 1), (101, [], 1), (102, [None, *real[0][1:]], 1), (103, [math.nan, *real[0][1:]], 2), (104, [math.inf, *real[0][1:]], 2)]
    return rows + bad + [rows[3], rows[3], (None, real[5], 7), (7, real[8], 2)]


def kept(rows):
    return [(i, v, label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]


# whitening ------------------------------------------------------------------------------------


def test_whitening_matches_plain_sums(spark):
    rows = odd_rows(12)
    real = kept(rows)
    got = whitening.whitened(table(spark, rows).repartition(5)).collect()
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v, _ in real]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    want = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True))) for (i, _, _), row in zip(real, x, strict=True))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == want
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    a = np.array(x, float)
    cov = np.cov(a.T, bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    white = (a - a.mean(axis=0)) @ v / np.sqrt(e)
    for k in range(8):
        column = sorted(r.whitened for r in got if r.component == k + 1)
        same, turned = np.sort(white[:, k]), np.sort(-white[:, k])
        assert min(np.abs(column - same).max(), np.abs(column - turned).max()) < 1e-8
        assert [r.explained for r in got if r.component == k + 1] == pytest.approx([e[k] / np.trace(cov)] * n, rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_without_spread(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, None, 1)])).collect() == []
    alike = whitening.whitened(table(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect()
    assert [(r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alike)] == [(i, k, 0, None, 0.0, None) for i in (1, 2) for k in (1, 2)]
    line = whitening.whitened(table(spark, [(k, [k / 8, k / 4, 0.0], 1) for k in range(6)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2, 3} and line[0].identity_error < 1e-9
    with pytest.raises(PySparkException, match="unequal length"):
        whitening.whitened(table(spark, [(1, [0.5, 0.25], 1), (2, [0.5], 1)]))
    with pytest.raises(PySparkException, match="52 bits"):
        whitening.whitened(table(spark, [(1, [3e38, 0.25], 1)]))


def test_states_merge_to_the_whole():
    rng = np.random.default_rng(5)
    rows = rng.integers(-50, 50, (301, 6)) + 10**7
    parts = []
    for chunk in np.array_split(rows, 7):
        state = whitening.Moments.empty(6)
        for row in chunk:
            state.add(row)
        state.total += chunk.sum(axis=0)
        parts.append(state)
    whole = parts[0]
    for state in parts[1:]:
        whole.merge(state)
    assert whole.n == 301 and (whole.total == rows.sum(axis=0)).all()
    assert np.abs(whole.products / 301 - np.cov(rows.T, bias=True)).max() < 1e-6


@pytest.mark.parametrize("kind", ["plain", "repeated", "diagonal", "zero", "one", "graded"])
def test_symmetric_qr_is_an_eigen_solve(kind):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(20, 20))
    q = np.linalg.qr(a)[0]
    spectrum = {"plain": rng.normal(size=20), "repeated": np.repeat([3.0, 2, 2, 1], 5), "graded": 10.0 ** np.arange(20)}
    m = q @ np.diag(spectrum[kind]) @ q.T if kind in spectrum else {"diagonal": np.diag(np.arange(20.0)), "zero": np.zeros((4, 4)), "one": np.array([[7.0]])}[kind]
    m = (m + m.T) / 2
    d, v = whitening.symmetric_qr(m)
    size = max(1.0, np.abs(m).max())
    assert np.abs(d - np.linalg.eigvalsh(m)[::-1]).max() < 1e-12 * size
    assert np.abs(v @ v.T - np.eye(len(m))).max() < 1e-12
    assert np.abs(v @ m - d[:, None] * v).max() < 1e-11 * size


# vector codes ---------------------------------------------------------------------------------


def brute_codes(rows, entries, parts=16, rounds=2):
    real = [(i, [math.floor(256 * float(c)) for c in v], label) for i, v, label in kept(rows)]
    w = len(real[0][1]) // parts
    first = sorted(real, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : (p + 1) * w] for r in first] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return min(range(len(book)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, x, _ in real:
                groups[nearest(x[p * w : (p + 1) * w], books[p])[0]].append(x[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if groups[k] else book for k, book in enumerate(books[p])]
    coded = [(i, [nearest(x[p * w : (p + 1) * w], books[p]) for p in range(parts)], label) for i, x, label in real]
    sums = defaultdict(int)
    for _, c, label in coded:
        sums[label] += sum(d for _, d in c)
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for k, _ in c), sum(d for _, d in c), sums[label], sha) for i, c, label in coded)


@pytest.mark.parametrize("entries", [5, 64])
def test_codes_match_brute_force(spark, entries):
    rows = odd_rows(32)
    got = vector_codes.compressed(table(spark, rows).repartition(3), entries=entries).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows, entries)


def test_codes_edges(spark):
    assert vector_codes.compressed(table(spark, [])).collect() == []
    one = vector_codes.compressed(table(spark, [(1, [0.5] * 16, None)])).collect()[0]
    assert (one.code, one.error, one.label_error) == ("00" * 16, 0, 0)
    with pytest.raises(ValueError, match="multiple of 16"):
        vector_codes.compressed(table(spark, [(1, [0.5] * 15, 1)]))
    with pytest.raises(PySparkException, match="26 bits"):
        vector_codes.compressed(table(spark, [(1, [1e6] * 16, 1)]))


def test_cells_bound_distances_and_refine_few():
    rng = np.random.default_rng(4)
    book, queries = rng.integers(-300, 300, (64, 4)), rng.integers(-400, 400, (500, 4))
    book[7] = book[3]
    file = vector_codes.CellFile(book)
    exact = ((queries[:, None] - book[None]) ** 2).sum(axis=2)
    lower, upper = file.bounds(queries)
    assert (lower <= exact).all() and (exact <= upper).all()
    entry, distance, refined = file.nearest(queries)
    assert (entry == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert refined < 0.2 * exact.size


def test_groups_join_whole_whatever_their_size(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k if k % 3 == 1 else -1) for k in range(6000)], "id long, key long")
    sums = rows.groupBy("key").count().withColumnRenamed("count", "n").withColumn("own", common.F.col("n") * 10)
    out = common.join_groups(rows, sums.where("key is null or key <> 4"), "key", "n").collect()
    assert len(out) == 6000
    assert all(r.own == (20000 if r.key is None or r.key == -1 else None if r.key == 4 else 10) for r in out)


# WARC -----------------------------------------------------------------------------------------


PAGES = "page_id long, url string, html string, record_type string, payload string, own string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, u, h in rows], PAGES)


def odd_pages():
    gaps = "a\r\n\r\nb\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"
    return [
        (5, "http://a.example/x y?q=1#f", "<p>é 漢字</p>"),
        (3, "https://b.example/", "<p>é 漢字</p>"),
        (9, "bad url\r\nInjected: yes", gaps),
        (10, None, gaps),
        (1, "http://c.example", None),
        (2, "http://c.example", ""),
        (None, "http://n.example/", "<p>é 漢字</p>"),
        (None, None, "alone"),
        (7, "http://r.example/r", "row"),
        (7, "http://r.example/r", "row"),
        (7, "http://r.example/r", "row"),
        (8, "http://end.example/", "\r\n\r\n"),
        (11, "http://cr.example/", "x\r\n\r" * 3 + "\r\r\n\r\n\r"),
        (12, "http://long.example/", "<b>лонг</b>\r\n" * 60_000),
    ]


def expected(rows):
    groups = defaultdict(list)
    for i, u, h in rows:
        groups[h or ""].append((i is None, i or 0, u is None, u or ""))
    out = []
    for h, members in groups.items():
        data = h.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        members.sort()
        head = None if members[0][0] else members[0][1]
        for at, (null, i, no_url, u) in enumerate(members):
            out.append((None if null else i, None if no_url else u, len(data), digest, "revisit" if at else "response", head if at else None))
    return sorted(map(str, out))


def test_archives_give_back_what_was_written(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    got = warc.archived(pages_of(spark, odd_pages()).repartition(3), path).collect()
    assert sorted(map(str, ((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == expected(odd_pages())
    records = warc.read_archives(spark, path).collect()
    assert len(records) == 3 * len(odd_pages()) and all(r.complete for r in records)
    payloads = sorted(bytes(r.block).split(b"\r\n\r\n", 1)[1] for r in records if r.record_type == "response")
    assert payloads == sorted({(h or "").encode() for _, _, h in odd_pages()})
    assert not any("Injected" in (r.target_uri or "") and "\n" in r.target_uri for r in records)


def test_no_pages_no_records(spark, tmp_path):
    assert warc.archived(pages_of(spark, []), f"file://{tmp_path}/none").collect() == []


def record(kind, name, block=b"", to=(), length=None):
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode()]
    head += [b"WARC-Record-ID: " + name.encode()] if name else []
    head += [b"WARC-Concurrent-To: " + t.encode() for t in to]
    head += [b"Content-Length: %d" % (len(block) if length is None else length)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_reads_members_bytes_and_torn_ends(spark, tmp_path):
    binary = bytes(range(256)) + b"\r\n\r\n" + bytes(range(255, -1, -1))
    parts = [record("warcinfo", "<w>", b"software: x\r\n"), record("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\n" + binary), record("resource", "<e>"), record("metadata", "<m>", b"k: v", ["<r>"])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("request", "<q>", b"GET", ["<r>"]) + record("response", "<t>", b"half", length=400)))
    rows = warc.with_payload_facts(warc.read_archives(spark, f"file://{tmp_path}")).collect()
    by = {r.record_id: r for r in rows}
    assert set(by) == {"<w>", "<r>", "<e>", "<m>", "<q>", "<t>"} and len(rows) == 6
    assert bytes(by["<r>"].block).endswith(binary) and by["<r>"].payload_bytes == len(binary)
    assert by["<r>"].payload_digest == base64.b32encode(hashlib.sha1(binary).digest()).decode()
    assert [n for n, r in by.items() if not r.complete] == ["<t>"] and by["<t>"].payload_bytes is None
    assert by["<e>"].block == b"" and by["<m>"].concurrent_to == ["<r>"]


def test_transactions_follow_names_in_any_direction(spark):
    kind = "record_id string, record_type string, concurrent_to array<string>, block string, part string"
    rows = [
        ("r1", "response", [], "a"), ("q1", "request", ["r1"], "b"), ("m1", "metadata", ["q1"], "c"),
        ("r2", "response", ["q2", "m2"], "d"), ("q2", "request", None, "e"), ("m2", "metadata", [], "f"),
        ("q3", "request", ["gone"], "g"), ("m3", "metadata", ["gone"], "h"), ("r4", "revisit", [], "i"),
        (None, "response", ["r1"], "j"), (None, None, None, "k"), ("x5", "resource", ["r4"], "l"), ("r4", "revisit", [], "i"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], kind)
    got = warc.transactions(df).collect()
    shown = sorted((str(r.capture_id), r.n_records, *(sorted(x.block for x in r[n]) for n in ("responses", "requests", "metadata", "others"))) for r in got)
    assert shown == [
        ("None", 1, [], [], [], ["k"]),
        ("None", 1, ["j"], [], [], []),
        ("gone", 2, [], ["g"], ["h"], []),
        ("m1", 3, ["a"], ["b"], ["c"], []),
        ("m2", 3, ["d"], ["e"], ["f"], []),
        ("r4", 3, ["i", "i"], [], [], ["l"]),
    ]
    assert warc.transactions(df.limit(0)).collect() == []


def test_a_capture_of_very_many_records_is_dealt_over_rows(spark):
    rows = [("r", "response", [], "a")] + [(f"m{k:05d}", "metadata", ["r"], str(k)) for k in range(3500)]
    got = warc.transactions(spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>, block string")).collect()
    assert len(got) == 4 and {r.n_records for r in got} == {3501} and max(len(r.metadata) for r in got) < 1200
    assert sorted(int(x.block) for r in got for x in r.metadata) == list(range(3500))


def test_metadata_is_json(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(4, 'http://q.example/"', "x")]), f"file://{tmp_path}/w")
    blocks = [r.block for r in warc.read_archives(spark, f"file://{tmp_path}/w").where("record_type = 'metadata'").collect()]
    assert json.loads(bytes(blocks[0])) == {"page_id": 4, "url": 'http://q.example/"'}
