"""Periodic runs, archives and hard negatives, each against a plain version."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge.llm import archives, negatives, periodic
from rankforge.operators import joins
from tests.llm import fixtures as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All maximal runs, lag by lag."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w, n, out = np.array([codes[x] for x in words]), len(words), {}
    for q in range(1, n // 4 + 1):
        equal = np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]])
        step = np.diff(equal)
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if b - a + q >= max(6, 4 * q):
                out.setdefault((a, b - a + q), q)
    return sorted((s, size, q) for (s, size), q in out.items())


def plain_document(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


REPEATS = ["x " * 700, "a b " * 9 + "c " * 6 + "a b " * 9, "one two three　four\x0b" * 5, "a a a a a", "a a a a a a",
           "k l m k l m k l m k l m k l", "p q r s " * 4 + "p q r t " * 4, "漢 字 " * 20]


def test_runs_of_words_equal_plain_runs():
    rng = random.Random(5)
    for turn in range(3000):
        n, letters = rng.randint(0, 110), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 7 else 0):
            start, period = rng.randrange(n), rng.randint(1, 12)
            for i in range(start + period, min(n, start + rng.randint(4, 70))):
                words[i] = words[i - period]
        assert periodic.runs_of(words) == plain_runs(words)


def test_runs_of_long_texts():
    rng = random.Random(6)
    for words in ([0] * 20000, [i % 977 for i in range(20000)], [rng.randrange(2) for _ in range(9000)]):
        assert periodic.runs_of(words) == plain_runs(words)


def test_runs_query_equals_plain_documents(spark, tmp_path):
    folder = X.as_folder(tmp_path, documents=X.clashing(spark, REPEATS).withColumn("runs", F.lit(1)))
    got = [tuple(r) for r in periodic.query(spark, folder).collect()]
    expected = [plain_document(r[0], r[1]) for r in X.rows(REPEATS)]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert sum(r[1] > 0 for r in got) > 8


def test_runs_keep_carried_columns_and_empty_tables(spark):
    table = X.clashing(spark, REPEATS)
    got = periodic.with_runs(table, ["doc_id", "c0", "_spans"])
    assert got.columns == ["doc_id", "c0", "_spans", "n_words", "runs", "collapsed"] and got.count() == table.count()
    assert periodic.with_runs(X.empty(spark), ["doc_id"]).count() == 0
    one = spark.createDataFrame([("u  v u v u v u v\nw",)], "text STRING")
    assert [tuple(r) for r in periodic.with_runs(one, []).collect()] == [(9, [(0, 8, 2)], "u v w")]


PAGES = "page_id BIGINT, url STRING, html STRING, kind STRING, payload STRING"
SEPARATOR = "\r\n\r\nWARC/1.1\r\n"


def page_rows():
    rng = random.Random(8)
    html = [f"<p>{X.prose(rng, rng.randint(1, 60))}</p>" for _ in range(12)]
    long = X.prose(rng, 9000)
    html += [None, "", "", html[3], html[3], html[4], long, f"a{SEPARATOR}b{SEPARATOR}", SEPARATOR, "WARC/1.",
             "漢字🙂" * 5000, "x" * 4096, "y" * 8192, long, "\r\n\r\n", "0\r\n\r\n"]
    rows = [(i, f"http://h.example/{i} b\r\nX: y?c=%20" if i % 5 == 0 else f"http://h.example/{i}", h, "k", "p")
            for i, h in enumerate(html)]
    rows += [rows[1], rows[1], (None, None, html[3], None, None), (None, "u", "only here", None, None), (70, None, long, "", "")]
    return rows


def code(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_pages(rows):
    known = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    most = {}
    for i, payload in known:
        most[payload] = max(most.get(payload, -1), -1 if i is None else i)
    out = []
    for i, payload in known:
        keeper = None if most[payload] < 0 else most[payload]
        first = i == keeper
        out.append((i, len(payload), code(payload), "response" if first else "revisit", None if first else keeper, None))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_archive_query_equals_plain_pages(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(joins, "KEY_ROWS", 2)
    monkeypatch.setattr(joins, "BESIDE_BYTES", limit)
    rows = page_rows()
    folder = X.as_folder(tmp_path, pages=spark.createDataFrame(rows, PAGES).repartition(3))
    got = [tuple(r) for r in archives.query(spark, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_pages(rows)))


def plain_records(data):
    """Records by their declared lengths, read from the start of the bytes."""
    at, out = 0, []
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        out.append((head, data[end + 4:end + 4 + size]))
        at = end + 4 + size
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    return out


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_are_whole_files(spark, tmp_path, compression):
    rows = page_rows()
    path = str(tmp_path / "warc")
    archives.write(spark.createDataFrame(rows, PAGES).repartition(3), path, segment=1000, compression=compression)
    found = []
    for file in sorted((tmp_path / "warc").glob("part-*")):
        data = file.read_bytes()
        found += plain_records(gzip.decompress(data) if compression == "gzip" else data)
    kinds = [h[b"WARC-Type"] for h, _ in found]
    assert kinds.count(b"response") + kinds.count(b"revisit") == len(rows) and kinds.count(b"continuation") > 40
    assert all(len(block) <= 1000 for _, block in found)
    seen = archives.payloads(archives.records(spark, path)).collect()
    assert len(seen) == len(rows) and not any(r["problem"] for r in seen)
    given = sorted((h or "").encode() for _, _, h, *_ in rows)
    responses = [bytes(r["payload"]) for r in seen if r["kind"] == "response"]
    assert set(responses) == set(given) and all(r["payload"] is None for r in seen if r["kind"] == "revisit")
    assert {r["target_uri"] for r in seen} >= {"http://h.example/1", "http://h.example/0%20b%0D%0AX:%20y?c=%20"}


def record(kind, name, block, *fields):
    return archives.header([("WARC-Type", kind), ("WARC-Record-ID", name), *fields], block) + b"\r\n\r\n"


def test_segments_of_other_writers(spark, tmp_path):
    answer = archives.ANSWER + b"\r\n"
    plain = answer + f"left{SEPARATOR}Content-Length: 5\r\n\r\nright".encode()
    framed = archives.ANSWER + b"Transfer-Encoding: chunked\r\n\r\n5;x=y\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    number = lambda i, total=None: (("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Number", i),
                                    ("WARC-Segment-Total-Length", total))
    parts = [record("continuation", "<c>", framed[60:], *number(3, len(framed))),
             record("warcinfo", "<i>", b"software: x"), record("response", "<p>", plain),
             record("response", "<a>", framed[:30], ("WARC-Segment-Number", 1)),
             record("continuation", "<b>", framed[30:60], *number(2)),
             record("response", "<short>", framed)[:-12] + b"\r\n\r\n",
             record("response", "<broken>", framed.replace(b"6\r\n w", b"7\r\n w")),
             record("response", "<lone>", framed, ("WARC-Segment-Number", 1)),
             record("continuation", "<d>", b"zz", ("WARC-Segment-Origin-ID", "<gone>"), ("WARC-Segment-Number", 2),
                    ("WARC-Segment-Total-Length", 9)),
             record("response", "<total>", framed[:30], ("WARC-Segment-Number", 1)),
             record("continuation", "<e>", framed[30:], ("WARC-Segment-Origin-ID", "<total>"), ("WARC-Segment-Number", 2),
                    ("WARC-Segment-Total-Length", 7))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = {r["record_id"]: r for r in archives.payloads(archives.records(spark, str(tmp_path / "in"))).collect()}
    assert bytes(got["<p>"]["payload"]) == plain[len(answer):] and bytes(got["<a>"]["payload"]) == b"hello world"
    assert {k: r["problem"] for k, r in got.items() if r["problem"]} == {
        "<short>": "a record is shorter than its declared length", "<broken>": "the chunked framing is broken",
        "<lone>": "no last segment", None: "segments are missing or differ",
        "<total>": "segments do not have the declared total length"}
    assert all(r["payload"] is None for r in got.values() if r["problem"])


def test_lines_are_cut_by_declared_lengths():
    inner = record("response", "<inner>", b"zz")
    data = [record("response", f"<{i}>", b) for i, b in enumerate([b"", b"x" * 9, inner * 2, archives.SEPARATOR, b"y"])]
    data[3:3] = [record("response", "<cut>", b"0123456789")[:-9] + b"\r\n\r\n"]
    every = b"".join(data)
    expected = [d[:-4].removeprefix(archives.START) for d in data]
    plain = every.split(archives.SEPARATOR)
    missed = [archives.SEPARATOR.join(plain[:2]), *plain[2:6], archives.SEPARATOR.join(plain[6:])]
    for lines in (plain, missed):
        known = archives.Lines()
        found = [r for line in lines for r in known.add(line)] + list(known.take(True))
        assert found == expected


def test_empty_tables_give_no_rows(spark, tmp_path):
    folder = X.as_folder(tmp_path, pages=spark.createDataFrame([], PAGES),
                         embeddings=spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"))
    assert archives.query(spark, folder).count() == 0 and negatives.query(spark, folder).count() == 0


VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id INT, v INT, score INT"


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (4, 9))
    rows = []
    for i in range(430):
        label = int(rng.integers(0, 4))
        x = (centres[label % 3] + rng.normal(0, 0.3, 9)).astype(np.float32).tolist()
        rows.append((i, x, label, 0, 0, 0))
    common = rows[50][1]
    rows += [(500 + i, common, i % 3, 0, 0, 0) for i in range(40)]
    rows += [(600, None, 1, 0, 0, 0), (700, common, None, 0, 0, 0), (800, [1.0, None], 1, 0, 0, 0),
             (900, [float("nan")] * 9, 1, 0, 0, 0), (1000, [float("-inf")] + common[1:], 1, 0, 0, 0),
             (1100, [], 1, 0, 0, 0), (1200, common[:4], 2, 0, 0, 0), (1300, common + [9.0], 2, 0, 0, 0),
             (None, common, 1, 0, 0, 0), (None, common, 2, 0, 0, 0), rows[100], rows[100], rows[101], rows[51]]
    return rows


def plain_mine(rows):
    taken = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        taken.append((vec_id, label, tuple(int(np.floor(256 * float(np.float32(c)))) for c in x)))
    out = []
    key = lambda s: (-s[0], s[1] is None, s[1])
    for anchor, label, q in {t for t in taken if t[0] is not None and t[0] % 100 == 0}:
        scored = [(sum(a * b for a, b in zip(q, v)), i, other) for i, other, v in taken if i != anchor]
        same = sorted((s for s in scored if s[2] == label), key=key)[:5]
        for best, positive, _ in same:
            inside = sorted((s for s in scored if s[2] != label and 80 * best <= 100 * s[0] <= 100 * best), key=key)[:5]
            out += [(anchor, positive, rank, i, best, s) for rank, (s, i, _) in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("passes,batch,stride", [(1, 10000, 8), (3, 37, 2)])
def test_negatives_equal_all_pairs(spark, tmp_path, monkeypatch, passes, batch, stride):
    monkeypatch.setattr(negatives, "STRIDE", stride)
    rows = vector_rows()
    folder = X.as_folder(tmp_path, embeddings=spark.createDataFrame(rows, VECTORS).repartition(3))
    if passes > 1:
        monkeypatch.setattr(negatives.mine, "__defaults__", (*negatives.mine.__defaults__[:-1], 300))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in negatives.query(spark, folder).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, got)) == sorted(map(str, plain_mine(rows))) and len(got) > 100


def test_bounds_leave_out_rows_but_lose_none():
    rng = np.random.default_rng(2)
    dims = (rng.normal(0, 40, (64, 3000)) * np.geomspace(8, 0.05, 64)[:, None]).astype(np.int32)
    block = negatives.Block(np.arange(3000).tobytes(), np.zeros(3000, np.int64).tobytes(), dims.tobytes())
    anchor = dims[:, 7].astype(np.int64)
    scores = anchor @ dims.astype(np.int64)
    bar = np.sort(scores)[-5]
    seen = []

    def possible(least, most):
        seen.append(len(least))
        return most >= bar

    rows, found = block.scan(anchor, np.arange(3000), possible)
    assert sorted(rows) == sorted(np.flatnonzero(scores >= bar)) and (scores[rows] == found).all()
    assert seen[0] == 3000 and seen[3] < 600 and seen[-1] < 50


def test_matrix_fills_up_with_zeros():
    lists = pa.array([[1, 2, 3], [], [4]], pa.list_(pa.int32()))
    assert negatives.matrix(lists).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]]
    assert negatives.matrix(pa.array([], pa.list_(pa.int32()))).shape == (0, 0)
