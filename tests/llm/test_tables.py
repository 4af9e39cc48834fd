"""Operators over whole tables, each against a plain version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import decontaminate, pages, personal, pieces, quality, secrets, sharding, simhash, urls
from rankforge.operators import joins
from tests.llm import fixtures as X
from tests.llm.test_texts import ITEMS, LEAKS, REPEATS, SECRETS, WORD, plain_leaks, plain_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance=2):
    """For each place the smallest place that links reach."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def near_texts():
    base = X.rows()[5][1] + " " + X.prose(__import__("random").Random(9), 400)
    words = base.split()
    return [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in range(0, len(words), 29)] + [base, base, base]


def test_fingerprints_and_groups(spark, tmp_path):
    extra = near_texts()
    rows = X.rows(extra)
    folder = X.as_folder(tmp_path, documents=X.clashing(spark, extra).where("doc_id is not null"))
    got = [tuple(r) for r in simhash.query(spark, folder).collect()]
    known = [r for r in rows if r[0] is not None]
    prints = [plain_print(r[1]) for r in known]
    group = plain_groups(prints)
    least = {g: min(known[i][0] for i in range(len(known)) if group[i] == g) for g in set(group)}
    expected = [(known[i][0], format(prints[i], "016x"), least[group[i]]) for i in range(len(known))]
    assert sorted(got) == sorted(expected)
    assert max(Counter(group).values()) > 5


def test_null_ids_and_empty_table(spark):
    table = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "only here"), (4, None), (None, "")],
                                  "doc_id BIGINT, text STRING")
    got = {(r["doc_id"], r["_fp"], r["component_id"]) for r in simhash.components(table).collect()}
    same = plain_print("a b c")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == {(None, signed(same), 3), (3, signed(same), 3), (4, 0, 4), (None, 0, 4),
                   (None, signed(plain_print("only here")), None)}
    assert simhash.components(X.empty(spark)).count() == 0 and simhash.keep_one(X.empty(spark)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_trie_links_keep_every_group(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(map(int, base))
    for _ in range(300):
        x = int(rng.choice(base))
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp BIGINT")
    found = simhash.groups(simhash.near_pairs(table, distance)).collect()
    root = {r["node"]: r["root"] for r in found}
    ours = [root.get(int(np.uint64(p).view(np.int64)), int(np.uint64(p).view(np.int64))) for p in prints]
    plain = plain_groups(prints, distance)
    assert len(set(zip(ours, plain))) == len(set(ours)) == len(set(plain))


def test_one_of_each_group_stays(spark):
    extra = near_texts()
    table = X.clashing(spark, extra)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    rows = X.rows(extra)
    group = plain_groups([plain_print(r[1]) for r in rows])
    best = {}
    for i, r in enumerate(rows):
        mark = (r[0] is None, r[0] or 0)
        best[group[i]] = min(best.get(group[i], mark), mark)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(m[1] for m in best.values())


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_shards(spark, tmp_path):
    folder = X.as_folder(tmp_path, documents=X.clashing(spark))
    got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"])
                 for r in sharding.query(spark, folder).collect())
    expected = []
    for i, text, *_ in X.rows():
        key = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        raw = (text or "").encode()
        expected.append((str(i), len(raw) + 1, zlib.crc32(raw), "key", plain_jump(key, 8), plain_jump(key, 9)))
    assert got == sorted(expected)
    assert all(g[4] == g[5] or g[5] == 8 for g in got)
    rows = sharding.query(spark, folder).collect()
    for shard in range(8):
        own = sorted((r["slot"], r) for r in rows if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for _, r in own]
        assert order == sorted(order)
    assert sharding.assign(X.empty(spark)).count() == 0


def test_equal_rows_get_slots_of_their_own(spark):
    table = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("x").alias("text"))
    slots = [r["slot"] for r in sharding.assign(table.repartition(7)).collect()]
    assert sorted(slots) == list(range(3000))


URLS = ["https://a.b.example.net/en/x?y", "http://example.net/", "http://EXAMPLE.NET/en/", "http://x.org/fr/1#t", "http://org/fr/",
        "http://anet/x", "http://net", "http://net?x=/", "no scheme", "", None, "a://b://c.net/x", "http://shop.cheap-pills.com/de/",
        "http://pills.com", "http://pillsx.com/", "http://example.com/de/1", "http://example.com/de", "http://a..net/x",
        "http://user@h.net:80/x", "://net/\nx", "http://ads.io/casino"]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [(r, v) for r, v in urls.RULES for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits, key=lambda x: len(x[0])))
    words = {w for label in host.split(".") for w in label.split("-")}
    return host, path, None, "block" if words & set(urls.LISTED_WORDS) else "allow"


def page_table(spark):
    rows = [(i, u, "<p>x</p>") for i, u in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], None)]
    return rows, spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")


def test_urls(spark, tmp_path, monkeypatch):
    rows, table = page_table(spark)
    folder = X.as_folder(tmp_path, pages=table.withColumn("host", F.lit("z")).withColumn("_rules", F.lit(1)))
    expected = sorted(str((r[0], *plain_verdict(r[1]))) for r in rows)
    assert sorted(str(tuple(r)) for r in urls.query(spark, folder).collect()) == expected
    clash = table.withColumns({"host": F.lit("z"), "_rules": F.lit(1), "key": F.lit(2)})
    out = urls.judge(clash, list(urls.RULES), urls.listed_domains(table))
    assert set(out.columns) == {*clash.columns, "path", "rule", "verdict"} and out.count() == len(rows)
    monkeypatch.setattr(urls, "MAX_BITS", 0)  # the way beyond the size bound
    assert sorted(str(tuple(r)) for r in urls.query(spark, folder).collect()) == expected
    assert urls.judge(table.limit(0), list(urls.RULES), urls.listed_domains(table.limit(0))).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 26000, 13).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade, seed, _ = urls.build(keys, listed)
    assert len(cascade.levels) > 2
    got = keys.select("key", urls.hashed(F.col("key"), seed).alias("h")).collect()
    found = cascade.contains(np.array([r["h"] for r in got]))
    assert {r["key"] for r, f in zip(got, found) if f} == {f"k{i}" for i in range(0, 20000, 13)}
    assert urls.build(keys, listed.limit(0))[0].levels == []


PRIVATE = ["mail a.b+c@x-y.example.com, or d@e.f@g.h.i- and j@k", "ip 1.2.3.4.5.6.7.8 or 256.1.1.1 010.0.0.255 1.2.3",
           "card 4111 1111 1111 1111 4111-1111-1111-1112 and 4111111111111111 5", "call +1 (743) 555-3824. or +12 or ++49 30 1234567",
           "🙂é x@y.z " * 300, "1.1.1.1 " * 600, "+4912345678" * 3, "a" * 3000 + "@", "9" * 5000, "-_x@y.z-_w@v.u"]


def plain_private(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_private_data_equals_plain_patterns(spark, tmp_path):
    folder = X.as_folder(tmp_path, documents=X.clashing(spark, PRIVATE))
    rows = personal.query(spark, folder).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    nulls = Counter(r["base_sha256"] for r in rows if r["doc_id"] is None)
    assert nulls == Counter(hashlib.sha256(",".join(plain_private(t)).encode()).hexdigest()
                            for i, t, *_ in X.rows(PRIVATE) if i is None)
    for i, text, *_ in X.rows(PRIVATE):
        if i is None:
            continue
        base = plain_private(text)
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}, text[:80]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text[:80]
        kinds = [s.split(":")[0] for s in base]
        assert [got[i][f"n_{k}"] for k in personal.KINDS] == [kinds.count(k) for k in personal.KINDS]
    assert personal.find_personal(X.empty(spark), ["doc_id"]).count() == 0


def test_good_patterns_find_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "5105105105105100",
             "4222222222222220", "4000056655665556"]
    texts = [f"the cardnumber {c} was given" for c in cards] + ["é the cardnumber 1234567890123456 too", "the word 1234567890123456"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    found = {r["doc_id"]: [tuple(s) for s in r["_new"]] for r in personal.find_personal(rows, ["doc_id"]).collect()}
    assert found.pop(7) == [("card", 17, 33)] and not any(found.values())


def test_short_labels_and_separated_numbers_are_found(spark):
    texts = [f"call phone +1 743 555 {1000 + 37 * i} today" for i in range(20)] + ["call phone (555) 123 4567 now"]
    texts += [f"my ip {i}.1.2.{i} here" for i in range(1, 10)] + ["my ip 300.1.1.1"]
    texts += [f"电话 +86 10 5555 {2000 + i}。" for i in range(8)] + ["电话 10 5555 1234"]
    texts += [f"see x{i}@y{i}.example.org for help" for i in range(8)] + ["see a@münchen.de for help"]
    texts += ["room 12 34 56 78 90 is free", "in 2020 2021 2022 2023 they"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    found = {r["doc_id"]: [(k, texts[r["doc_id"]][a:b]) for k, a, b in r["_new"]]
             for r in personal.find_personal(rows, ["doc_id"]).collect()}
    assert {i: f for i, f in found.items() if f} == {
        20: [("phone", "(555) 123 4567")], 30: [("ip", "300.1.1.1")], 39: [("phone", "10 5555 1234")],
        48: [("email", "a@münchen.de")]}


def plain_scores(edges):
    """Both scores of the graph, round by round, in plain Python."""
    total = Counter(w for w, *_ in edges)
    score = {}
    for _, kind, x, seed in edges:
        score[x, kind] = max(score.get((x, kind), 0.0), float(seed))
    for _ in range(personal.ROUNDS):
        known, good = Counter(), {}
        for w, kind, x, _ in edges:
            known[w, kind] += score[x, kind]
        for (w, kind), n in known.items():
            if n >= personal.MIN_SUPPORT and n / total[w] >= personal.MIN_CONFIDENCE:
                good[w, kind] = n / total[w]
        missed, seeds = {}, set()
        for w, kind, x, seed in edges:
            missed[x, kind] = missed.get((x, kind), 1.0) * (1 - min(good.get((w, kind), 0.0), 0.99))
            if seed:
                seeds.add((x, kind))
        score = {k: 1.0 if k in seeds else 1 - m for k, m in missed.items()}
    return set(good), {k for k, v in score.items() if v >= personal.MIN_SCORE - 1e-12}


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_graph_scores_equal_plain_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BESIDE_BYTES", limit)
    monkeypatch.setattr(joins, "KEY_ROWS", 4)
    rng = random.Random(3)
    edges = {}
    for _ in range(900):
        x = rng.randrange(90)
        kind = "card" if x % 3 else "phone"
        word = rng.choice(["<a", "<b", ">c", "<d e"]) if rng.random() < 0.5 else f"<w{rng.randrange(40)}"
        if word == "<a" and x % 3 == 0:
            continue
        edges[word, kind, f"x{x}"] = x % 8 != 0
    table = spark.createDataFrame([(*k, v) for k, v in edges.items()],
                                  "word STRING, kind STRING, instance STRING, seed BOOLEAN")
    patterns, instances = personal.pattern_scores(table)
    expected = plain_scores([(*k, v) for k, v in edges.items()])
    assert ({tuple(r) for r in patterns.collect()}, {tuple(r) for r in instances.collect()}) == expected
    assert len(expected[0]) > 3


def test_running_totals_in_blocks(spark):
    row = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).cast("array<bigint>").alias("x"))
    got = row.select(personal.running_totals(F.col("x")).alias("t")).first()["t"]
    assert got == list(np.cumsum(np.arange(1, 1001)))


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/'>Home {0}</a></li></ul></nav><div class='ad'>Buy {0}</div><article><h1>Head {0}</h1>"
        "<p><b>Text&nbsp;&amp; more {0}.<br><p>Second\n  <i>par</i>agraph {0}</p><div class='comments'><p>I like {0}</p></div>"
        "<p>Read our rules.</p></article><footer>&copy; {0}</footer>{1}")
PLAIN = "<html><body><div id=top>Site {0}</div><div class=content><p>One {0} long text here.<p>Two {0}</div><p>Terms</body></html>"


def test_main_text(spark, tmp_path):
    rows = [(i, "http://a.com/x", PAGE.format(f"w{i}", "</body></html>" * (i % 2))) for i in range(9)]
    rows += [(20 + i, "http://b.com/x", PLAIN.format(f"w{i}" * 4)) for i in range(6)]
    rows += [(40, None, None), (41, "http://c.com/", ""), (42, "http://c.com/", "<p>a<p>b &lt;c&gt; <!-- no --> d"), (None, "u", "x &am"),
             *((43 + i, "http://d.com/", "<div>" * 3000 + f"deep{i}" + "<p>" * 3000) for i in range(5))]
    table = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("_host", F.lit(1))
    folder = X.as_folder(tmp_path, pages=table)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.query(spark, folder).collect()}
    for i in range(9):
        assert got[i][0] == f"Head w{i} Text & more w{i}. Second paragraph w{i}"
    for i in range(6):
        w = f"w{i}" * 4
        assert got[20 + i][0] == f"One {w} long text here. Two {w}"
    assert got[40] == got[41] == ("", 0) and got[42][0] == "a b <c> d" and got[None] == ("x &am", 5)
    assert got[43][0] == "deep0"
    assert pages.extract(table.limit(0), ["page_id"]).count() == 0


def test_tree_matching_counts_pairs():
    tree = lambda html: pages.Tree(pages.parse(html))
    a, b = tree("<div><p>1</p><ul><li>x</li><li>y</li></ul></div>"), tree("<div><ul><li>x</li></ul><p>2</p></div>")
    assert pages.matching(a, b)[0] == 4 and pages.matching(a, a)[0] == 6


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.query(spark, folder).collect()
    assert len(rows) == 10000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) > 0.98


def test_quality_without_labels_and_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (3, 7, 0), (3, 0, 0), (3, 1, 0)],
                                   "doc_id BIGINT, quality INT, toxic INT")
    folder = X.as_folder(tmp_path, documents=X.clashing(spark), labels=labels)
    scores = {r["score"] for r in quality.query(spark, folder).collect()}
    assert scores == {1.0}
    sets = quality.with_indicators(X.empty(spark), ["doc_id"])
    assert quality.score(sets, 0.5, ["doc_id"]).count() == 0
    assert quality.train(sets.selectExpr("doc_id", "1 AS label", "_set")) == 0.5


def test_packed_sets():
    for found in ([], [0], [65535], [0, 1, 255, 256, 511, 65535], list(range(0, 65536, 255)), list(range(0, 65536, 256))):
        assert quality.unpacked(quality.packed(np.array(found, np.uint16))).tolist() == found


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(50, 10, replace=False)) + (100 if i % 2 else 0) for i in range(40)]
    sets = [np.append(s, 60).astype(np.uint16) for s in sets]
    values = [np.full(len(s), len(s) ** -0.5) for s in sets]
    signs = np.where(np.arange(40) % 2, 1.0, -1.0)
    w = quality.hinge_by_dual_descent(sets, values, signs, np.ones(40))
    assert all(y * (w[s] @ v + w[-1]) > 0 for s, v, y in zip(sets, values, signs))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    extra = [*REPEATS, *near_texts(), *[f"{t} {X.prose(__import__('random').Random(len(t)), 40)}" for t in LEAKS + SECRETS]]
    table = X.docs(spark, extra)
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    folder = X.as_folder(tmp_path, documents=table, benchmark=items)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, folder).collect()}

    rows = [r for r in X.rows(extra) if plain_rules(r[1])[-1]]
    group = plain_groups([plain_print(r[1]) for r in rows])
    kept = {}
    for g, r in zip(group, rows):
        if g not in kept or (r[0] is None, r[0] or 0) < (kept[g][0] is None, kept[g][0] or 0):
            kept[g] = r
    texts = {}
    for r in kept.values():
        text, words = r[1], None
        hit = hit_words(text)
        raw = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        for a, b in reversed(spans_of(hit)):
            text = text[:raw[a][0]] + text[raw[b - 1][1]:]
        texts[r[0]] = text
    cleaned = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    found = secrets.find_secrets(cleaned, secrets.train(cleaned), ["doc_id", "text"]).collect()
    p = pieces.Pieces(pieces.model_bytes(pieces.MODEL_PATH))
    import pyarrow as pa
    for r in found:
        whole = secrets.redacted(r["text"], r["_spans"], "[SECRET]")
        assert got[r["doc_id"]] == pieces.encode_slice(pa.array([whole]), p).to_pylist()[0], r["doc_id"]
    assert set(got) == set(texts)


def hit_words(text):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit = cut.findall(text.translate(LOWER)), set()
    for _, body in ITEMS:
        w = cut.findall((body or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            part = w[i:i + 10]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
    return sorted(hit)


def spans_of(hit):
    out = []
    for i in hit:
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return out


def test_stages_keep_the_columns(spark, tmp_path):
    folder = X.as_folder(tmp_path, documents=X.docs(spark), benchmark=spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING"))
    docs = X.clashing(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, X.empty(spark), folder).count() == 0, name


def texts_of_pages(spark, hosts: dict) -> dict:
    rows = [(f"{host}{i}", f"http://{host}.com/{i}", html) for host, each in hosts.items() for i, html in enumerate(each)]
    table = spark.createDataFrame(rows, "page_id STRING, url STRING, html STRING").repartition(3)
    return {r["page_id"]: r["text"] for r in pages.extract(table, ["page_id"]).collect()}


def test_wrappers_of_all_pages(spark, monkeypatch):
    page = "<body><div class=top>Welcome here</div><div class=body><p>{0}</p><p>{1}</p></div><p>All rights</p></body>"
    long = "A long paragraph that many near copies share word for word"
    copies = [page.format(f"Story {i} " * 5, f"end {i}") for i in range(5)]
    hosts = {"copies": [*copies, *[copies[k] for k in range(5) for _ in range(20)]], "two": copies[:2],
             "near": [*(page.format(long + " again and again", f"{long} on day") + f"<p>{i}</p>" for i in range(30)),
                      *(page.format(f"Other {i} " * 9, f"last {i}") for i in range(10))]}
    for size in (pages.BROADCAST_BYTES, 0):
        monkeypatch.setattr(pages, "BROADCAST_BYTES", size)
        monkeypatch.setattr(pages, "PAGES_PER_TASK", 7)
        got = texts_of_pages(spark, hosts)
        for i in range(5):
            assert got[f"copies{i}"] == f"{'Story %d ' % i * 5}end {i}"
        assert got["two0"] == "Story 0 " * 5 + "end 0"
        assert got["near0"] == f"{long} again and again {long} on day"
        assert got["near35"] == "Other 5 " * 9 + "last 5"


def test_matching_of_long_lists():
    tree = lambda n, other: pages.Tree(pages.parse("<ul>" + "<li><p>x</p></li>" * n + other + "</ul>"))
    a, b = tree(300, "<h1>a</h1>"), tree(299, "<li><div>y</div></li><h1>b</h1>")
    size, pairs = pages.matching(a, b)
    assert size == len(pairs) == 2 + 299 * 2 + 1 + 1


def test_slots_choose_the_content_over_article_tags(spark):
    cards = "<article class=card><p>Card {0}</p></article>" * 2
    body = ("<body><div class=story><h1>Title {0}</h1><p>" + "Body {0} text " * 20 + "</p>"
            "<article class=comment><p>I like {0}</p></article></div><div class=more>" + cards + "</div>")
    tagged = ("<body><div class=x><article class=post><h1>Head {0}</h1><div><p>" + "Long {0} text " * 9 + "</p></div></article>"
              "<article class='related'><p>Other {0} " + "and more " * 9 + "</p></article></div>")
    got = texts_of_pages(spark, {"div": [body.format(i) for i in range(5)], "tag": [tagged.format(i) for i in range(5)],
                                 "one": [tagged.format(7)]})
    for i in range(5):
        assert got[f"div{i}"] == f"Title {i} " + f"Body {i} text " * 19 + f"Body {i} text"
        assert got[f"tag{i}"] == f"Head {i} " + f"Long {i} text " * 8 + f"Long {i} text"
    assert got["one0"] == "Head 7 " + "Long 7 text " * 8 + "Long 7 text"


def test_words_of_a_name_decide_nothing_inside_the_content(spark):
    page = ("<body><div class='site-header'>Site {0}</div><div class=story><div class='post-header'><h1>Title {0}</h1></div><p>"
            + "Body {0} text " * 20 + "</p><p class='related-work'>Earlier {0} work</p><div class='share-box'>Tell your friends</div>"
            "<div class='related-posts'><a href=x>Other {0} post</a> <a>More {0}</a></div><div class='comment-list'>I like {0}</div>"
            "<div hidden>Kept {0}</div></div></body>")
    lone = ("<article><div class='article-header'><h1>Title</h1></div><p>First.</p><p class='related-work'>Work.</p>"
            "<div class='search-results-study'>Study.</div><div class=related>Gone.</div><p>Last.</p></article>")
    got = texts_of_pages(spark, {"many": [page.format(f"n{i}") for i in range(6)], "one": [lone]})
    for i in range(6):
        w = f"n{i}"
        assert got[f"many{i}"] == f"Title {w} " + f"Body {w} text " * 20 + f"Earlier {w} work Kept {w}"
    assert got["one0"] == "Title First. Work. Study. Last."


def plain_texts(spark, hosts):
    """Main texts by wrappers of all pages of a host, counted in plain Python."""
    out = {}
    for host, htmls in hosts.items():
        marks = [r["h"] for r in spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "i INT, html STRING").select(
            "i", F.xxhash64("html").alias("h")).orderBy("i").collect()]
        different = sorted({(m, h) for m, h in zip(marks, htmls) if h})
        wrapper = None
        if len({m for m, _ in different}) > 1:
            pivot = pages.tree_of(different[0][1])
            seen = {}
            for _, html in different:
                name, items = pages.observed(pivot, pages.tree_of(html))
                for path, text, size in items:
                    key = (name, path, text)
                    seen[key] = max(seen.get(key, 0), size)
                seen.setdefault((name, None, None), 0)
            n = len({k[0] for k in seen})
            if n >= pages.MIN_ALIGNED:
                count, total = Counter(k[1:] for k in seen if k[1] is not None), Counter()
                for (_, path, text), size in seen.items():
                    total[path, text] += size
                same = sorted((p, t, total[p, t]) for (p, t), c in count.items() if t and c >= pages.SHARED * n)
                varying = Counter()
                for (p, t), c in count.items():
                    if not (t and c >= pages.SHARED * n):
                        varying[p] += total[p, t]
                wrapper = pages.induce(pivot, same, dict(varying))
                wrapper["template"] = {tuple(x) for x in wrapper["template"]}
        out |= {f"{host}{i}": pages.main_text(h, wrapper) for i, h in enumerate(htmls)}
    return out


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_texts_equal_wrappers_counted_in_python(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BESIDE_BYTES", limit)
    monkeypatch.setattr(joins, "KEY_ROWS", 5)
    rng = random.Random(4)
    page = ("<body><div class=top>Welcome {3}</div><div class=body><h1>{0}</h1><p>{1}</p><div class='note-box'>{2}</div></div>"
            "<div class='side-menu'><a>Go {3}</a></div><p>All rights</p></body>")
    hosts = {}
    for host in range(4):
        fixed = [X.prose(rng, 4) for _ in range(3)]
        hosts[f"h{host}x"] = [page.format(X.prose(rng, 5), X.prose(rng, rng.randint(1, 90)), rng.choice(fixed), fixed[0])
                              for _ in range(rng.choice([2, 3, 25]))] + [""]
    hosts["h0x"] += hosts["h0x"][:2] * 3 + [page.format("Long", X.prose(rng, 30000), "n", "m")]
    assert texts_of_pages(spark, hosts) == plain_texts(spark, hosts)


def test_class_counts_equal_plain_counts(spark):
    texts = [(i, t, i % 2) for i, t in enumerate([r[1] for r in X.rows() if r[1] is None or len(r[1]) < 5000])]
    table = spark.createDataFrame(texts, "doc_id INT, text STRING, label INT").repartition(4)
    rows = quality.with_indicators(table, ["doc_id", "label"])
    total, counts = quality.class_counts(rows)
    plain = [Counter(), Counter()]
    for row in rows.collect():
        plain[row["label"]].update(quality.unpacked(row["_set"]).tolist())
    assert total.tolist() == [sum(x[2] == c for x in texts) for c in (0, 1)]
    assert all(plain[c] == {int(i): int(counts[c, i]) for i in np.flatnonzero(counts[c])} for c in (0, 1))
    ratios = quality.log_count_ratios(counts)
    smooth = [[plain[c][i] + quality.SMOOTHING for i in range(quality.BUCKETS)] for c in (0, 1)]
    for i in (0, 1, *list(plain[1])[:20]):
        assert ratios[i] == pytest.approx(np.log(smooth[1][i] / sum(smooth[1])) - np.log(smooth[0][i] / sum(smooth[0])))


def test_dual_descent_reaches_the_least_loss():
    """Weights against many plain steps over dense rows until nothing moves."""
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(30, rng.integers(2, 9), replace=False)) for _ in range(40)]
    values = [rng.normal(0, 1, len(s)) for s in sets]
    signs, cost = rng.choice([-1.0, 1.0], 40), rng.uniform(0.1, 1.0, 40)
    x = np.zeros((40, 31))
    for i, (s, v) in enumerate(zip(sets, values)):
        x[i, s], x[i, 30] = v, 1.0
    alpha = np.zeros(40)
    for _ in range(3000):
        for i in range(40):
            w = (alpha * signs) @ x
            alpha[i] = min(max(alpha[i] - (signs[i] * (x[i] @ w) - 1) / (x[i] @ x[i]), 0.0), cost[i])
    loss = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - signs * (x @ w))
    least = loss((alpha * signs) @ x)
    found = quality.hinge_by_dual_descent(sets, values, signs, cost)
    found = loss(np.append(found[:30], found[-1]))
    assert least <= found + 1e-9 and found <= least * 1.01 + 1e-6


def test_segments_against_all_segments():
    """Every found part reaches the ratio; where any part reaches it by character, one that meets it is found."""
    rng = random.Random(10)
    ratios = secrets.ratio_table([{"random": 0, "pair": int(p), "n": int(n)} for p, n in enumerate(
        secrets.value_pairs([w.encode() for w in X.WORDS * 400])) if n])
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = 0
    for _ in range(300):
        parts = ["_".join(rng.choices(X.WORDS, k=rng.randint(1, 5))) if rng.random() < 0.6
                 else "".join(rng.choices(letters, k=rng.randint(22, 40))) for _ in range(rng.randint(1, 3))]
        raw = np.frombuffer("_".join(parts).encode(), np.uint8)
        codes = secrets.CODE[raw]
        each = ratios[np.concatenate([[0], codes[:-1]]), codes]
        total = np.concatenate([[0.0], np.cumsum(each)])
        least = max(secrets.MIN_RATIO, secrets.MIN_RATIO_PER_CHAR * secrets.MIN_LENGTH)
        found = secrets.unlikely_parts(raw, codes, ratios)
        assert all(total[b] - total[a] >= least - 1e-9 and secrets.mixed(raw[a:b]) for a, b in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        best = max(((total[b] - total[a] - secrets.MIN_RATIO_PER_CHAR * (b - a), a, b) for a in range(len(raw))
                    for b in range(a + secrets.MIN_LENGTH, len(raw) + 1) if secrets.mixed(raw[a:b])), default=(-1, 0, 0))
        if best[0] >= 0:
            some += 1
            assert any(a < best[2] and b > best[1] for a, b in found), bytes(raw)
    assert some > 60
