import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge.operators import diversity, joins, overlaps, similarity, vector_index


def table(spark, sets):
    rows = [(i, None if s is None else sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "pos BIGINT, b ARRAY<INT>")
    return similarity.add_fingerprint(df, F.col("b")).drop("b")


def sim(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def greedy(sets, threshold, keep):
    kept = []
    for i, s in enumerate(sets):
        if s is None:
            continue
        if all(sim(s, sets[k]) <= threshold for k in kept):
            kept.append(i)
        if len(kept) >= keep:
            break
    return kept


def near_copies(seed, n=300, hot=100):
    rng = random.Random(seed)
    base = set(rng.sample(range(1024), 40))
    sets = []
    for i in range(n):
        if i % 3 == 0:
            s = set(base)
            for _ in range(rng.randint(0, 3)):
                s.discard(rng.choice(sorted(s)))
        elif i % 17 == 0:
            s = None
        elif i % 29 == 0:
            s = set()
        else:
            s = set(rng.sample(range(60), rng.randint(3, 12)))
        sets.append(s)
    return sets


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("rows,look,keep", [(100_000, 2000, 100), (13, 2000, 40), (13, 3, 40), (1, 2000, 9)])
def test_equals_plain_greedy(spark, monkeypatch, seed, rows, look, keep):
    monkeypatch.setattr(diversity, "RANGE_ROWS", rows)
    monkeypatch.setattr(diversity, "LOOK_ROWS", look)
    sets = near_copies(seed, 200 if rows > 1 else 40)
    threshold = 0.5
    got = diversity.choose_diverse(table(spark, sets).repartition(5), threshold, keep)
    assert sorted(r["k_pos"] for r in got.collect()) == greedy(sets, threshold, keep)


def chain(n):
    return [set(range(5 * i, 5 * i + 100)) for i in range(n)]


def copies_of(groups, n, seed=5):
    """Near copies of a few sets, in mixed order."""
    rng = random.Random(seed)
    bases = [set(rng.sample(range(1024), 60)) for _ in range(groups)]
    return [set(rng.choice(bases)) - {rng.randrange(1024)} for _ in range(n)]


@pytest.mark.parametrize("sets,rounds", [
    (chain(180), 40), ([{i, i + 1, i + 300} for i in range(700)], 3), (copies_of(12, 400), 5), (copies_of(1, 300), 3)])
def test_few_rounds_choose_all(spark, monkeypatch, sets, rounds):
    monkeypatch.setattr(diversity, "RANGE_ROWS", 20)
    found, taken = diversity.rounds_of_choice(table(spark, sets), 0.8, 100)
    assert [r["pos"] for r in found] == greedy(sets, 0.8, 100)
    assert taken <= rounds


def test_chain_keeps_both_ends(spark):
    a = set(range(100))
    b = set(range(5, 105))
    c = set(range(12, 112))
    assert sim(a, b) > 0.8 > sim(a, c)
    got = diversity.choose_diverse(table(spark, [a, b, c]), 0.8)
    assert sorted(r["k_pos"] for r in got.collect()) == [0, 2]


def test_similarity_equal_to_the_threshold_is_kept(spark):
    a, b = set(range(10)), set(range(8))
    assert sim(a, b) == 0.8
    got = diversity.choose_diverse(table(spark, [a, b]), 0.8)
    assert got.count() == 2


def test_at_most_hundred_and_unchanged_cases(spark):
    sets = [{i, i + 1, i + 300} for i in range(150)]
    df = table(spark, sets)
    kept = diversity.diversity_filter(df, "protac", F.col("pos"), [F.asc("pos")])
    assert sorted(r["pos"] for r in kept.collect()) == list(range(100))
    none = table(spark, [None, None])
    assert diversity.diversity_filter(none, "protac", F.col("pos"), [F.asc("pos")]).count() == 2
    plain = df.select("pos")
    assert diversity.diversity_filter(plain, "protac", F.col("pos"), [F.asc("pos")]).count() == 150


def plain_links(sets, threshold):
    """Class and number of links of every row with bits."""
    return {i: (sets.index(s), sum(1 for j, t in enumerate(sets) if t and j != i and sim(s, t) > threshold))
            for i, s in enumerate(sets) if s}


def test_links_count_copies_and_near_rows(spark):
    a = set(range(50))
    sets = [a, a | {60}, {200, 201}, a, {200, 201}, None, set()]
    got = {r["pos"]: (r["class_id"], r["n_links"]) for r in diversity.near_duplicate_links(table(spark, sets)).collect()}
    assert got == {0: (0, 2), 1: (1, 2), 2: (2, 1), 3: (0, 2), 4: (2, 1)}


def long_sets(n=60):
    """Sets of 400 bits and more, in groups around the threshold."""
    rng = random.Random(11)
    base = [set(rng.sample(range(1024), size)) for size in (410, 430, 600, 950)]
    out = []
    for i in range(n):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 60)):
            s ^= {rng.randrange(1024)}
        out.append(s)
    return out


@pytest.mark.parametrize("threshold,block", [(0.6, 8192), (0.8, 8192), (0.8, 16)])
def test_links_of_all_rows(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(diversity, "BLOCK_ROWS", block)
    sets = [*near_copies(7, 200), {1}, {2}, {1}, set(range(1000)), set(range(1, 1000)), *long_sets()]
    got = diversity.near_duplicate_links(table(spark, sets), threshold).collect()
    expected = plain_links(sets, threshold)
    assert {r["pos"]: (r["class_id"], r["n_links"]) for r in got} == expected and len(got) == len(expected)


def test_copies_of_one_fingerprint_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BESIDE_BYTES", 0)
    monkeypatch.setattr(joins, "KEY_ROWS", 10)
    sets = [{1, 2, 3}] * 95 + [{4}, {5}, {4}] + [{1, 2, 3, 9}] * 3
    got = diversity.near_duplicate_links(table(spark, sets), 0.7).collect()
    assert {r["pos"]: (r["class_id"], r["n_links"]) for r in got} == plain_links(sets, 0.7) and len(got) == len(sets)


def test_rows_that_meet_grow_with_the_table(spark):
    """Every row goes to its own class's task and to two neighbours', however many rows are near."""
    for n in (200, 800):
        sets = [frozenset(random.Random(i).sample(range(1024), 20 + i % 200)) for i in range(n)]
        firsts = diversity.distinct_fingerprints(table(spark, sets))
        assert n <= diversity.dealt_blocks(firsts.drop("copies"), 0.8).count() <= 3 * n


def test_no_link_between_different_sets_is_lost(spark):
    a, c = set(range(20)), set(range(1, 21))
    b = set(range(2, 22))
    for sets in ([a, b, c, c, a], [*near_copies(8, 150)], long_sets()):
        got = {(r["pos"], r["near_pos"]) for r in diversity.near_duplicate_pairs(table(spark, sets), 0.85).collect()}
        first = {i: sets.index(s) for i, s in enumerate(sets) if s}
        expected = {(i, first[i]) for i in first if first[i] < i} | {
            (i, j) for i in first for j in first if j < i and first[i] == i and first[j] == j and sim(sets[i], sets[j]) > 0.85}
        assert got == expected
        if len(sets) == 5:
            assert got == {(2, 0), (2, 1), (3, 2), (4, 0)}


def query_table(spark, sets):
    return table(spark, sets).withColumnRenamed("pos", "query_pos").withColumn(
        "query", F.concat(F.lit("q"), "query_pos"))


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("rows", [16_384, 7])
def test_search_equals_all_pairs(spark, monkeypatch, threshold, rows):
    monkeypatch.setattr(overlaps, "PASS_ROWS", rows)
    sets = near_copies(3, 120)
    queries = near_copies(4, 20)
    got = similarity.find_similar(table(spark, sets), query_table(spark, queries), "pos", threshold)
    expected = {(f"q{j}", i) for j, q in enumerate(queries) for i, s in enumerate(sets)
                if q and s and sim(q, s) >= threshold}
    rows = got.collect()
    assert {(r["query"], r["pos"]) for r in rows} == expected and len(rows) == len(expected)


@pytest.mark.parametrize("rows,batch", [(16_384, 10_000), (7, 11)])
def test_top_hits_equal_all_pairs_with_ties(spark, monkeypatch, rows, batch):
    monkeypatch.setattr(overlaps, "PASS_ROWS", rows)
    sets = [*near_copies(3, 150), *near_copies(3, 150)]
    queries = near_copies(4, 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = similarity.top_similar(table(spark, sets).repartition(3), query_table(spark, queries), "pos", 4, 0.1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = set()
    for j, q in enumerate(queries):
        hits = sorted((-sim(q, s), i) for i, s in enumerate(sets) if q and s and sim(q, s) >= 0.1)[:4]
        expected |= {(f"q{j}", i) for _, i in hits}
    assert {(r["query"], r["pos"]) for r in got} == expected and len(got) == len(expected) > 40


def test_search_ends_before_all_size_classes():
    rng = random.Random(2)
    sets = [set(rng.sample(range(1024), n)) for n in range(10, 900) for _ in range(2)]
    asked = [set(s) ^ {rng.randrange(1024)} for s in sets[::50]]

    def packed(rows):
        plain = np.zeros((len(rows), 1024), np.uint8)
        for i, s in enumerate(rows):
            plain[i, list(s)] = 1
        return np.packbits(plain, axis=1, bitorder="little").view(np.uint64), plain.sum(axis=1).astype(int)

    edges = similarity.size_edges(0.5)
    hits = overlaps.TopHits(len(asked), 1, 0.0)
    visited = overlaps.bounded_search(*packed(sets), pa.array(range(len(sets))), *packed(asked), hits, edges)
    best = [max((sim(q, s), -i) for i, s in enumerate(sets)) for q in asked]
    assert [(h[0][0], -h[0][1]) for h in hits.best] == best
    assert len(asked) <= visited < 0.3 * len(asked) * len(edges)


def test_vector_search_of_many_queries(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id BIGINT, v ARRAY<DOUBLE>")
    asked = table.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("query_vector"))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    expected = {(q, i) for q, w in rows[::5] for _, i in sorted((-cosine(v, w), i) for i, v in rows)[:10]}
    for limit in (7, 1000):
        monkeypatch.setattr(overlaps, "PASS_ROWS", limit)
        got = similarity.cosine_top_k(table, asked, "vec_id", "v", 10).collect()
        assert {(r["query"], r["vec_id"]) for r in got} == expected and len(got) == len(expected)


def clustered(n, seed=3, groups=12):
    """Vectors around a few directions, some of them equal, and rows that have no cosine."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (groups, 16))
    rows = [(i, (centre[i % groups] + rng.normal(0, 0.1, 16)).tolist()) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(30)]
    return rows + [(n + 100, None), (n + 101, [0.0] * 16), (n + 102, [1.0]), (n + 103, [float("nan")] * 16)]


@pytest.mark.parametrize("limit", [16_384, 9])
def test_index_search_is_exact_and_reads_few_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(overlaps, "PASS_ROWS", limit)
    rows = clustered(600)
    table = spark.createDataFrame(rows, "vec_id BIGINT, v ARRAY<DOUBLE>").repartition(4)
    asked = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("query_vector"))
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    cosine = lambda a, b: round(float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())), 12)
    expected = {(q, i) for q, w in good if q % 20 == 0 for _, i in sorted((-cosine(v, w), i) for i, v in good)[:5]}
    index = vector_index.build_index(table, "vec_id", "v")
    assert index.counts.sum() == len(good)
    found, share = vector_index.search_index(index, asked, 5)
    assert {(r["query"], r["vec_id"]) for r in found.collect()} == expected and share < 0.3
    plain = similarity.cosine_top_k(table, asked, "vec_id", "v", 5)
    assert {(r["query"], r["vec_id"]) for r in plain.collect()} == expected


def test_index_of_few_or_no_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id BIGINT, v ARRAY<DOUBLE>")
    asked = table.select(F.col("vec_id").alias("query"), F.col("v").alias("query_vector"))
    found, _ = vector_index.search_index(vector_index.build_index(table, "vec_id", "v"), asked, 10)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0)]
    none = vector_index.build_index(table.limit(0), "vec_id", "v")
    assert vector_index.search_index(none, asked, 10)[0].count() == 0
    assert vector_index.search_index(none, asked.limit(0), 10)[0].count() == 0


def test_near_divides_only_pairs_that_can_pass_and_unpacks_a_side_once(monkeypatch):
    rng = np.random.default_rng(3)
    bits = rng.random((40, 1024)) < np.linspace(0.2, 0.3, 40)[:, None]
    bits = np.repeat(bits, 60, axis=0) ^ (rng.random((2400, 1024)) < 0.03)
    bits[0], bits[1], bits[2] = np.arange(1024) < 10, np.arange(1024) < 8, False  # exactly 0.8, and no bits
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    sizes = bits.sum(axis=1).astype(np.int64)
    unpacked, real = [], overlaps.bits_of
    monkeypatch.setattr(overlaps, "bits_of", lambda w: (unpacked.append(len(w)), real(w))[1])
    shared = bits.astype(np.float32) @ bits.T.astype(np.float32)
    every = overlaps.tanimoto_matrix(shared, sizes, sizes)
    side = overlaps.Sized(words, sizes)
    for strict in (True, False):
        unpacked.clear()
        got = {(int(x), int(y)): s for part in overlaps.near(side, side, 0.8, strict) for x, y, s in zip(*part)}
        wanted = np.argwhere(every > 0.8 if strict else every >= 0.8)
        assert got == {(int(x), int(y)): every[x, y] for x, y in wanted}
        assert len(got) > 2400 and ((0, 1) in got) is not strict
        assert sum(unpacked) == 4800
