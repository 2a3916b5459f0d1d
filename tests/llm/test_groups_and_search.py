"""SimHash groups, Poisson mixture, vector search: against brute force and DuckDB."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import components, hot, one_bit_ann, poisson_mix, queries, simhash


# ---- operator 5

def fingerprint_slowly(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + ([word] if word else []), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_slowly(ids_prints, distance):
    prints = sorted(set(p for _, p in ids_prints))
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= distance:
                up[find(a)] = find(b)
    least = {}
    for i, p in ids_prints:
        least[find(p)] = min(i, least.get(find(p), i))
    return {i: least[find(p)] for i, p in ids_prints}


def test_op5_against_brute_force(spark, small_dir, documents):
    rows = [(r.doc_id, fingerprint_slowly(r.text)) for r in documents.collect()]
    want = groups_slowly(rows, 2)
    got = queries.QUERIES["op5_simhash_groups"](spark, small_dir).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: g.fingerprint for g in got} == {i: f"{p:016x}" for i, p in rows}
    assert {g.doc_id: g.component_id for g in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("crowd,distance", [(200, 1), (200, 2), (3, 1), (3, 2), (200, 0)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd, distance):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r, prints = random.Random(1), set()
    for _ in range(5):
        x = r.getrandbits(64)
        for _ in range(30):
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
            prints.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) if r.random() < 0.5 else x)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), distance)
    assert all(bin((x.a ^ x.b) & (2**64 - 1)).count("1") <= distance for x in links.collect())
    found = {r.node: r.component for r in components.components(links).collect()}
    want = groups_slowly([(signed[p], p) for p in prints], distance)
    by_found, by_want = {}, {}
    for p, s in signed.items():
        by_found.setdefault(found.get(s, s), set()).add(s)
        by_want.setdefault(want[s], set()).add(s)
    assert sorted(map(sorted, by_found.values())) == sorted(map(sorted, by_want.values()))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(chain).collect()} == {(i, 0) for i in range(301)}


def test_simhash_edges(spark, edge, none):
    got = simhash.groups(edge).collect()
    assert len(got) == edge.count()
    comp = {}
    for g in got:
        comp.setdefault(g.id, set()).add(g.component)
    assert comp[None] == {None} and comp[1] == comp[2] == {1}
    assert comp[3] == comp[4] == comp[5] == {3}            # null, empty and blank texts link at zero
    assert all(g.fp == 0 for g in got if g.id in (3, 4, 5))
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0), (True, 0)]
    assert simhash.groups(none).count() == 0 and simhash.keep_one(none).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_join_hot_gives_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_KEYS", 5)
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1), (3, 1), (None, 9)], "k long, x long")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = hot.join_hot(rows, keys, ["k"], "n").collect()
    assert sorted(got) == sorted(rows.join(keys, "k").collect()) and len(got) == 302


# ---- operator 7

def test_op7_equals_duckdb(spark, small_dir):
    from tests.oracle_check import compare, duck
    df = queries.QUERIES["op7_poisson_mix"](spark, small_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
    rows = [tuple(r) for r in df.collect()]
    cur = duck(small_dir).execute(queries.ORACLE["op7_poisson_mix"])
    ok, why = compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description])
    assert ok, why
    keys = [r[df.columns.index("order_key")] for r in rows]
    assert keys == sorted(keys)


def poisson_slowly(rate, us):
    """Counts by inverting one draw after the other."""
    steps = max(1, math.ceil(rate / 8))
    mean, total = rate / steps, 0
    for u in us[:steps]:
        k, p = 0, math.exp(-mean)
        c = p
        while c < u:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


def test_counts_invert_the_distribution(spark):
    import hashlib
    docs = spark.createDataFrame([(i, "x" * (10 if i < 200 else 2000), "small" if i < 200 else "large") for i in range(210)],
                                 "doc_id long, text string, source string")
    weights = {"small": 9.0, "large": 1.0}
    got = {r.doc_id: r["count"] for r in poisson_mix.copies(docs, weights).groupBy("doc_id").count().collect()}
    rate = {"small": 0.9 * 22000 / 2000, "large": 0.1 * 22000 / 20000}
    for i in range(210):
        us = [int(hashlib.md5(f"mix-{i}-{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(1, 3)]
        assert got.get(i, 0) == poisson_slowly(rate["small" if i < 200 else "large"], us)
    assert abs(sum(got.get(i, 0) for i in range(200)) / 200 - rate["small"]) < 4 * math.sqrt(rate["small"] / 200)


def test_mixture_edges(edge, none, monkeypatch):
    base = edge.count()
    out = poisson_mix.mix(edge, size=3.0)
    assert set(out.columns) == set(edge.columns) and out.columns.count("copy") == 1
    assert {r.source for r in out.select("source").distinct().collect()} <= {"a", "b", "c", None}
    assert poisson_mix.mix(none).count() == 0
    assert poisson_mix.mix(edge, weights={"nowhere": 1.0}).count() == 0
    table = {r.source: r.rate for r in poisson_mix.rates(edge).collect()}
    assert table["b"] == pytest.approx(table["b"]) and min(table.values()) >= 0 and base
    same = sorted(r.order_key for r in out.collect())
    monkeypatch.setattr(poisson_mix, "MAX_BROADCAST_SOURCES", 0)     # the way for very many sources
    assert sorted(r.order_key for r in poisson_mix.mix(edge, size=3.0).collect()) == same


# ---- operator 8

def nearest_slowly(rows, k, every):
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = vectors @ vectors[i]
            others = np.flatnonzero(ids != q)
            out[int(q)] = [int(x) for x in ids[others[np.lexsort((ids[others], -s[others]))[:k]]]]
    return out


def test_op8_recall_and_scores(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    want = nearest_slowly(rows, 20, 20)
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    got = {}
    for r in queries.QUERIES["op8_one_bit_ann"](spark, small_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and r.score == pytest.approx(vectors[r.query_id] @ vectors[r.vec_id], rel=1e-12)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_blocks_do_not_change_the_result(spark, small_dir, monkeypatch):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    index = one_bit_ann.OneBitIndex(rows)
    queries_ = index.rows.where("id % 50 = 0")
    one = sorted(index.search(queries_, 5).collect())
    monkeypatch.setattr(one_bit_ann, "DATA_BLOCK", 60)
    monkeypatch.setattr(one_bit_ann, "QUERY_BLOCK", 4)
    many = sorted(index.search(queries_, 5).collect())
    same = np.mean([a.vec_id == b.vec_id for a, b in zip(one, many)])
    assert len(one) == len(many) and same >= 0.9


@pytest.mark.parametrize("dim", [1, 3, 64, 100, 130])
def test_error_bounds_hold(dim):
    r = np.random.default_rng(dim)
    vectors, centres = r.standard_normal((400, dim)), r.standard_normal((3, dim))
    cells = one_bit_ann.Cells(one_bit_ann.rotation(dim, -(-4 * dim // 64) * 64, 1), centres, 3, vectors)
    asked = r.standard_normal((20, dim))
    guess, bound = cells.estimate(asked, *cells.encode(vectors))
    assert np.mean(np.abs(guess - asked @ vectors.T) <= bound + 1e-6) > 0.97


def test_codes_are_turned_back_by_the_rotation():
    """With many bits a code says nearly the direction itself."""
    r = np.random.default_rng(3)
    vectors = r.standard_normal((50, 5))
    cells = one_bit_ann.Cells(one_bit_ann.rotation(5, 4096, 1), np.zeros((1, 5)), 1, vectors)
    guess, bound = cells.estimate(vectors, *cells.encode(vectors))
    assert np.abs(guess - vectors @ vectors.T).max() < 0.4 and bound.max() < 0.6


def test_few_cells_are_looked_into_where_vectors_cluster():
    r = np.random.default_rng(4)
    centres = 10 * r.standard_normal((40, 16))
    clustered = np.repeat(centres, 50, axis=0) + r.standard_normal((2000, 16))
    assert one_bit_ann.probes_needed(clustered, one_bit_ann.kmeans(clustered, 40, 1), 20, 0.97) <= 8
    even = r.standard_normal((2000, 16))
    assert one_bit_ann.probes_needed(even, one_bit_ann.kmeans(even, 40, 1), 20, 0.97) > 8


def test_few_rows_are_scored_exactly(spark):
    """On the 2,000 vectors of the largest small table: recall, and the share of all pairs scored."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = one_bit_ann.OneBitIndex(rows)
    asked = index.rows.where("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    share = index.candidates(asked, 21).count() / (asked.count() * index.count)
    assert share < 0.2
    found = {}
    for r in index.search(index.rows.where("id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest_slowly(rows.collect(), 20, 20)
    assert np.mean([len(found[q] & set(want[q])) / 20 for q in want]) >= 0.95


def test_copies_of_vectors(spark):
    """Many copies of one vector, more than k: ties go to the smaller ids, none is lost, and no query finds itself."""
    r = np.random.default_rng(5)
    hot = [float(x) for x in r.standard_normal(8)]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in r.standard_normal(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = one_bit_ann.OneBitIndex(df, k=5, target=1.0)
    got = {}
    for x in index.search(index.rows.where("id % 30 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    best = [i for i in range(0, 300, 3)]
    assert got == {q: [i for i in best if i != q][:5] for q in range(0, 300, 30)}


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = one_bit_ann.OneBitIndex(df)
    got = index.search(index.rows.where("id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 2, 3, 20, 20], 20: [3, 0, 1, 2]}
    empty = one_bit_ann.OneBitIndex(df.limit(0))
    assert empty.search(empty.rows, 5).count() == 0
