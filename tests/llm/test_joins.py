"""Jaccard join, embedding join, substring dedup and components against brute force, and their hard cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import DATA
from test_text_ops import HARD, words

from marlstone.llm import embeddings, jaccard, substring
from marlstone.llm.components import components
from marlstone.llm.registry import QUERIES


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components ----


@pytest.mark.parametrize("kind", ["path", "star", "random", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(i, 500) for i in range(100)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "none": [],
        "loops": [(7, 7), (8, 9), (9, 8), (8, 9)],
    }[kind]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert got == roots(nodes, [e for e in links if e[0] != e[1]])


# ---- 3: Jaccard join ----


def test_solve_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        n, base = rng.randint(1, 25), [set(rng.sample(range(200), rng.randint(1, 40))) for _ in range(4)]
        sets = []
        for _ in range(n):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                s ^= {rng.randint(0, 400)}
            sets.append(s or {1})
        num, den = rng.choice([(85, 100), (80, 100), (50, 100)])
        links = [(i, j) for i in range(n) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
        got = jaccard.solve([np.array(sorted(s), np.uint64) for s in sets], num, den)
        assert all((i, j) in links or (j, i) in links for i, j in got)
        assert roots(range(n), links) == roots(range(n), got)


def brute_jaccard(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    flat = [(i, s) for i, x in sets.items() for s in x]
    links = [(a, b) for a, s in flat for b, t in flat if a is not None and b is not None and a < b and s and t and den * len(s & t) >= num * len(s | t)]
    root = roots([i for i in sets if i is not None], links)
    return {(i, len(s), None if i is None else root[i]) for i, s in flat}


def near_copies(seed, groups=6, copies=12):
    rng = random.Random(seed)
    shared = " ".join(f"p{j}" for j in range(30))
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 20, 80, 200]))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = f"W{rng.randrange(300)}"
            rows.append(" ".join(t) + (f" {shared}" if rng.random() < 0.3 else ""))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "region"), [(1, 2048), (2, 3), (3, 3)])
def test_jaccard_components(documents, monkeypatch, seed, region):
    """Regions in one task, and regions taken apart into windows and blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = near_copies(seed)
    out = jaccard.jaccard_components(documents([(i, t, "en", "s") for i, t in rows]), words=4, threshold=(85, 100), region=region).collect()
    assert {tuple(r) for r in out} == brute_jaccard(rows, 4, 85, 100)


def mutants(rng, n, families, length, most):
    """Families of texts that differ from their first in up to `most` words."""
    rows = []
    for i in range(n):
        f = rng.randrange(families)
        w = [f"f{f}w{j}" for j in range(length)]
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("pivots", [8, 24])
def test_voronoi_without_blocks(documents, monkeypatch, pivots):
    """Groups of near copies far beyond a region's bound are joined by their pivots' cells alone."""
    monkeypatch.setattr(jaccard.voronoi, "__defaults__", (*jaccard.voronoi.__defaults__[:2], pivots))
    monkeypatch.setattr(jaccard, "_blocks", None)
    rows = mutants(random.Random(6), 400, 3, 60, 4)
    out = jaccard.jaccard_components(documents([(i, t, "en", "s") for i, t in rows]), words=2, threshold=(80, 100), region=20).collect()
    assert {tuple(r) for r in out} == brute_jaccard(rows, 2, 80, 100)


def test_voronoi_of_points_far_from_each_other(documents):
    """Where no pivot splits a region, blocks give the same."""
    rng = random.Random(8)
    lines = [" ".join(f"l{k}w{j}" for j in range(6)) for k in range(30)]
    rows = [(i, "\n".join(rng.sample(lines, rng.randint(6, 9)))) for i in range(150)] + [(500 + i, "\n".join(lines[i : i + 9])) for i in range(20)]
    rows += [(600 + i, t + " end") for i, t in rows[:10]]
    out = jaccard.jaccard_components(documents([(i, t, "en", "s") for i, t in rows]), words=2, threshold=(80, 100), region=4).collect()
    assert {tuple(r) for r in out} == brute_jaccard(rows, 2, 80, 100)


def test_distances():
    rng = random.Random(2)
    sets = [set(rng.sample(range(100), rng.randint(1, 60))) for _ in range(40)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    common, union = jaccard.distances(arrays, arrays[:7])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:7]):
            assert (common[i, j], union[i, j]) == (len(x & y), len(x | y))


def test_jaccard_hard_cases(documents):
    rows = [*enumerate(HARD), (5, HARD[5]), (None, "one two three four five"), (None, None), (90, "One TWO three four five"), (91, "one two  three\tfour five"), (92, "É one"), (93, "é one")]
    out = jaccard.jaccard_components(documents([(i, t, None, None) for i, t in rows])).collect()
    assert len(out) == len(rows)
    got = {tuple(r) for r in out}
    assert got == brute_jaccard(rows, 5, 80, 100)
    empty = documents([])
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.one_of_each(empty).columns == empty.columns


def test_one_of_each(documents):
    rows = near_copies(5)
    docs = documents([(i, t, "en", "s") for i, t in rows])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_jaccard(rows, 5, 80, 100)}


# ---- 6: embeddings ----


def brute_cosine(rows, least):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = []
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((a, b))
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = roots([i for i, _ in rows if i is not None], links)
    return {(i, n[i], root[i], root[i] == i) for i, _ in rows if i is not None}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, links int")


@pytest.mark.parametrize("tile", [4096, 7])
def test_embedding_components(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 64))
    rows = [(i, np.float32(base[rng.integers(12)] + rng.standard_normal(64) * rng.choice([0.0, 0.2, 0.45])).tolist()) for i in range(200)]
    out = embeddings.embedding_components(vectors(spark, rows), tile=tile).collect()
    assert len(out) == len(rows)
    assert {tuple(r) for r in out} == brute_cosine(rows, 0.9)


def test_embedding_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1e-30, 1e-30]), (9, [1.0, 1.0, 0.0]), (10, [3e38, 3e38]), (11, [1.0]), (12, [5.0])]
    out = embeddings.embedding_components(vectors(spark, [*rows, (None, [1.0, 1.0])])).collect()
    assert {tuple(r) for r in out if r["vec_id"] is not None} == brute_cosine(rows, 0.9)
    assert [tuple(r)[1:3] for r in out if r["vec_id"] is None] == [(0, None)]
    assert embeddings.embedding_components(vectors(spark, [])).count() == 0


def test_embedding_bound_and_repeated_keys(spark):
    """Cosines of exactly 0.8 link at 0.8; rows that repeat a key count once, whatever their vectors; copies count each."""
    rows = [(1, [1.0, 0.0]), (2, [4.0, 3.0]), (3, [8.0, 6.0]), (4, [4.0, 3.001])]
    out = {r["vec_id"]: tuple(r)[1:] for r in embeddings.embedding_components(vectors(spark, rows), cosine=0.8).collect()}
    assert out == {1: (2, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (2, 1, False)}
    again = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0])]
    out = [tuple(r) for r in embeddings.embedding_components(vectors(spark, again)).collect()]
    kept = min((np.float32(v).tobytes(), v) for i, v in again if i == 5)[1]  # the least bytes
    like = [i for i, v in dict.fromkeys((i, tuple(v)) for i, v in again if i != 5) if list(v) == kept]
    assert len(out) == len(again) and {x for x in out if x[0] == 5} == {(5, len(like), 5, True)}
    assert {x[1] for x in out if x[0] in like} == {len(like)}


def test_embedding_codes_are_near():
    x = np.random.default_rng(4).standard_normal((500, 16))
    low, off = embeddings._decoded([c.tobytes() for c in embeddings._codes(x)])
    assert np.sqrt(((low - x) ** 2).sum(axis=1)).max() <= off


def test_rotation():
    q = embeddings.rotation(64)
    assert np.allclose(q @ q.T, np.eye(64), atol=1e-12)
    assert sum(s for _, _, s in embeddings.blocks_of(70)) == pytest.approx(1)


# ---- 9: substring dedup ----


def brute_repeats(rows, window):
    least = {}
    texts = [(2**63 if i is None else i, words(t)) for i, t in rows]
    for i, w in texts:
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            least[g] = min(least.get(g, i), i)
    out = set()
    for (i, _), (n, w) in zip(rows, texts, strict=True):
        gone = {j + k for j in range(len(w) - window + 1) if least[tuple(w[j : j + window])] < n for k in range(window)}
        out.add((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def passages(window, seed):
    rng = random.Random(seed)
    known = [[f"p{k}_{j}" for j in range(rng.randint(5, 40))] for k in range(5)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [f"w{rng.randrange(8)}" for _ in range(rng.randint(0, 20))] if rng.random() < 0.6 else rng.choice(known)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [rows[3], (4, "x y z " * 10), (None, rows[5][1]), (None, None), (77, ""), (78, "p0_0 " * 30)]
    rng.shuffle(rows)
    return rows


def fixed(documents, rows):
    docs = documents([(i, t, None, None) for i, t in rows]).coalesce(2)
    return docs.sparkSession.createDataFrame(docs.collect(), docs.schema)


@pytest.mark.parametrize("options", [{}, {"group": 40, "buffer": 60, "window": 5}, {"group": 10, "buffer": 300, "prints": 50, "piece": 12}, {"group": 30, "buffer": 100, "window": 3, "piece": 7}])
def test_without_repeats(documents, options):
    """In one group and buffer, in many, and documents in pieces."""
    window = options.get("window", 13)
    rows = passages(window, window + len(options))
    out = substring.without_repeats(fixed(documents, rows), **options)
    assert {(r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in out.collect()} == brute_repeats(rows, window)
    assert out.count() == len(rows)


@pytest.mark.parametrize("mask", [0, 3])
def test_without_repeats_when_hashes_collide(documents, monkeypatch, mask):
    """Words decide: with hashes of no or two bits the same words go."""
    monkeypatch.setattr(substring, "mixed", lambda h: h & np.uint64(mask))
    rows = passages(5, 17)
    out = substring.without_repeats(fixed(documents, rows), window=5, buffer=80, group=50)
    assert {(r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in out.collect()} == brute_repeats(rows, 5)


def test_without_repeats_behind_a_shuffle(documents, spark, monkeypatch):
    """Input from a shuffle, joins by shuffles, and rows in another order give the same."""
    monkeypatch.setattr(substring, "BROADCAST", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = passages(5, 18)
        for n in (3, 5):
            out = substring.without_repeats(fixed(documents, rows).repartition(n), window=5, buffer=80, group=50)
            assert {(r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in out.collect()} == brute_repeats(rows, 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nodes_of_a_suffix_tree():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (200, 6)).astype(np.int32)
    order, lcp = substring.nodes(x)
    s = [tuple(r) for r in x[order]]
    assert s == sorted(map(tuple, x))
    assert lcp[0] == -1
    for a, b, n in zip(s, s[1:], lcp[1:]):
        assert a[:n] == b[:n] and (n == 6 or a[n] != b[n])


def test_no_rows(documents):
    assert substring.without_repeats(documents([])).count() == 0
    assert substring.without_repeats(documents([(1, None, None, None), (2, "few words", None, None)])).count() == 2


def test_substring_query(spark):
    import hashlib

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute_repeats(rows, 13)}
    assert {tuple(r) for r in QUERIES["op9_substring_dedup"](spark, str(DATA)).collect()} == want
