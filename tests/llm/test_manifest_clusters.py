"""The Merkle manifest and the clusters against plain versions."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from edge_cases import EDGE, SAME_IDS
from pyspark.sql import functions as F

from brightledger.llm import merkle_manifest as mm
from brightledger.llm import queries
from brightledger.llm import walsh_clusters as wc


def h(text):
    return sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return h("".join(part(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    """Levels from the leaves to the root, and each leaf's steps."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    steps = []
    for i in range(len(nodes)):
        own = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            own.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            i //= 8
        steps.append(own)
    return levels[-1][0], steps


def manifest(rows):
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[name] = tree([leaf(r, r["text"]) for r in by[name]])
    root, over = tree([trees[name][0] for name in names])
    out = []
    for name, top in zip(names, over):
        for r, steps in zip(by[name], trees[name][1]):
            tampered = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0
            digest = leaf(r, low(r["text"]) if tampered else r["text"])
            for a, b in steps + top:
                digest = h(a + digest + b)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[name][0], root, h("".join(a + b for a, b in steps + top)), digest, digest == root))
    return out


def run_manifest(spark, df, tmp_path, height=4):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in queries.op12_manifest(spark, str(tmp_path), height).collect()]


def docs(spark, n, langs):
    rnd = random.Random(n)
    rows = [(k if k % 11 else None if k % 5 == 0 else 3, f"Text {rnd.randrange(n)} of {k % 7}", rnd.choice(langs), None if k % 13 == 0 else "s", k) for k in range(n)]
    rows += rows[: n // 10]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, [None, "en"]), (700, ["en", "de", None, "", "é"]), (400, [f"l{k}" for k in range(90)])])
def test_manifest_equals_plain_trees(spark, tmp_path, n, langs):
    df = docs(spark, n, langs)
    got = run_manifest(spark, df, tmp_path)
    assert Counter(got) == Counter(manifest(df.collect()))
    assert n < 100 or {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_of_several_levels_of_blocks(spark, tmp_path, height):
    df = docs(spark, 900, ["en", "en", "en", "en", "de", None])
    assert Counter(run_manifest(spark, df, tmp_path, height)) == Counter(manifest(df.collect()))


def test_van_emde_boas_addresses():
    for height in range(5):
        places = np.concatenate([mm.address(height, d, np.arange(8**d)) for d in range(height + 1)])
        assert sorted(places) == list(range(mm.tree_size(height)))
    # Height 3: the upper part has depths 0 and 1, then every subtree of depth 2 and 3 lies in one stretch.
    assert mm.address(3, 0, np.array([0]))[0] == 0 and mm.address(3, 1, np.arange(8)).tolist() == list(range(1, 9))
    assert mm.address(3, 2, np.array([0, 1])).tolist() == [9, 18] and mm.address(3, 3, np.arange(8)).tolist() == list(range(10, 18))


def test_manifest_edge_cases(spark, edge, nothing, tmp_path):
    got = run_manifest(spark, edge, tmp_path)
    assert Counter(got) == Counter(manifest(edge.collect())) and len(got) == len(EDGE)
    for name, df in (("none", nothing), ("same", spark.createDataFrame(SAME_IDS, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")}))):
        (tmp_path / name).mkdir()
        assert Counter(run_manifest(spark, df, tmp_path / name)) == Counter(manifest(df.collect()) if name == "same" else [])


def clusters(rows, count=16, rounds=3):
    kept = [(k, [math.floor(64 * x) for x in v]) for k, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, _, v in sorted((h(f"1:{'' if k is None else k}"), v, v) for k, v in kept)[:count]]
    for turn in range(rounds + 1):
        found = []
        for k, v in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            best = min(range(len(centroids)), key=lambda i: (apart[i], i))
            found.append((k, best, apart[best], v))
        if turn < rounds:
            for i in range(len(centroids)):
                members = [v for _, b, _, v in found if b == i]
                if members:
                    centroids[i] = [sum(x) // len(members) for x in zip(*members)]
    spread = Counter()
    for _, b, d, _ in found:
        spread[b] += d
    return [(k, b, d, spread[b], sum(spread.values()), h(",".join(map(str, centroids[b])))) for k, b, d, _ in found]


def vectors(n, scale=1.0, copies=0):
    rnd = random.Random(n)
    centers = [[rnd.gauss(0, scale) for _ in range(64)] for _ in range(9)]
    rows = [(k, [float(np.float32(c + rnd.gauss(0, 0.1 * scale))) for c in rnd.choice(centers)]) for k in range(n)]
    return rows + rows[:1] * copies


@pytest.mark.parametrize("n,scale,copies", [(1, 1, 0), (5, 1, 0), (400, 1, 200), (300, 0.01, 0), (60, 1e5, 0), (40, 1e9, 0)])
def test_clusters_equal_plain_search(spark, n, scale, copies):
    rows = vectors(n, scale, copies)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({"key": F.lit(1), "v": F.lit("x"), "cluster": F.lit(0)})
    got = Counter(tuple(r) for r in wc.cluster(df).collect())
    fit = lambda x: x if x < 1 << 63 else None
    assert got == Counter((k, b, fit(d), fit(s), fit(t), c) for k, b, d, s, t, c in clusters(rows))


def test_vectors_that_are_not_kept(spark):
    good = vectors(30)
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [None] + [0.5] * 63), (105, [math.nan] + [0.5] * 63), (106, [math.inf] + [0.5] * 63), (107, [1e30] + [0.5] * 63)]
    df = spark.createDataFrame(good + bad + [(None, [0.25] * 64)], "vec_id long, embedding array<double>")
    got = wc.cluster(df).collect()
    assert Counter(tuple(r) for r in got) == Counter(clusters(good + [(None, [0.25] * 64)]))
    assert wc.cluster(df.where("vec_id >= 100")).count() == 0 and wc.cluster(df.limit(0)).count() == 0


def test_transform_is_the_walsh_hadamard_transform_by_sign_changes():
    m = wc.transform(np.eye(64, dtype=np.int64)).T
    assert np.array_equal(m @ m.T, 64 * np.eye(64)) and (np.diff(m, axis=1) != 0).sum(1).tolist() == list(range(64))


def test_progressive_search_is_exact_with_ties():
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (3000, 64))
    c = np.concatenate([v[:8], v[:8]])
    number, apart = wc.nearest(v, c)
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    assert np.array_equal(number, full.argmin(1)) and np.array_equal(apart, full.min(1)) and number.max() < 8
