"""SimHash groups, repeated passages and fingerprints against brute force."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from edge_cases import EDGE

from brightledger.llm import components, fingerprints, simhash, substrings

WORD = r"[^\x20\x09-\x0D]+"


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(WORD, text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points):
    """point -> smallest point that links reach, for {point: 64-bit fingerprint}."""
    out = {}
    for p in sorted(points):
        if p not in out:
            front = [p]
            while front:
                q = front.pop()
                if q not in out:
                    out[q] = p
                    front += [r for r in points if r not in out and (points[r] ^ points[q]).bit_count() <= 4]
    return out


def test_fingerprints_of_odd_texts():
    texts = [t for _, t, _ in EDGE] + ["A b\tC  d e", "w" * 300 + " b c d e", "a b c", "q " * 700]
    assert [int(x) for x in simhash.fingerprints_of(pa.array(texts, pa.string()))] == [fingerprint(t) for t in texts]


def test_masks_cover_every_pair_within_the_radius():
    rnd = random.Random(1)
    for bits in (list(range(64)), list(range(3, 40))):
        masks = simhash.covering_masks(bits)
        for _ in range(3000):
            changed = sum(1 << b for b in rnd.sample(bits, 4))
            assert any(not changed & m for m in masks)


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_links_connect_what_brute_force_connects(spark, bucket):
    rnd = random.Random(7)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 30])):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket)
    assert all((signed[a] ^ signed[b]).bit_count() <= 64 for a, b in edges.collect())
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = groups(signed)
    by_root, by_want = defaultdict(set), defaultdict(set)
    for x in signed:
        by_root[roots.get(x, x)].add(x)
        by_want[want[x]].add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_components_of_a_chain_a_hub_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (7, 6)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(201)}) == 1 and len({found[1000 + i] for i in range(300)}) == 1
    assert found[0] != found[1000] and 5000 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edge_cases(edge, nothing):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    ids = {d: fingerprint(t) for d, t, _ in EDGE if d is not None}
    want = groups(ids)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["fp"] & (1 << 64) - 1 == ids[r["doc_id"]]
    assert simhash.near_duplicates(nothing).count() == 0


def removed(rows, window=20):
    """(id, text) in order -> kept words of each, by brute force."""
    seen, out = set(), []
    for _, text in rows:
        w, gone = re.findall(WORD, text or ""), set()
        for i in range(len(w) - window + 1):
            t = tuple(w[i : i + window])
            if t in seen:
                gone.update(range(i, i + window))
            seen.add(t)
        out.append((len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def passages(n=60, seed=11, vocabulary=400):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    shared = [[word() for _ in range(rnd.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(shared)
            lo, hi = sorted(rnd.sample(range(len(p) + 1), 2))
            parts += [p, p[lo:hi], [word() for _ in range(rnd.randint(0, 30))]][rnd.randrange(3)]
        rows.append((i, " ".join(parts)))
    return rows + [(n, " ".join(["same"] * 90)), (n + 1, None), (n + 2, rows[3][1])]


@pytest.mark.parametrize(("shard", "parts"), [(1_000, 1), (1_000, 7), (1, 3)])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, shard, parts):
    monkeypatch.setattr(substrings, "SHARD", shard)  # 1: windows compared by hash
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removal_digests(df).collect()}
    assert [got[d] for d, _ in rows] == removed(rows)


def test_suffix_automaton_matching_statistics():
    rnd = random.Random(2)
    for _ in range(50):
        known = [[rnd.randrange(3) for _ in range(rnd.randint(0, 12))] for _ in range(3)]
        s = [rnd.randrange(3) for _ in range(15)]
        a = substrings.SuffixAutomaton()
        for k in known:
            a.add(k)
        inside = lambda x: any(k[i : i + len(x)] == x for k in known for i in range(len(k) - len(x) + 1))
        want = [max(n for n in range(e + 2) if n == 0 or inside(s[e + 1 - n : e + 1])) for e in range(len(s))]
        assert a.matching_statistics(s) == want


def test_substring_edge_cases(edge, nothing, spark):
    got = substrings.removal_digests(edge).collect()
    assert len(got) == len(EDGE) and {r["n_removed"] for r in got if r["doc_id"] != 7} == {0}
    long = next(r for r in got if r["doc_id"] == 7)
    assert (long["n_words"], long["n_removed"]) == (30_000, 29_999)
    out = substrings.deduplicated(edge)
    assert out.columns == edge.columns and out.count() == len(EDGE)
    assert substrings.deduplicated(nothing).count() == 0 and substrings.removal_digests(nothing).count() == 0
    same = spark.createDataFrame([(1, "z " * 25), (1, "y " * 25), (1, "z " * 25)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.removal_digests(same).collect()) == [24, 24, 24]


def test_deduplicated_text_is_cut_at_word_bounds(spark):
    p = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, f"first {p} end"), (2, f"other\nstart {p} tail\nmore")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substrings.deduplicated(df).collect()} == {1: f"first {p} end", 2: "other\nstart tail\nmore"}


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return {d: t[: len(t) - len(t) // 3] + order[(i + 1) % len(order)][1][: len(t) // 3] for i, (d, t) in enumerate(order)}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_edits_follow_the_next_document(spark, parts):
    rows = [(d, t or "") for d, t in passages(40)]
    df = spark.createDataFrame([(d * 3 - 20, t) for d, t in rows], "doc_id long, text string").repartition(4)
    want = edited([(d * 3 - 20, t) for d, t in rows])
    got = fingerprints.compare_with_edits(df, parts).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == {d: sha256(t.encode()).hexdigest() for d, t in want.items()}
    texts = {d * 3 - 20: t for d, t in rows}
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprint_edge_cases(edge, nothing, spark):
    assert fingerprints.compare_with_edits(edge, 4).count() == len(EDGE)
    assert fingerprints.compare_with_edits(nothing, 4).count() == 0
    one = fingerprints.compare_with_edits(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string"), 4).first()  # 11 characters: the last three give way
    assert one["edited_sha256"] == sha256(b"a b c d a b").hexdigest()


def test_sketches_merge_and_estimate_containment():
    rnd = np.random.default_rng(1)
    whole = [f"w{x}" for x in rnd.integers(0, 10**6, 8000)]
    part, rest = whole[2000:4000], whole[4000:]
    a, b, c = fingerprints.sketches_of(pa.array([" ".join(x) for x in (whole, part, rest)]))
    assert fingerprints.containment(b, a) == 1.0 and abs(fingerprints.containment(a, b) - 0.25) < 0.05
    assert fingerprints.containment(fingerprints.merged(b, c), a) == 1.0
    exact = {hash(tuple(whole[i : i + 5])) for i in range(len(whole) - 4)}
    assert abs(len(a) * fingerprints.SCALE / len(exact) - 1) < 0.1
