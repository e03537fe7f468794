"""The near-duplicate stage against brute-force similarity of all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_cases import EDGE

from brightledger.llm import near_copies

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def kept_by_brute_force(rows):
    """Smallest id of each group that pairs at 0.8 or more connect, all pairs tried."""
    ids, root = defaultdict(list), {}
    for d, t in rows:
        ids[shingles(t)].append(d)
    sets = list(ids)
    holders = defaultdict(list)
    for i, a in enumerate(sets):
        for x in a:
            holders[x].append(i)
    shared = [Counter(j for x in a for j in holders[x]) for a in sets]
    near = [[j for j, n in shared[i].items() if 5 * n >= 4 * (len(a) + len(sets[j]) - n)] for i, a in enumerate(sets)]
    for i in range(len(sets)):
        front = [i] if i not in root else []
        while front:
            j = front.pop()
            if j not in root:
                root[j] = i
                front += near[j]
    out = defaultdict(list)
    for i, r in root.items():
        out[r] += ids[sets[i]]
    return {min(x) for x in out.values()}


def edited_texts():
    """Texts with 1 to 5 words changed, some sharing a passage, a large group, copies and short texts."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(60):
        base = [word() for _ in range(rnd.choice([6, 20, 60, 200]))] + (passage if k % 3 == 0 else [])
        for _ in range(25 if k == 0 else 3):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                text[rnd.randrange(len(text))] = word()
            rows.append(" ".join(text) if rnd.random() < 0.8 else " \n".join(text).upper())
    rows += ["a b c", "A  b c", "a b", "", None, " \t", "q " * 300, "q " * 40, *rows[:5]]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("often", [4, 1])
def test_near_copies_equal_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    rows = edited_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = kept_by_brute_force(rows)
    assert len(want) < len(rows) - 60
    assert sorted(r["doc_id"] for r in near_copies.representatives(df).collect()) == sorted(want)


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 1 << 64, 400, np.uint64)
    sets = [np.zeros(0, np.uint64), *(rnd.choice(pool, k, replace=False) for k in rnd.integers(1, 400, 60))]
    first = np.cumsum([0, *map(len, sets)])
    odd = near_copies.parities(np.concatenate(sets), first)
    assert odd.shape == (61, near_copies.PARITY) and not odd[0].any()
    for a, x in zip(sets, odd):
        for b, y in zip(sets, odd):
            bits, differ = int(np.bitwise_count(x ^ y).sum()), len(np.setxor1d(a, b))
            assert bits <= differ and (differ - bits) % 2 == 0
    assert np.bitwise_count(odd[1] ^ odd[2]).sum() > 20


def test_unlinked_texts_of_one_bucket_are_not_paired(spark, monkeypatch):
    """Texts that share a quarter of their shingles meet in a bucket; few of their pairs may reach the sets."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    rows = [(k, " ".join(passage + [word() for _ in range(30)])) for k in range(80)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(5)]
    asked, plain = [], near_copies._confirmed
    monkeypatch.setattr(near_copies, "_confirmed", lambda pairs, *a: asked.append(pairs.count()) or plain(pairs, *a))
    # Positions alone let all of them through here, as they do where common shingles come early.
    monkeypatch.setattr(near_copies, "_may_link", lambda x, y, percent: x["g"] != y["g"])
    monkeypatch.setattr(near_copies, "prefix_length", lambda n, percent=80: n)
    got = sorted(r["doc_id"] for r in near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == list(range(80)) and asked[-1] < 100


def test_pipeline_stage_finds_pairs_that_differ_in_many_bits(spark):
    import corpus_pipeline

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = kept_by_brute_force([(r["doc_id"], r["text"]) for r in df.collect()])
    got = corpus_pipeline.near_duplicate_stage(spark, df, "/root/testdata/sf0.01")
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == want


def test_near_copy_edge_cases(edge, nothing):
    kept = near_copies.representatives(edge)
    assert kept.columns == edge.columns and near_copies.representatives(nothing).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows)) and (4, "one two") in rows and (5, "one two") not in rows and (None, "no id here") in rows
    assert {t for _, t in rows} >= {t for _, t, _ in EDGE if t and t.strip()}


def test_different_texts_under_one_id_stay(spark):
    from edge_cases import SAME_IDS

    df = spark.createDataFrame(SAME_IDS + SAME_IDS[:3], "doc_id long, text string, lang string").repartition(3)
    got = sorted((r["text"] for r in near_copies.representatives(df).collect()))
    assert got == sorted(t for _, t, _ in SAME_IDS)


def test_simhash_links_join_copies_by_themselves(spark, monkeypatch):
    """Without prefix filtering SimHash joins what lies in its radius, if the sets confirm it."""
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    long = [f"w{rnd.randrange(9000)}" for _ in range(3000)]
    edited = long[:1500] + ["other"] + long[1501:]
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, "one two three"), (4, "four five six seven eight nine"), (5, " ".join(rnd.sample(long, 50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "_may_link", lambda x, y, percent: F.lit(False))
    assert sorted(r["doc_id"] for r in near_copies.representatives(df).collect()) == [1, 3, 4, 5]
