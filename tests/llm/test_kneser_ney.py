"""The language model against plain counting, and its files."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from edge_cases import EDGE, SAME_IDS
from pyspark.sql import functions as F

from brightledger.llm import kneser_ney as kn, words

WORD = r"[^\x20\x09-\x0D]+"


def sequence(text):
    return ["<b>", *re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "<e>"]


class Plain:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [None, *(Counter() for _ in range(order))]
        met = Counter()
        for t in texts:
            s = sequence(t)
            met.update(s[1:])
            for i in range(1, len(s)):
                if i - order + 1 >= 0:
                    self.counts[order][tuple(s[i - order + 1 : i + 1])] += 1
                for n in range(2, order):
                    if i - n + 1 == 0:
                        self.counts[n][tuple(s[: n])] += 1
        for n in range(order - 1, 0, -1):
            before = defaultdict(set)
            for g in self.counts[n + 1]:
                before[g[1:]].add(g[0])
            self.counts[n].update({g: len(v) for g, v in before.items()})
        # Texts shorter than the order still give their longest n-grams from the mark on.
        self.met, self.total = met, sum(met.values())
        self.after = [None, *(defaultdict(Counter) for _ in range(order))]
        for n in range(2, order + 1):
            for g, c in self.counts[n].items():
                self.after[n][g[:-1]][g[-1]] = c
        self.off = [None]
        for n in range(1, order + 1):
            t = [sum(c == k for c in self.counts[n].values()) for k in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
            self.off.append([0] + [max(0, k - (k + 1) * y * t[k] / t[k - 1]) if t[0] and t[k - 1] and t[k] else k / 2 for k in (1, 2, 3)])

    def taken(self, n, counts):
        return sum(self.off[n][min(c, 3)] for c in counts)

    def p(self, context, word):
        a = sum(self.counts[1].values())
        out = 1 / (len(self.met) + 1)
        if a:
            c = self.counts[1][(word,)]
            out = max(c - self.off[1][min(c, 3)], 0) / a + self.taken(1, self.counts[1].values()) / a * out
        for n in range(2, self.order + 1):
            after = self.after[n].get(tuple(context[len(context) - n + 1 :])) if len(context) >= n - 1 else None
            if after:
                c = after.get(word, 0)
                out = (max(c - self.off[n][min(c, 3)], 0) + self.taken(n, after.values()) * out) / sum(after.values())
        return out

    def row(self, text):
        s = sequence(text)
        base = sum(math.log10((self.met[w] + 0.1) / (self.total + 0.1 * (len(self.met) + 1))) for w in s[1:])
        score = sum(math.log10(self.p(s[max(0, i - self.order + 1) : i], s[i])) for i in range(1, len(s)))
        return len(s) - 1, sum(self.met[w] > 0 for w in s[1:]), self.total, base, score


def held(doc_id):
    return doc_id is not None and crc32(str(doc_id).encode()) % 10 == 0


def by_id():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def texts():
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [" ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rnd.choice([0, 1, 2, 5, 40, 200]))) for _ in range(150)]
    rows += ["A b A b a", "a  B\ta\nb", "never seen before", None, "", " \n"] + rows[:5]
    return list(enumerate(rows))


@pytest.mark.parametrize("order,size,shard", [(2, 8 << 20, 1 << 20), (2, 2000, 300), (1, 2000, 300), (3, 2000, 300), (4, 8 << 20, 500)])
def test_scores_equal_plain_counting(spark, order, size, shard):
    rows = texts()
    plain = Plain([t for d, t in rows if not held(d)], order)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"ids": F.lit(1), "held": F.lit("x")})
    _, scored = kn.learn_and_score(df, by_id(), order=order, size=size, shard=shard)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        want = plain.row(t)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3] and r["held_out"] == held(d)
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9) and r["score"] == pytest.approx(want[4], rel=1e-9), t


def test_probabilities_of_a_context_sum_to_one():
    plain = Plain([t for _, t in texts()], 3)
    vocabulary = [*plain.met, "unknown"]
    for context in (["<b>"], ["<b>", "w0"], ["w0", "w1"], ["w3", "w3"], ["unknown"]):
        assert sum(plain.p(context, w) for w in vocabulary) == pytest.approx(1)


def test_a_stored_model_scores_other_texts(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, scored = kn.learn_and_score(df, by_id(), size=3000, shard=500)
    other = [(1, "w0 w1 w2"), (2, None), (3, "quite new words w1"), (4, rows[3][1])]
    got = {r["doc_id"]: r for r in kn.score(model, spark.createDataFrame(other, "doc_id long, text string")).collect()}
    plain = Plain([t for d, t in rows if not held(d)], 2)
    assert all(got[d]["score"] == pytest.approx(plain.row(t)[4], rel=1e-9) for d, t in other)
    assert {r["doc_id"]: r["score"] for r in scored.collect()}[3] == pytest.approx(got[4]["score"])


def test_arrays_are_sorted_and_mapped(spark, tmp_path):
    model, _ = kn.learn_and_score(spark.createDataFrame(texts(), "doc_id long, text string"), by_id(), size=3000, shard=500)
    assert all(isinstance(kn.map_array(f"{model.shard(2, s)}.{half}.npy"), np.memmap) for s in range(1 << model.bits) for half in ("high", "low"))
    keys = [kn.map_keys(model.shard(2, s)) for s in range(1 << model.bits)]
    assert all(np.all(k[1:] > k[:-1]) for k in keys) and sum(map(len, keys)) == model.totals[2]["different"]
    kn.write_array(str(tmp_path / "x" / "a.npy"), np.arange(5))
    assert kn.map_array("file:" + str(tmp_path / "x" / "a.npy")).tolist() == [0, 1, 2, 3, 4]


def test_counts_of_any_size(tmp_path):
    columns = [np.array([0, 254, 255, 256, 1 << 40, 3]), np.zeros(6, np.int64), np.array([9, 300, 0, 0, 0, 255])]
    kn.Counts.write(str(tmp_path / "c"), columns)
    got = kn.Counts(str(tmp_path / "c"))
    assert all(got[i].tolist() == c.tolist() for i, c in enumerate(columns))
    assert got.at(0, np.array([4, 0, 4, 2])).tolist() == [1 << 40, 0, 1 << 40, 255] and got.at(1, np.zeros(0, np.int64)).tolist() == []
    keys = np.array([1 << 63 | 77 << 16, 1 << 63 | 78 << 16, (1 << 64) - 1], np.uint64)
    assert kn.from_bytes(kn.to_bytes(keys, 1)).tolist() == [77 << 1, 78 << 1, (1 << 48) - 1] and len(kn.from_bytes(kn.to_bytes(keys[:0], 3))) == 0


def test_words_of_a_chunk_are_hashed_by_slices(monkeypatch):
    rows = [t for _, t in texts()] * 20
    batch = pa.record_batch({"text": pa.array(rows, pa.string())})
    w = words.find_words(batch.column("text"))
    whole = words.hash_ranges(kn._LOWER[w.buffer], w.start, w.end)
    looked_at, plain = [], words.hash_ranges
    monkeypatch.setattr(words, "hash_ranges", lambda values, *ends: looked_at.append(len(values)) or plain(values, *ends))
    monkeypatch.setattr(words, "SLICE", 4000)
    hashes, lengths = kn.word_hashes(batch)
    assert np.array_equal(hashes, whole) and np.array_equal(lengths, np.diff(w.first))
    assert sum(looked_at) == len(w.buffer) > 10 * max(looked_at)


def test_packed_columns():
    columns = [np.array([0, 5, 255]), np.array([70_000, 0, 1 << 40]), np.zeros(3, np.int64)]
    assert [c.tolist() for c in kn.unpack(kn.pack(columns), 3, 3)] == [c.tolist() for c in columns]
    assert [len(c) for c in kn.unpack(kn.pack([np.zeros(0, np.int64)] * 2), 0, 2)] == [0, 0]


def test_language_model_edge_cases(spark, edge, nothing):
    _, scored = kn.learn_and_score(edge, by_id())
    rows = scored.collect()
    assert len(rows) == len(EDGE) and all(r["score"] < 0 for r in rows if r["n_tokens"] > 1)
    plain = Plain([t for d, t, _ in EDGE if not held(d)], 2)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 4:
            t = next(t for d, t, _ in EDGE if d == r["doc_id"])
            assert r["score"] == pytest.approx(plain.row(t)[4], rel=1e-9)
    assert kn.learn_and_score(nothing, by_id())[1].count() == 0
    _, none = kn.learn_and_score(edge, F.lit(True))
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in none.collect())
    same = spark.createDataFrame(SAME_IDS, "doc_id string, text string, lang string")
    assert kn.learn_and_score(same, F.lit(False))[1].count() == len(SAME_IDS)
