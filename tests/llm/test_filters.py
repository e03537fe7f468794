"""Secrets, quality rules, the line field, fixity and disclosure against brute force or planted cases."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from edge_cases import EDGE
from pyspark.sql import functions as F

from brightledger.llm import disclosure, line_crf, quality_rules, secrets, warc_fixity

WORD = r"[^\x20\x09-\x0D]+"
ASSIGN = re.compile("(%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join("".join(f"[{c}{c.upper()}]" for c in w) if w != "api" else "[aA][pP][iI]_?[kK][eE][yY]" for w in ("password", "passwd", "secret", "token", "api")))


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def random_stretch(x, bits):
    hits = []
    for i in range(len(x) - 19):
        c = Counter(x[i : i + 20])
        if math.log2(20) - sum(n * math.log2(n) for n in c.values()) / 20 >= bits:
            hits.append(i)
    return (hits[0], hits[-1] + 20) if hits else None


def test_secrets_equal_brute_force(spark):
    rnd = random.Random(4)
    parts = ["token", "=", ":", " ", '"', "abcdef12", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef" * 2, "é🙂", "Api_Key", "password", "\n", "x", "SECRET", "kſey", "apikey"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(300)]
    got = {r["doc_id"]: [(s["s"], s["k"], s["e"]) for s in r["spans"] if s["k"] < 3] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {i: base_secrets(t) for i, t in rows}


def test_entropy_windows(spark):
    rnd = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = []
    for i in range(60):
        x = "".join(rnd.choice(letters[: rnd.choice([8, 30, 64])]) for _ in range(rnd.randint(20, 50))) + "aA1"
        rows.append((i, f"see {x} there", x))
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, x string"), ["doc_id"]).collect()
    for r, (_, _, x) in zip(sorted(found, key=lambda r: r["doc_id"]), rows):
        want = random_stretch(x, secrets.BITS["mixed"])
        if not re.search(secrets.ALLOWED, x) and not base_secrets(f"see {x} there"):
            assert [(s["s"], s["e"]) for s in r["spans"]] == ([(want[0] + 4, want[1] + 4)] if want else [])


def test_allowed_and_plain_strings_are_left_alone(spark):
    texts = ["123e4567-e89b-12d3-a456-426614174000", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY1", "donaudampfschifffahrtsgesellschaft", "zzzzzzzzzzzzzzzzzzzzzzzz1", "12345678901234567890123"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["spans"] for r in secrets.find_secrets(df, ["doc_id"]).collect()] == [[]] * len(texts)


def test_a_listed_word_beside_a_key_allows_nothing(spark):
    key = "q8Zt2LwX9vKp4RsY7mNc3BhJ6gDf1TaQ5eUo"
    rows = [(1, f"see /example/{key} there"), (2, f"sample_{key}"), (3, f"{key[:18]}EXAMPLE{key[18:]}")]
    got = {r["doc_id"]: [s["m"] for s in r["spans"]] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[1] and key[:20] in got[1][0] and got[2] and got[3] == []


def test_long_runs_equal_brute_force(spark):
    rnd = random.Random(8)
    x = "".join(rnd.choice("abcdefXYZ0123456789+/"[: rnd.choice([6, 21])]) for _ in range(4000)) + "aB7" * 20
    r = secrets.find_secrets(spark.createDataFrame([(1, f"é {x} é")], "doc_id long, text string"), ["doc_id"]).first()
    want = random_stretch(x, secrets.BITS["mixed"])
    assert [(s["s"], s["e"]) for s in r["spans"] if s["k"] == 3] == ([(want[0] + 2, want[1] + 2)] if want else [])


def test_secret_edge_cases_and_masking(edge, nothing, spark):
    assert secrets.find_secrets(edge, ["doc_id"]).count() == len(EDGE) and secrets.find_secrets(nothing, ["doc_id"]).count() == 0
    df = spark.createDataFrame([(1, "a token=abcdef123 b " + "0123456789abcdef" * 2), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.masked(secrets.find_secrets(df, ["doc_id"]), ["doc_id"]).collect()} == {1: "a [ASSIGN] b [HEX]", 2: ""}


def measured(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    c, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(lines), len(set(w))


def test_measures_equal_brute_force(spark, edge, nothing):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "c\n", "# ", "\n", "\t", "é|", "dd  "]) for _ in range(rnd.randint(0, 60)))) for i in range(120)]
    got = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert {tuple(r) for r in got} == {(i, *measured(t)) for i, t in rows}
    got = quality_rules.measures(edge.where("doc_id <> 7"), ["doc_id"]).collect()
    assert Counter(map(tuple, got)) == Counter((d, *measured(t)) for d, t, _ in EDGE if d not in (7, None))
    long = quality_rules.measures(edge.where("doc_id = 7"), ["doc_id"]).first()
    assert (long["n_words"], long["n_repeat_words"]) == (30_000, 30_000)
    assert quality_rules.measures(nothing, ["doc_id"]).count() == 0


def test_binomial_bound_is_exact(spark):
    cases = [(k, n) for n in (1, 7, 60, 400) for k in (0, 1, n // 20, n // 2, n)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("x")).collect():
        want = sum(math.comb(r["n"], j) * 0.05**j * 0.95 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert math.isclose(math.exp(r["x"]), want, rel_tol=1e-9)
    far = df.limit(1).select(quality_rules.log_binomial_cdf(F.lit(20_000).cast("long"), F.lit(500_000).cast("long"), 0.05).alias("x")).first()
    assert far["x"] < -500  # far below what a double can hold


def test_cutoffs_need_enough_labels(spark):
    words = " ".join(f"w{i}" for i in range(40))
    signs = " " + " ".join(f"##{j}#" for j in range(30))
    rows = [(i, words + f" x{i}", "many") for i in range(400)] + [(1000 + i, words + signs + f" y{i}", "many") for i in range(30)]
    rows += [(2000 + i, words + f" z{i}", "few") for i in range(20)] + [(3000 + i, words + signs + f" v{i}", "few") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_w", F.lit(1))
    labels = docs.select("doc_id", (~F.col("text").contains("#")).cast("int").alias("quality"))
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert all(judged[i] for i in range(400)) and not any(judged[1000 + i] for i in range(30))
    assert all(judged[3000 + i] for i in range(20))  # no certificate, no rejection
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, k in judged.items() if k}


def test_the_joint_verdict_is_certified(spark):
    """Each rule alone rejects few good documents, different ones; all of them together would reject too many."""
    words = [f"w{i}" for i in range(40)]
    signs, lines, long = " " + "##" * 8, "\nsame line here again" * 4, " " + "x" * 400
    rows = []
    for i in range(3000):
        text = " ".join(words) + f" q{i}"
        good = i % 3 > 0
        turn = i // 3 % 100
        if not good:
            text += (signs, lines, long)[turn % 3]
        elif turn < 9:
            text += (signs, lines, long)[turn % 3]
        rows.append((i, text, "en", int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = docs.select("doc_id", "quality")
    measured = quality_rules.measures(docs, ["doc_id", "lang"])
    found = quality_rules.certified_cutoffs(measured, labels, "lang").collect()
    judged = quality_rules.judge(docs.drop("quality"), labels).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    share = judged.agg(F.avg((~F.col("kept")).cast("double"))).first()[0]
    assert share <= quality_rules.MAX_FALSE and (not found or sum(c is not None for c in found[0]["cutoffs"]) < 3)


def test_quality_edge_cases(edge, nothing, labels, spark):
    judged = quality_rules.judge(edge, labels)
    assert judged.count() == len(EDGE)
    assert {r["doc_id"] for r in judged.where("kept").collect()} == set()  # all are short or one repeated word
    assert quality_rules.judge(nothing, labels).count() == 0 and quality_rules.judge(edge, labels.limit(0)).count() == len(EDGE)
    assert quality_rules.kept_documents(edge, labels).columns == edge.columns


def test_field_marginals_equal_enumeration():
    rnd = np.random.default_rng(2)
    lift, links = rnd.normal(size=7), rnd.normal(size=(2, 2))
    text = np.array([0, 0, 0, 0, 1, 2, 2])
    good, pairs, log_weight = line_crf._forward_backward(lift, text, links)
    total, mass, both = 0.0, np.zeros(7), np.zeros((2, 2))
    for path in range(1 << 7):
        y = [path >> i & 1 for i in range(7)]
        inner = [i for i in range(6) if text[i] == text[i + 1]]
        p = math.exp(sum(lift[i] for i in range(7) if y[i]) + sum(links[y[i], y[i + 1]] for i in inner))
        total += p
        mass += p * np.array(y)
        for i in inner:
            both[y[i], y[i + 1]] += p
    assert np.allclose(good, mass / total) and np.allclose(pairs, both / total) and math.isclose(log_weight, math.log(total))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = line_crf.learn(docs, labels)
    rows = line_crf.score_documents(docs, model).where(line_crf.held_out()).join(labels, "doc_id").select("quality", "score").collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in rows]) > 0.93
    again = line_crf.learn(docs.repartition(5), labels.repartition(3))
    assert np.allclose(model.weights, again.weights)


def test_line_field_edge_cases(edge, nothing, labels):
    model = line_crf.learn(edge, labels)
    assert model == 1.0 or 0 <= getattr(model, "slope", 0)
    for m in (model, 0.25, line_crf.Model(np.ones(line_crf.SIZE), np.zeros((2, 2)), 1.0, 0.0)):
        rows = line_crf.score_documents(edge, m).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
        assert line_crf.score_documents(nothing, m).count() == 0
    assert line_crf.learn(edge, labels.limit(0)) == 1.0


def test_audit_finds_planted_damage_and_only_that(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("<p>é</p>"), (F.col("id") % 7).cast("int")).alias("html"))
    broken = pages.where("page_id NOT IN (3, 1500)").withColumn("html", F.when(F.col("page_id").isin(0, 511, 512, 1999), "changed").otherwise(F.col("html")))
    got = {r["page_id"]: r["status"] for r in warc_fixity.audited(pages, broken).where("status <> 'intact'").collect()}
    assert got == {3: "missing", 1500: "missing"} | dict.fromkeys((0, 511, 512, 1999), "altered")
    whole = warc_fixity.leaves(warc_fixity.records(pages)).orderBy("file_id", "record_no").collect()
    assert whole[0]["offset"] == 0 and all(b["offset"] == a["offset"] + a["length"] for a, b in zip(whole, whole[1:]) if a["file_id"] == b["file_id"])
    tree, other = (warc_fixity.tree(warc_fixity.leaves(warc_fixity.records(p))) for p in (pages.where("page_id < 40"), pages.where("page_id < 42")))
    assert {(r["node"], r["status"]) for r in warc_fixity.audit(tree, other).collect()} == {(40, "added"), (41, "added")}


def test_fixity_edge_cases(spark):
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (None, None, None), (2, None, ""), (-5, "x", "y" * 100_000)], "page_id long, url string, html string").withColumn("sha256", F.lit(1))
    rows = warc_fixity.audited(pages, pages).collect()
    assert len(rows) == 5 and {r["status"] for r in rows} == {"intact"}
    assert warc_fixity.audited(pages.limit(0), pages).count() == 0


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_private(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_forms_equal_brute_force():
    rnd = random.Random(8)
    parts = ["a.b", "@", "x-1.org", ".", "+", "12", "255", "256", "0001", " ", "(", ")", "-", "4111 1111 1111 1111", "é", "%", "1.2.3.4", "+49 (30) 1234-567", "\n", "_"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert [x[:3] for x in disclosure.base_spans(t)] == base_private(t), t


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"talk about harbour {i} of item{i} more") for i in range(200)]
    rows += [(1000 + i, f"note{i} the zanzibar harbour write to ann@ex.org about {i}x") for i in range(6)]
    rows += [(2000, None), (2001, "zanzibar alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1))
    found = {r["doc_id"]: [(disclosure.KINDS[s["k"]], s["s"], s["e"]) for s in r["spans"]] for r in disclosure.find_private(df).collect()}
    text = rows[200][1]
    named = {text[s:e]: k for k, s, e in found[1000]}
    assert named["ann@ex.org"] == "email" and named["zanzibar"] in ("general", "remove") and "harbour" not in named and "about" not in named
    assert all(found[i] == [] for i in range(200)) and found[2000] == [] and found[2001] == []
    out = disclosure.sanitised(df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "zanzibar" not in texts[1000] and "[EMAIL]" in texts[1000] and texts[2001] == "zanzibar alone" and texts[2000] is None


def test_entities_of_one_text_count(spark):
    rows = [(i, f"we write to the harbour about item{i} more") for i in range(1000)]
    rows += [(2000, "we write to Quillfeather at q@ex.org about more"), (2001, "the harbour is at 10.1.2.3 more or less")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: {rows[-2 if r["doc_id"] == 2000 else -1][1][s["s"] : s["e"]]: disclosure.KINDS[s["k"]] for s in r["spans"]} for r in disclosure.find_private(df).collect() if r["doc_id"] >= 2000}
    assert found[2000]["q@ex.org"] == "email" and found[2000]["Quillfeather"] in ("general", "remove") and not {"we", "write", "to", "about", "more"} & set(found[2000])
    assert found[2001]["10.1.2.3"] == "ip" and not {"the", "harbour", "more"} & set(found[2001])


def test_flagged_terms_are_masked_beyond_reach(spark):
    far = " ".join(["we write to the harbour about more"] * 5)
    rows = [(i, f"we write to the harbour about item{i} more") for i in range(1000)]
    rows += [(2000, f"Zanzibar wrote to z@ex.org {far} zanzibar, {far}"), (2001, f"more to z@ex.org {far} (zanzibar) more"), (2002, f"{far} zanzibar")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in disclosure.sanitised(df).collect()}
    assert "zanzibar" not in texts[2000].lower() and "zanzibar" not in texts[2001] and "harbour" in texts[2001] and texts[2002] == rows[-1][1]


def test_copies_leave_the_spans_of_a_text_unchanged(spark):
    rows = [(i, f"talk about harbour {i} of item{i} more") for i in range(3000)]
    rows += [(5000 + i, f"we note{i} the zanzibar harbour write to ann@ex.org about more") for i in range(4)]
    copied = rows + [(6000 + i, rows[3000][1]) for i in range(1000)]
    once, often = ({r["doc_id"]: r["spans"] for r in disclosure.find_private(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, copied))
    assert len(once[5000]) > 1 and all(once[d] == often[d] for d in once) and often[6000] == once[5000]


def test_disclosure_edge_cases(edge, nothing):
    assert disclosure.find_private(edge).count() == len(EDGE) and disclosure.find_private(nothing).count() == 0
    out = disclosure.sanitised(edge)
    assert out.columns == edge.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((d, t) for d, t, _ in EDGE)
    assert disclosure.sanitised(nothing).count() == 0


def test_rewrite_joins_overlaps():
    spans = [{"k": 0, "s": 2, "e": 5}, {"k": 3, "s": 4, "e": 8}, {"k": 5, "s": 9, "e": 10}, {"k": 4, "s": 11, "e": 13}]
    assert disclosure.rewrite("ab12345678x9yz12!", spans) == "ab[EMAIL]7x[NUMBER]z12!"


@pytest.fixture(scope="module")
def pipeline_rows(spark):
    """Rows after each stage, by name."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {"input": None}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = df.collect()
        out[name] = rows
        docs = spark.createDataFrame(rows, df.schema)
    return out


def test_pipeline_stages_equal_brute_force(pipeline_rows):
    from test_duplicates import removed
    from test_near_copies import kept_by_brute_force

    by = {name: {r["doc_id"]: r for r in rows} for name, rows in pipeline_rows.items() if name != "packing"}
    dropped = set(by["input"]) - set(by["quality_rules"])
    failed = {d for d, r in by["input"].items() if (m := measured(r["text"]))[0] < 10 or 100 * m[4] > 20 * m[0]}
    assert failed <= dropped
    assert set(by["simhash_near_dedup"]) == kept_by_brute_force([(d, r["text"]) for d, r in by["quality_rules"].items()])
    order = sorted((d, r["text"]) for d, r in by["simhash_near_dedup"].items())
    for (d, t), (n, gone, digest) in zip(order, removed(order)):
        if n > gone:
            assert sha256(" ".join(re.findall(WORD, by["substring_dedup"][d]["text"])).encode()).hexdigest() == digest
            assert gone or by["substring_dedup"][d]["text"] == t
        else:
            assert d not in by["substring_dedup"]
    assert set(by["private_data"]) == set(by["substring_dedup"])
    for d, r in by["private_data"].items():
        assert base_private(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not base_private(by["substring_dedup"][d]["text"]):
            assert r["text"] == by["substring_dedup"][d]["text"]
    packed = Counter()
    for p in pipeline_rows["packing"]:
        packed[p["doc_id"]] += p["length"]
    assert set(packed) == set(by["private_data"])


def test_pipeline_on_edge_cases(spark, edge, nothing, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (edge, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                stage_input = docs if name == "quality_rules" else out
                docs = stage_input  # every stage meets the edge cases


def test_every_stage_keeps_different_texts_under_one_id(spark, tmp_path):
    import corpus_pipeline
    from edge_cases import SAME_IDS

    spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    long = [(d, " ".join(f"{w}{i}" for i in range(3) for w in t.split()), s) for d, t, s in SAME_IDS]
    start = spark.createDataFrame(long, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, start, str(tmp_path)).collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((d, t) for d, t, _ in long), name
        else:
            assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(d for d, _, _ in long)
