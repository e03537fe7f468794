"""The thirteen operators as queries over the driver's tables; thin wrappers that derive the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, disclosure, durable, fingerprints, kneser_ney, line_crf, merkle_manifest, packing, quality_rules, secrets, simhash, substrings, walsh_clusters, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 1024."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), bpe.default_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the known forms, their digest, and all spans."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the smallest doc_id of its group of near copies."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows with an earlier occurrence cover, and the digest of the others."""
    return substrings.removal_digests(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, with cutoffs certified by language."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketch of every document, of its edited text, and their likeness."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"), parts)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), bpe.default_path())


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a random field over its lines."""
    docs = _table(spark, sf_dir, "documents")
    scored = line_crf.score_documents(docs, line_crf.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _replica(pages: DataFrame) -> DataFrame:
    """The second copy of the archive, damaged where a digest of the url says so: one page in 64 altered, one lost."""
    mark = F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 2)
    return pages.withColumn("html", F.when(mark.isin("00", "01", "02", "03"), F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))).where(~mark.isin("04", "05", "06", "07"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record with its place, digest, Merkle root and what the audit of the damaged replica found."""
    pages = _table(spark, sf_dir, "pages")
    found = warc_fixity.audited(pages, _replica(pages))
    return found.select("page_id", "file_id", "record_no", "offset", "length", "sha256", "root_sha256", "status")


_OP9_SQL = r"""
WITH recs AS (
  SELECT coalesce(page_id, -1) AS page_id, CAST(floor(coalesce(page_id, -1) / 512.0) AS BIGINT) AS file_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         substr(sha256(coalesce(url, '')), 1, 2) AS mark
  FROM pages
), text AS (
  SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || sha256(url || chr(10) || html)
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM recs
), dig AS (
  SELECT page_id, file_id, mark, html, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256 FROM text
), leaf AS (
  SELECT page_id, file_id, mark, html, length, sha256,
    row_number() OVER w - 1 AS record_no, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM dig WINDOW w AS (PARTITION BY file_id ORDER BY page_id, sha256)
), l1 AS (SELECT file_id, record_no // 16 AS node, sha256(string_agg(sha256, '' ORDER BY record_no)) AS sha256 FROM leaf GROUP BY ALL),
l2 AS (SELECT file_id, node // 16 AS up, sha256(string_agg(sha256, '' ORDER BY node)) AS sha256 FROM l1 GROUP BY ALL),
l3 AS (SELECT file_id, up // 16 AS top, sha256(string_agg(sha256, '' ORDER BY up)) AS sha256 FROM l2 GROUP BY ALL),
root AS (SELECT file_id, sha256(string_agg(sha256, '' ORDER BY top)) AS root_sha256 FROM l3 GROUP BY file_id)
SELECT page_id, file_id, record_no, "offset", length, sha256, root_sha256,
  CASE WHEN mark IN ('04', '05', '06', '07') THEN 'missing'
       WHEN mark IN ('00', '01', '02', '03') AND html NOT LIKE '~%' THEN 'altered' ELSE 'intact' END AS status
FROM leaf JOIN root USING (file_id)
"""


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the base forms, their digest, and all spans."""
    found = disclosure.find_private(_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, disclosure.KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < 4)
    return found.select("doc_id", *(count(k).alias(f"n_{disclosure.KINDS[k]}") for k in range(4)), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of nine documents in ten; sums are rounded to six decimals."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    model, scored = kneser_ney.learn_and_score(_table(spark, sf_dir, "documents"), held_out)
    durable.release(model.folder)  # only the scores are asked for here
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_manifest(spark: SparkSession, sf_dir: str, height: int = merkle_manifest.HEIGHT) -> DataFrame:
    """Leaf, subroot of its language, root and proof of every document, and whether what it is now still leads to the root."""
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda text: merkle_manifest.digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle_manifest.prove(docs, F.col("lang"), ["doc_id"], leaf(F.col("text")), F.when(tampered, leaf(lowered)), height=height)


def _crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {step}), 4294967295)"


def _op11_sql() -> str:
    """The model of order 2."""
    last = lambda v, d: f"greatest({v} - CASE WHEN {v} = 1 THEN {d}.d1 WHEN {v} = 2 THEN {d}.d2 WHEN {v} > 2 THEN {d}.d3 ELSE 0 END, 0)"
    taken = lambda t, v: (
        f"(SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN greatest(1 - 2 * y * n2 / n1, 0) ELSE 0.5 END AS d1, CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN greatest(2 - 3 * y * n3 / n2, 0) ELSE 1 END AS d2, "
        f"CASE WHEN n1 > 0 AND n3 > 0 AND n4 > 0 THEN greatest(3 - 4 * y * n4 / n3, 0) ELSE 1.5 END AS d3, n1, n2, n3p FROM (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) END AS y FROM "
        f"(SELECT {', '.join(f'count(*) FILTER (WHERE {v} = {k})::DOUBLE AS n{k}' for k in (1, 2, 3, 4))}, count(*) FILTER (WHERE {v} > 2)::DOUBLE AS n3p FROM {t})))"
    )
    return rf"""
WITH d AS (SELECT doc_id, {_crc32_sql('doc_id::VARCHAR')} % 10 = 0 AS held_out,
  list_append(list_prepend(' b', regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')), ' e') AS w FROM documents),
pair AS MATERIALIZED (SELECT doc_id, held_out, unnest(w[:-2]) AS v, unnest(w[2:]) AS w FROM d),
uni AS MATERIALIZED (SELECT w, count(*) AS c, count(DISTINCT v) AS a FROM pair WHERE NOT held_out GROUP BY w),
bi AS MATERIALIZED (SELECT v, w, count(*) AS c FROM pair WHERE NOT held_out GROUP BY v, w),
ctx AS MATERIALIZED (SELECT v, sum(c)::DOUBLE AS total, count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2, count(*) FILTER (WHERE c > 2) AS n3 FROM bi GROUP BY v),
du AS MATERIALIZED {taken('uni', 'a')}, db AS MATERIALIZED {taken('bi', 'c')},
tot AS MATERIALIZED (SELECT sum(c)::BIGINT AS n, count(*) AS known, sum(a)::DOUBLE AS a FROM uni),
token AS (
  SELECT p.doc_id, p.held_out, coalesce(uni.c, 0) AS met, tot.n, log10((coalesce(uni.c, 0) + 0.1::DOUBLE) / (tot.n + 0.1::DOUBLE * (tot.known + 1))) AS base,
    {last('coalesce(uni.a, 0)', 'du')} / tot.a + (du.d1 * du.n1 + du.d2 * du.n2 + du.d3 * du.n3p) / tot.a / (tot.known + 1) AS p1,
    {last('coalesce(bi.c, 0)', 'db')} AS top, ctx.total, db.d1 * ctx.n1 + db.d2 * ctx.n2 + db.d3 * ctx.n3 AS left_over
  FROM pair p CROSS JOIN tot CROSS JOIN du CROSS JOIN db LEFT JOIN uni ON p.w = uni.w LEFT JOIN bi ON p.v = bi.v AND p.w = bi.w LEFT JOIN ctx ON p.v = ctx.v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE met > 0) AS n_known, min(n) AS train_tokens, round(sum(base), 6) AS base_score,
  round(sum(log10(CASE WHEN total IS NULL THEN p1 ELSE top / total + left_over / total * p1 END)), 6) AS score
FROM token GROUP BY doc_id, held_out
"""


def _op12_sql(levels: int = 8, over: int = 3) -> str:
    """Levels for up to 8 ** levels rows of a language and 8 ** over languages."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {part(text)})"
    out = [
        f"doc AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf('low')} END AS other FROM "
        "(SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents))",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM doc)",
        "t0 AS (SELECT lang AS g, pos AS i, n, leaf AS d FROM placed)",
    ]

    def tree(t: str, count: int) -> None:
        for k in range(count):
            w = "OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            out.append(
                f"{t}s{k} AS (SELECT *, coalesce(string_agg(d, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
                f"coalesce(string_agg(d, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {t}{k})"
            )
            out.append(f"{t}{k + 1} AS (SELECT g, i // 8 AS i, (min(n) + 7) // 8 AS n, CASE WHEN min(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {t}{k} GROUP BY g, i // 8)")

    tree("t", levels)
    out.append(f"u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, g AS lang FROM t{levels})")
    tree("u", over)
    fold = "CASE WHEN {s}.n = 1 THEN c ELSE sha256({s}.b || c || {s}.a) END AS c, proof || {s}.b || {s}.a AS proof"
    out.append("f0 AS (SELECT doc_id, lang, leaf, pos, coalesce(other, leaf) AS c, '' AS proof FROM placed)")
    for k in range(levels):
        s = f"ts{k}"
        out.append(f"f{k + 1} AS (SELECT doc_id, lang, leaf, f.pos, {fold.format(s=s)} FROM f{k} f JOIN {s} ON f.lang IS NOT DISTINCT FROM {s}.g AND f.pos // {8**k} = {s}.i)")
    out.append(f"h0 AS (SELECT f.doc_id, f.leaf, u0.d AS subroot, u0.i AS pos, f.c, f.proof FROM f{levels} f JOIN u0 ON f.lang IS NOT DISTINCT FROM u0.lang)")
    for k in range(over):
        s = f"us{k}"
        out.append(f"h{k + 1} AS (SELECT doc_id, leaf, subroot, f.pos, {fold.format(s=s)} FROM h{k} f JOIN {s} ON f.pos // {8**k} = {s}.i)")
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, u{over}.d AS root, sha256(proof) AS proof_sha256, c AS folded_root, c = u{over}.d AS verified FROM h{over}, u{over}"
    )


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings after three rounds, found in the Walsh-Hadamard domain."""
    return walsh_clusters.cluster(_table(spark, sf_dir, "embeddings"))


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    pick = "list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))"
    out = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len({pick}) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v FROM kept QUALIFY k < {k})",
    ]
    for n in range(rounds + 1):
        apart = "list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))"
        out.append(f"near{n} AS MATERIALIZED (SELECT e.r, e.vec_id, e.v, c.k, CAST({apart} AS BIGINT) AS d FROM kept e, c{n} c QUALIFY row_number() OVER (PARTITION BY e.r ORDER BY d, c.k) = 1)")
        if n < rounds:
            out.append(f"part{n} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM near{n}) GROUP BY k, i)")
            out.append(f"mean{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM part{n} GROUP BY k)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN mean{n} m USING (k))")
    last = f"near{rounds}"
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT vec_id, CAST({last}.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.k) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} c USING (k)"
    )


_OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, w FROM d),
win AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= n THEN array_to_string(w[i:i + 19], ' ') END AS window_text FROM word),
flag AS (SELECT doc_id, i, word, CASE WHEN window_text IS NOT NULL AND row_number() OVER (PARTITION BY window_text ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS late FROM win),
cover AS (SELECT doc_id, i, word, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM flag),
kept AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS text FROM cover GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_simhash": op3_simhash,
    "op4_substrings": op4_substrings,
    "op5_quality_rules": op5_quality_rules,
    "op6_fingerprints": op6_fingerprints,
    "op7_bpe": op7_bpe,
    "op8_line_crf": op8_line_crf,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_disclosure": op10_disclosure,
    "op11_kneser_ney": op11_kneser_ney,
    "op12_manifest": op12_manifest,
    "op13_clusters": op13_clusters,
}

ORACLES: dict[str, str] = {
    "op4_substrings": _OP4_SQL,
    "op9_warc_fixity": _OP9_SQL,
    "op11_kneser_ney": _op11_sql(),
    "op12_manifest": _op12_sql(),
    "op13_clusters": _op13_sql(),
}
