"""Merkle fixity audit of WARC archives.

Pages become WARC records; FILE consecutive page ids share a file, in which records lie in order of their ids, each with
its offset and length. A record's digest is a leaf. FANOUT neighbouring nodes, which cover one range of offsets, are
hashed into their parent until a file has one root. Two replicas are compared by roots; only below a mismatch are the
children compared, level by level, down to the altered, missing or added records.

Digests, offsets and trees are DataFrame expressions. Payloads are read once a replica and only digests are shuffled, by
file, so all levels of a tree are built where its file already lies.

Null urls and pages count as empty, a null page_id as -1. Repeated page_ids make several records, in the order of their
digests; more records than ids make a file's last level wider, never wrong. Empty tables have no files and no findings.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import cut

FILE = 512
FANOUT = 16
LEVELS = 3  # FANOUT ** LEVELS >= FILE


def record_text(url: Column, page: Column) -> Column:
    """A WARC resource record; its id is derived from its content, so that replicas agree."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(F.concat_ws("\n", url, page), 256),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, page, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, file_id and the record of every page."""
    id_ = F.coalesce(F.col("page_id"), F.lit(-1)).cast("long")
    record = record_text(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    return pages.select(id_.alias("page_id"), F.floor(id_ / FILE).alias("file_id"), record.alias("record"))


def leaves(recs: DataFrame) -> DataFrame:
    """file_id, record_no, page_id, offset, length and sha256 of every record."""
    d = recs.select("file_id", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    w = Window.partitionBy("file_id").orderBy("page_id", "sha256")
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.select("file_id", (F.row_number().over(w) - 1).cast("long").alias("record_no"), "page_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length", "sha256")


def _parent(nodes: DataFrame, *by: Column) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "sha256")))
    return nodes.groupBy("file_id", *by).agg(F.sha2(F.array_join(F.transform(children, lambda x: x["sha256"]), ""), 256).alias("sha256"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels (file_id, node, sha256) from the leaves up; the last has one root a file, its node 0."""
    levels = [leaf.select("file_id", F.col("record_no").alias("node"), "sha256")]
    for _ in range(LEVELS):
        levels.append(cut(_parent(levels[-1], F.floor(F.col("node") / FANOUT).alias("node"))))  # short plans for the descent
    levels.append(_parent(levels[-1]).select("file_id", F.lit(0).cast("long").alias("node"), "sha256"))
    return levels


def audit(kept: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """file_id, node (the record's number) and status of the leaves that differ: altered, missing or added."""
    wrong = None
    for level in range(len(kept) - 1, -1, -1):
        a, b = kept[level], replica[level].withColumnRenamed("sha256", "other")
        if wrong is not None:
            # The root stands over the whole last level; below it a parent covers FANOUT nodes.
            key = F.lit(0).cast("long") if level == len(kept) - 2 else F.floor(F.col("node") / FANOUT)
            parents = wrong.select("file_id", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", key).join(parents, ["file_id", "parent"], "left_semi").drop("parent") for x in (a, b))
        wrong = a.join(b, ["file_id", "node"], "full").where(~F.col("sha256").eqNullSafe(F.col("other")))
    status = F.when(F.col("other").isNull(), "missing").when(F.col("sha256").isNull(), "added").otherwise("altered")
    return wrong.select("file_id", "node", status.alias("status"))


def audited(kept_pages: DataFrame, replica_pages: DataFrame) -> DataFrame:
    """Every record of the kept archive with its file's root and its status in the replica.

    The replica's records are held against the slots of the kept manifest, so that one lost record does not shift those
    after it. A page of the replica that the manifest does not know is not reported; `audit` of the two trees does so.
    """
    manifest = cut(leaves(records(kept_pages)))
    found = records(replica_pages).select("page_id", F.sha2("record", 256).alias("sha256"))
    place = Window.partitionBy("page_id").orderBy("sha256")
    found = found.withColumn("copy", F.row_number().over(place))
    known = manifest.select("file_id", "record_no", "page_id", F.row_number().over(place).alias("copy"))
    replica = cut(found.join(known, ["page_id", "copy"]).select("file_id", "record_no", "page_id", "sha256"))
    levels = tree(manifest)
    wrong = audit(levels, tree(replica)).withColumnRenamed("node", "record_no")
    roots = levels[-1].select("file_id", F.col("sha256").alias("root_sha256"))
    out = manifest.join(roots, "file_id").join(wrong, ["file_id", "record_no"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("intact")))
