"""Merkle manifest of a table: a digest tree for every group of rows, one tree over the groups, and a proof for every row.

Rows of a group are its leaves in the order of their key; every FAN consecutive nodes, fewer in the last run, become the
digest of their hexadecimal digests, until one is left. A tree is stored in blocks: aligned subtrees of FAN ** HEIGHT leaves,
each one binary value. Inside a block nodes lie in van Emde Boas order: the tree is cut at half of its height, the upper
part comes first and then every lower part from left to right, each laid out in the same way. A node's address follows from
its depth and index alone, serves building as well as looking up siblings, and keeps a path from leaf to root within a few
neighbouring stretches whatever the size of a cache line. Block roots are the leaves of the next level of blocks.

Positions come from a range partition and counts per partition, so a group may hold any share of the rows. A task holds one
block (4,096 leaves). Proofs go the other way: the blocks of a level hand every block below its steps up to the root.

A null group or key comes first; equal keys are ordered by digest, and rows that repeat everything are leaves of their own.
Null values count as `-`. A group of one row is its own root. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import table

FAN, HEIGHT = 8, 4
_STEPS = "array<struct<before:string,after:string>>"
_STEP_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest_of(*values: Column) -> Column:
    """SHA-256 of values, each as its number of UTF-8 bytes, a colon and itself, or `-` if it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def tree_size(height: int) -> int:
    """Nodes of a complete tree of so many levels below its root."""
    return (FAN ** (height + 1) - 1) // (FAN - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes of one depth (0: the root) lie in the van Emde Boas order of a complete tree."""
    out = np.zeros(len(index), np.int64)
    while height:
        upper = height // 2  # the upper part has depths 0 to upper, the lower parts have the rest
        lower = height - upper - 1
        if depth <= upper:
            height = upper
        else:
            below = FAN ** (depth - upper - 1)
            out += tree_size(upper) + index // below * tree_size(lower)
            index, depth, height = index % below, depth - upper - 1, lower
    return out


@lru_cache(maxsize=None)
def _addresses(height: int) -> list[np.ndarray]:
    return [address(height, d, np.arange(FAN**d)) for d in range(height + 1)]


def _width(leaves: int, height: int, depth: int) -> int:
    """How many nodes of a depth stand above so many leaves."""
    return -(-leaves // FAN ** (height - depth))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_height(total: int, most: int = HEIGHT) -> int:
    """The height of a block in a tree with so many leaves: the usual one, or less if one block holds the tree."""
    height = 0
    while height < most and FAN**height < total:
        height += 1
    return height


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """Nodes (rows of 32 bytes) in van Emde Boas order; places of nodes that are not there stay zero."""
    at = _addresses(height)
    nodes = np.zeros((tree_size(height), 32), np.uint8)
    nodes[at[height][: len(leaves)]] = leaves
    for depth in range(height - 1, -1, -1):
        below = _width(len(leaves), height, depth + 1)
        for i in range(_width(len(leaves), height, depth)):
            run = nodes[at[depth + 1][FAN * i : min(FAN * i + FAN, below)]]
            nodes[at[depth][i]] = np.frombuffer(hashlib.sha256(run.tobytes().hex().encode()).digest(), np.uint8)
    return nodes


def block_steps(nodes: np.ndarray, leaves: int, height: int):
    """For every leaf of a block its steps to the block's root: the digests before and after it in its run, as text."""
    at = _addresses(height)
    runs = []
    for depth in range(height, 0, -1):
        width = _width(leaves, height, depth)
        text = [nodes[at[depth][i : min(i + FAN, width)]].tobytes().hex() for i in range(0, width, FAN)]
        runs.append(text)
    for leaf in range(leaves):
        steps, i = [], leaf
        for text in runs:
            run, j = text[i // FAN], 64 * (i % FAN)
            steps.append((run[:j], run[j + 64 :]))
            i //= FAN
        yield steps


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a digest and its steps lead to."""
    for before, after in steps:
        digest = _hash(before + digest + after)
    return digest


def proof(steps: list[tuple[str, str]]) -> str:
    """Digest of all siblings, level by level from the leaf, left to right."""
    return _hash("".join(before + after for before, after in steps))


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place among the rows of its g in the given order, and n, their number."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange("g", *order, "tie").sortWithinPartitions("g", *order, "tie")
    placed = table(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    by_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("size").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(by_group).alias("n"))
    return placed.join(runs, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _block_level(nodes: DataFrame, item: str, most: int) -> DataFrame:
    """Blocks of nodes (g, n, pos, digest, item): g, n, block, leaves, height, nodes, digest of the root, items by position."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").combine_chunks()
        total, leaves = rows["n"][0].as_py(), rows.num_rows
        height = block_height(total, most)
        made = build_block(np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint8).reshape(leaves, 32), height)
        out = {
            "g": rows["g"][:1], "n": rows["n"][:1], "block": pa.array([rows["pos"][0].as_py() // FAN**most], pa.int64()), "leaves": pa.array([leaves], pa.int32()),
            "height": pa.array([height], pa.int32()), "nodes": pa.array([made.tobytes()], pa.binary()), "digest": pa.array([made[0].tobytes()], pa.binary()),
            "items": pa.ListArray.from_arrays(pa.array([0, leaves], pa.int32()), rows["item"].combine_chunks()),
        }
        return pa.table(out)

    schema = f"g string, n long, block long, leaves int, height int, nodes binary, digest binary, items array<{item}>"
    keyed = nodes.withColumn("block", F.expr(f"pos div {FAN**most}"))
    return table(keyed.select("g", "block", "n", "pos", "digest", "item").groupBy("g", "block").applyInArrow(lambda rows: build(rows.drop_columns(["block"])), schema))


@dataclass
class Manifest:
    """Levels of blocks, from the leaves up, and the digest of every group's root."""

    levels: list[DataFrame]
    roots: DataFrame  # g, digest
    block: int  # leaves of a full block


def build(leaves: DataFrame, order: list[str], item: str, height: int = HEIGHT) -> Manifest:
    """The trees of all groups of leaves (g string, digest binary, item, and the columns of the order)."""
    block = FAN**height
    nodes = _positions(leaves, [*order, "digest"])
    levels, roots = [], None
    while True:
        level = _block_level(nodes, item if not levels else "int", height)
        levels.append(level)
        done = level.where(F.col("n") <= block).select("g", "digest")
        roots = done if roots is None else roots.union(done)
        above = level.where(F.col("n") > block)
        if above.isEmpty():
            return Manifest(levels, roots, block)
        nodes = above.select("g", F.expr(f"(n + {block - 1}) div {block}").alias("n"), F.col("block").alias("pos"), "digest", F.lit(None).cast("int").alias("item"))


def _steps_of(row_nodes: bytes, leaves: int, height: int, above: list[dict]):
    tail = [(s["before"], s["after"]) for s in above]
    for steps in block_steps(np.frombuffer(row_nodes, np.uint8).reshape(-1, 32), leaves, height):
        yield steps, tail


def _with_steps(manifest: Manifest, above: DataFrame) -> DataFrame:
    """Blocks of the lowest level with the steps of their roots to the very root; above: g and the steps of every group's root."""
    steps, block = None, manifest.block
    for level in reversed(manifest.levels):
        top = level.where(F.col("n") <= block).join(above, "g")
        here = top if steps is None else top.unionByName(level.where(F.col("n") > block).join(steps, ["g", "block"]))
        if level is manifest.levels[0]:
            return here

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    out = [[{"before": x, "after": y} for x, y in own + tail] for own, tail in _steps_of(r["nodes"], r["leaves"], r["height"], r["steps"])]
                    first = r["block"] * block
                    yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(out)), pa.array(range(first, first + len(out)), pa.int64()), pa.array(out, _STEP_TYPE)], ["g", "block", "steps"])

        steps = here.select("g", "block", "nodes", "leaves", "height", "steps").mapInArrow(run, f"g string, block long, steps {_STEPS}")
    raise AssertionError("a manifest has a level")


def group_of(column: Column) -> Column:
    """Groups as text in which null comes before every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def prove(docs: DataFrame, group: Column, order: list[str], digest: Column, candidate: Column, key: str = "doc_id", height: int = HEIGHT) -> DataFrame:
    """For every row its key, leaf, subroot, root, proof, and the root that its candidate digest leads to with the true siblings.

    digest and candidate are hexadecimal; a null candidate stands for the leaf itself.
    """
    key_type = docs.schema[key].dataType.simpleString()
    item = f"struct<key:{key_type},candidate:string>"
    leaves = docs.select(group_of(group).alias("g"), *order, F.unhex(digest).alias("digest"), F.struct(F.col(key).alias("key"), candidate.alias("candidate")).alias("item"))
    trees = build(leaves, order, item, height)
    tops = trees.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", F.struct(F.col("g").alias("name"), F.col("digest").alias("subroot")).alias("item"))
    over = build(tops, ["name"], "struct<name:string,subroot:binary>", height)
    top = over.roots.first()  # one row, none over an empty table
    root = top["digest"].hex() if top else ""
    named = _with_steps(over, over.roots.select("g", F.array().cast(_STEPS).alias("steps")))

    def groups(batches):
        for b in batches:
            for r in b.to_pylist():
                out = [[{"before": x, "after": y} for x, y in own + tail] for own, tail in _steps_of(r["nodes"], r["leaves"], r["height"], r["steps"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i["name"] for i in r["items"]], pa.string()), pa.array([i["subroot"].hex() for i in r["items"]], pa.string()), pa.array(out, _STEP_TYPE)], ["g", "subroot", "steps"]
                )

    per_group = table(named.select("nodes", "leaves", "height", "steps", "items").mapInArrow(groups, f"g string, subroot string, steps {_STEPS}"))
    blocks = _with_steps(trees, per_group.select("g", "steps")).join(per_group.select("g", "subroot"), "g")

    def rows(batches):
        for b in batches:
            keys = b.column("items")
            for i in range(b.num_rows):
                r = b.slice(i, 1).drop_columns(["items"]).to_pylist()[0]
                items = keys[i].values
                candidates = items.field("candidate").to_pylist()
                nodes = np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32)
                leaf = nodes[_addresses(r["height"])[r["height"]][: r["leaves"]]]
                texts = [x.tobytes().hex() for x in leaf]
                upper: dict[str, str] = {}
                proofs, folded = [], []
                for text, other, (own, tail) in zip(texts, candidates, _steps_of(r["nodes"], r["leaves"], r["height"], r["steps"])):
                    proofs.append(proof(own + tail))
                    top = fold(text if other is None else other, own)
                    if top not in upper:
                        upper[top] = fold(top, tail)
                    folded.append(upper[top])
                same = [r["subroot"]] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [items.field("key"), *(pa.array(x, pa.string()) for x in (texts, same, [root] * len(texts), proofs, folded))],
                    [key, "leaf", "subroot", "root", "proof_sha256", "folded_root"],
                )

    out = blocks.select("nodes", "leaves", "height", "steps", "subroot", "items")
    schema = f"{key} {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return out.mapInArrow(rows, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
