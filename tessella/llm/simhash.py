"""SimHash fingerprints and near-duplicate groups by BK-trees over shards.

Fingerprints within RADIUS differing bits are linked.  The 64 bits are cut into BLOCKS blocks; two linked fingerprints
agree in at least BLOCKS - RADIUS whole blocks, so each distinct fingerprint goes to one shard for every choice of that
many blocks, and only fingerprints of one shard are compared.  A shard's fingerprints form BK-trees of at most TREE_NODES
nodes, whose children are keyed by their Hamming distance to the parent; a search follows only the edges within the
radius.  A shard with more fingerprints is cut into several trees, and each pair of trees is one task row, so no task
holds an unbounded shard; all pairs are still compared.  Links leave a shard as a spanning star of each group found
there, never as all pairs, and connected components are found by label steps over checkpointed tables.

Documents with equal fingerprints are one node, so large groups of exact copies cost nothing here.

Cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows come back repeated; a row
with a null id gets the component of its fingerprint (null if no row there has an id); an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import drop, id_and_text, map_batches, pinned

BITS, SEED = 64, 42
TREE_NODES = 2048


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text (A-Z lower-cased, words cut at ASCII white space)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)]
    one = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 4096):
        h = np.array([one(g, SEED) for g in grams[at : at + 4096]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        f = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": f.view(np.int64)}

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


class BKTree:
    """Integers by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self, items: list[int]):
        self.items = items
        self.children: list[dict[int, int]] = []
        for i, x in enumerate(items):
            self.children.append({})
            at = 0
            while i:
                d = (items[at] ^ x).bit_count()
                down = self.children[at].get(d)
                if down is None:
                    self.children[at][d] = i
                    break
                at = down

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Positions of the items at most radius bits from x."""
        stack = [0] if self.items else []
        while stack:
            at = stack.pop()
            d = (self.items[at] ^ x).bit_count()
            if d <= radius:
                yield at
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]

    def join(self, queries: np.ndarray, own: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node reached, the queries at most radius bits from it, in one walk for all queries.

        queries and own (the tree's items): rows of 64-bit words.
        """
        stack = [(0, np.arange(len(queries)))] if self.items and len(queries) else []
        while stack:
            at, some = stack.pop()
            d = np.bitwise_count(queries[some] ^ own[at]).sum(1, dtype=np.int64)
            yield at, some[d <= radius]
            for k, child in self.children[at].items():
                down = some[np.abs(d - k) <= radius]
                if len(down):
                    stack.append((child, down))


def _stars(nodes: list[tuple[int, int]], queries: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning stars of the groups among (fingerprint, id) nodes and queries; queries None: the nodes themselves."""
    tree = BKTree([f for f, _ in nodes])
    asked = nodes if queries is None else queries
    everyone = nodes if queries is None else [*nodes, *queries]
    shift = 0 if queries is None else len(nodes)
    parent = list(range(len(everyone)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for q, (f, _) in enumerate(asked):
        for i in tree.within(f, radius):
            a, b = root(i), root(q + shift)
            if a != b:
                parent[b] = a
    groups = defaultdict(list)
    for i, (_, who) in enumerate(everyone):
        groups[root(i)].append(who)
    return [(who, low) for g in groups.values() if len(g) > 1 for low in [min(g)] for who in set(g) if who != low]


def block_masks(radius: int) -> list[int]:
    """Masks of all choices of blocks in which two fingerprints within the radius agree at least once."""
    count = radius + 2
    edges = [round(i * BITS / count) for i in range(count + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(count)]
    return [reduce(int.__or__, c) for c in combinations(blocks, count - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Spanning links (a, b), a > b, of nodes(node, fp), fp distinct: same components as all pairs within the radius."""
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(block_masks(radius))])
    placed = nodes.select("node", "fp", F.explode(masks).alias("m")).select("node", "fp", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("part"))
    sizes = placed.groupBy("choice", "part").count().where("count > 1").withColumnRenamed("count", "n")
    shards = placed.join(sizes, ["choice", "part"])
    # Cut shards into trees; every pair of trees (i <= j) is a cell.  Nearly all shards have one tree and one cell.
    trees = F.ceil(F.col("n") / TREE_NODES).cast("int")
    mine = F.pmod(F.xxhash64("fp", "choice"), trees).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda j: F.struct(F.least("tree", j).alias("i"), F.greatest("tree", j).alias("j")))
    dealt = shards.withColumn("trees", trees).withColumn("tree", mine).select("choice", "part", "node", "fp", "tree", F.explode(cells).alias("cell"))
    rows = dealt.select("choice", "part", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "tree", "node", "fp")
    keys = ["choice", "part", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def close(i: int, j: int, cell: list[tuple[int, int, int]]) -> pa.RecordBatch | None:
            nodes = [(f, n) for t, f, n in cell if t == i]
            found = _stars(nodes, None if i == j else [(f, n) for t, f, n in cell if t == j], radius)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema) if found else None

        now, cell = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            fps = batch.column("fp").to_numpy().view(np.uint64).tolist()
            for *key, tree, fp, node in zip(*columns, batch.column("tree").to_pylist(), fps, batch.column("node").to_pylist(), strict=True):
                if key != now:
                    if len(cell) > 1 and (out := close(*now[2:], cell)):
                        yield out
                    now, cell = key, []
                cell.append((tree, fp, node))
        if len(cell) > 1 and (out := close(*now[2:], cell)):
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes on an edge (a, b): alternating large-star and small-star steps, pinned each round.

    It ends when the edges are stars, that is when no node has two edges up or both an edge up and one down; only that
    reaches the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    spark, old, new = edges.sparkSession, [], []
    edges = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), old)
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")).distinct())
        if ends.groupBy("node").agg(F.count("*").alias("n"), F.max("up").alias("up")).where("n > 1 and up = 1").isEmpty():
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        low = both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        large = both(edges).join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = pinned(tied.select("e.*").where("a <> b").distinct(), new)
        drop(spark, old)
        old, new = new, []


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links) of every row."""
    prints = pinned(fingerprints(docs, width, id_col, text_col))
    # Rows without an id stand for themselves by a negative key only if no row of the fingerprint has an id.
    nodes = pinned(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", F.coalesce("low", -F.abs(F.xxhash64("fp") % (1 << 40)) - (1 << 62)).alias("node"), "low"))
    found = components(links(nodes.select("node", "fp"), radius))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(named, "fp").select("doc_id", "fp", F.when(F.col("component") > -(1 << 61), F.col("component")).alias("component_id"))
