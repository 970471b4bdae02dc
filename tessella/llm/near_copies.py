"""Near-duplicate documents by SimHash and BK-trees: sets of five-word shingles of Jaccard similarity SIMILARITY or more.

The method is that of simhash, with wider fingerprints, shards that lose no pair, and an exact check behind them.

1. Documents with equal shingle sets are one node.  A node's fingerprint has BITS bits, one vote a shingle.
2. Shards are those of the prefix filter: with all shingles in one order, two sets of similarity 0.8 share one of the
   first n - ceil(0.8 n) + 1 of each set of n.  Any one order will do; shingles that many of all documents have come last, so
   that common passages bring few documents together.  Only nodes that meet another of like size stay.
3. A shard's fingerprints form BK-trees of at most TREE_NODES nodes; each node's edges within RADIUS of a query are
   followed, for all queries of the shard at once.  A larger shard is cut into several trees, and each pair of trees is a
   cell of its own.  Links leave a shard as spanning stars.
4. Linked nodes form candidate groups.  There pairs within RADIUS are held against each other by their whole shingle
   sets, unless they are in one group already; what passes is a link.  A group of more than CELL nodes or CELL_SHINGLES
   shingles is cut into pairs of parts, so no task holds an unbounded group.  Components are those of simhash.

RADIUS is where two sets of similarity 0.8 differ with a probability of about 1e-8 (1e-4 for sets of five shingles); at 0.5
about half of the pairs are let through.  Shingles are told apart by 64-bit hashes, as are whole sets.

Cases: a text of fewer words is one shingle; null and empty texts are alike; rows with a null id link others, but get the
smallest id of their group; repeated rows come back repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import drop, id_and_text, map_batches, pinned, slices
from tessella.llm.simhash import BKTree, components

#: Similarity as a fraction, so that comparisons are exact.
WIDTH, SIMILARITY = 5, (4, 5)
SEED = 42
BITS, RADIUS = 256, 72
#: Nodes of a tree; nodes and shingles of a part of a group; counters of shingles for the order, and how many of them make a row.
TREE_NODES, CELL, CELL_SHINGLES, COUNTERS, PAGE = 2048, 1024, 1 << 22, 1 << 20, 4096
#: Bits of the filter for texts that are needed again, at most (16 MB); beyond, it lets more texts through than needed.
MOST_FILTER_BITS = 1 << 27
#: Nodes that a task remembers, so that it sends copies once.
MOST_SEEN = 500_000
PRINTS = [f"f{k}" for k in range(BITS // 64)]
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A byte's bits as eight bytes, so that up to 255 rows are counted by adding words.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles of a text (A-Z lower-cased, words cut at ASCII white space), sorted."""
    words = (text or "").encode().lower().split()
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    each = np.array([known[w] for w in words], np.uint64)
    k = min(width, len(each))
    if not k:
        return each
    h = np.zeros(len(each) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _STEP + each[i : len(each) - k + 1 + i]
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return np.unique(h ^ (h >> np.uint64(31)))


def node_of(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles: BITS bits as words."""
    each = np.empty((len(grams), BITS // 64), np.uint64)
    for k in range(BITS // 64):
        x = grams + np.uint64((k + 1) * int(_STEP) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * _MIX
        each[:, k] = x ^ (x >> np.uint64(27))
    raw, ones = each.view(np.uint8), np.zeros(BITS, np.int64)
    for a in range(0, len(raw), 255):
        ones += _SPREAD[raw[a : a + 255]].sum(0).view(np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)


def prefix(grams: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles in order of how often, then hash, of which a similar set has one among its own first."""
    n, (a, b) = len(grams), SIMILARITY
    order = np.lexsort((grams, often[grams % np.uint64(len(often))]))
    return grams[order[: n + 1 - -(-a * n // b)]] if n else grams


def common(rows: DataFrame) -> np.ndarray:
    """In how many of all rows the shingles of a counter occur; 0 for those not far above the mean.  Only the order hangs on it.

    A task counts its rows in one array, whose pages are added up by page.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.uint32)
        for batch in (piece for whole in batches for piece in slices(whole)):
            grams = np.concatenate([shingles(t) for t in batch.column("text").to_pylist()])
            at, more = np.unique(grams % np.uint64(COUNTERS), return_counts=True)
            n[at] += more.astype(np.uint32)
        used = np.flatnonzero(n.reshape(-1, PAGE).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([n[p * PAGE : (p + 1) * PAGE].tobytes() for p in used.tolist()], pa.binary())], names=["page", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("page").to_pylist(), batch.column("counts"), strict=True):
                sums.setdefault(p, np.zeros(PAGE, np.int64))
                sums[p] += np.frombuffer(raw.as_buffer(), np.uint32)
        for p, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(p * PAGE + at), pa.array(n[at])], names=["at", "n"])

    often = np.zeros(COUNTERS, np.int64)
    counts = pinned(rows.select("text").mapInArrow(count, "page long, counts binary").repartition("page").mapInArrow(add, "at long, n long"))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / COUNTERS
    for r in counts.where(F.col("n") > 8 + 4 * mean).collect():  # a quarter of the counters at most
        often[r["at"]] = r["n"]
    return often


def alike_in_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return SIMILARITY[1] * np.minimum(a, b) >= SIMILARITY[0] * np.maximum(a, b)


def close_pairs(prints: np.ndarray, sizes: np.ndarray, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Each node of the tree over prints[first:], with the rows within RADIUS and of like size.

    first > 0: the rows before it ask, else those of the tree ask each other and a row is paired with later ones only.
    """
    tree = BKTree([int.from_bytes(p.tobytes(), "little") for p in prints[first:]])
    asked = prints[:first] if first else prints
    for node, queries in tree.join(asked, prints[first:], RADIUS):
        at = node + first
        met = queries[alike_in_size(sizes[queries], sizes[at])]
        if not first:
            met = met[met > at]
        if len(met):
            yield at, met


class Groups:
    """Rows by the group they were joined into."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.rows = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> None:
        a, b = self.label[a], self.label[b]
        if a != b:
            if len(self.rows[a]) < len(self.rows[b]):
                a, b = b, a
            self.label[self.rows[b]] = a
            self.rows[a] += self.rows[b]
            self.rows[b] = []

    def stars(self, nodes: np.ndarray) -> list[tuple[int, int]]:
        """(node, smallest node of its group)."""
        out = []
        for rows in self.rows:
            if len(rows) > 1:
                mine = set(nodes[rows].tolist())
                low = min(mine)
                out += [(n, low) for n in mine if n != low]
        return out


def linked(nodes: np.ndarray, prints: np.ndarray, sizes: np.ndarray, first: int = 0) -> list[tuple[int, int]]:
    """Spanning stars of the groups within RADIUS; first: as in close_pairs()."""
    groups = Groups(len(nodes))
    for at, met in close_pairs(prints, sizes, first):
        for q in met.tolist():
            groups.join(at, q)
    return groups.stars(nodes)


def similar(nodes: np.ndarray, sets: list[np.ndarray], first: int = 0) -> list[tuple[int, int]]:
    """Spanning stars of the groups of similar sets: pairs within RADIUS that are not joined yet are compared exactly."""
    sizes = np.array([len(g) for g in sets])
    prints = np.stack([fingerprint(g) for g in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flags = np.zeros(len(ids) + 1, np.int64)
    groups = Groups(len(nodes))
    a, b = SIMILARITY
    for at, met in close_pairs(prints, sizes, first):
        own = ids[starts[at] : starts[at + 1]]
        flags[own] = 1
        for q in met.tolist():
            if groups.label[at] != groups.label[q]:
                both = int(flags[ids[starts[q] : starts[q + 1]]].sum())
                if b * both >= a * (int(sizes[at] + sizes[q]) - both):
                    groups.join(at, q)
        flags[own] = 0
    return groups.stars(nodes)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, size, node) rows in this order, once each, those that meet another node of like size under their token."""
    names = ["token", "size", "node"]
    held, known = [np.empty(0, np.int64)] * 3, False
    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])
        token, size, node = rows = [r[new] for r in rows]
        pair = (token[1:] == token[:-1]) & alike_in_size(size[1:], size[:-1])
        keep = np.zeros(len(token), bool)
        keep[1:] |= pair
        keep[:-1] |= pair
        keep[0] |= known
        out = np.flatnonzero(keep[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(r[out]) for r in rows], names=names)
        held, known = [r[-1:] for r in rows], bool(keep[-1])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], names=names)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[dict]:
    """One dict of columns (numpy; binaries as lists) for each group of rows with equal keys, which come together."""
    take = lambda batch, c: batch.column(c).to_pylist() if pa.types.is_binary(batch.schema.field(c).type) else batch.column(c).to_numpy()
    held: dict[str, list] = {c: [] for c in columns}
    now = None

    def close() -> dict:
        out = {c: sum(v, []) if isinstance(v[0], list) else np.concatenate(v) for c, v in held.items()}
        for v in held.values():
            v.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        data = {c: take(batch, c) for c in columns}
        for a, b in zip(cut, cut[1:]):
            k = tuple(key[a].tolist())
            if k != now and held[columns[0]]:
                yield close()
            now = k
            for c in columns:
                held[c].append(data[c][a:b])
    if held[columns[0]]:
        yield close()


def _sides(group: dict, names: list[str]) -> tuple[dict, int]:
    """A cell's rows, those of part j before those of part i, and how many of part j there are (0 if both are one part)."""
    i, j = group["i"][0], group["j"][0]
    if i == j:
        return group, 0
    order = np.argsort(group["part"] == i, kind="stable")
    return {c: [group[c][k] for k in order] if isinstance(group[c], list) else group[c][order] for c in names}, int((group["part"] == j).sum())


def _emit(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Links of many cells in batches."""
    held: list[tuple[int, int]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for links in found:
        held += links
        if len(held) > 10_000:
            yield batch()
            held = []
    if held:
        yield batch()


def _cells(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows with the cells (i, j) they belong to: those of a key with more than `most` rows, or CELL_SHINGLES in all if rows have sizes, are cut into parts, and each pair of parts is a cell."""
    weight = F.sum("size") / CELL_SHINGLES if "size" in rows.columns else F.lit(0.0)
    parts = rows.groupBy(key).agg(F.count("*").alias("n"), weight.alias("w")).where("n > 1").select(key, F.ceil(F.greatest(F.col("n") / most, "w")).cast("int").alias("parts"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    dealt = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return dealt.withColumn("cell", F.explode(cells)).select(*rows.columns, "part", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"))


def _bit_map(keys: DataFrame, column: str) -> np.ndarray:
    """Bits at the hashes of a column, modulo their number, which is bounded."""
    bits = min(MOST_FILTER_BITS, 1 << max(15, (16 * keys.count()).bit_length()))
    place = F.pmod(F.col(column), F.lit(bits)) + 1  # the first bucket is number 1 and begins at 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
    out = np.zeros((bits // 32_768, 4096), np.uint8)
    for r in rows.collect():
        out[r["k"] - 1] = np.frombuffer(r["b"], np.uint8)
    return out.ravel()


def _in_bit_map(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (8 * len(known) - 1)
    return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _texts(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(node, text) of need's (node, th); rows: th, text.  Only texts in a bit map of the wanted hashes leave their task, once each."""
    shared = rows.sparkSession.sparkContext.broadcast(_bit_map(need, "th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            th = batch.column("th").to_numpy()
            at = [i for i in np.flatnonzero(_in_bit_map(shared.value, th)).tolist() if th[i] not in seen]
            if len(seen) > MOST_SEEN:
                seen.clear()
            seen.update(th[at].tolist())
            if at:
                yield batch.take(pa.array(at))

    once = rows.mapInArrow(run, "th long, text string").groupBy("th").agg(F.first("text").alias("text"))
    return once.join(need, "th").select("node", "text")


def links(rows: DataFrame, sets: DataFrame, often: np.ndarray, scratch: list[str]) -> DataFrame:
    """Links (a, b), a > b, with the same components as all similar pairs; rows: th, text; sets: node, th, size and fingerprint of every row; scratch: as for pinned()."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(often)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > MOST_SEEN:
                seen.clear()
            out = []
            for t, h in zip(batch.column("text").to_pylist(), batch.column("th").to_pylist(), strict=True):
                if h not in seen:  # a copy brings nothing new
                    seen.add(h)
                    grams = shingles(t)
                    out.append((prefix(grams, shared.value).view(np.int64), len(grams), node_of(grams)))
            if out:
                n = [len(x) for x, _, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _, _ in out])), pa.array(np.repeat([s for _, s, _ in out], n)), pa.array(np.repeat([k for _, _, k in out], n))], names=["token", "size", "node"])

    dealt = rows.mapInArrow(tokens, "token long, size long, node long").repartition("token").sortWithinPartitions("token", "size", "node")
    met = pinned(dealt.mapInArrow(_meeting, "token long, size long, node long"), scratch)
    nodes = pinned(sets.groupBy("node").agg(F.min("th").alias("th"), F.first("size").alias("size"), *[F.first(c).alias(c) for c in PRINTS]), scratch)
    shards = _cells(met.select("token", "node"), "token", TREE_NODES).join(nodes.drop("th"), "node")
    keys = ["token", "i", "j"]
    columns = ["node", "size", "part", "i", "j", *PRINTS]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[tuple[int, int]]]:
            seen: set[tuple[bytes, int]] = set()
            for group in _whole_groups(batches, keys, columns):
                if len(group["node"]) > 1:
                    group, first = _sides(group, columns)
                    order = group["node"].tobytes(), first
                    if first == len(group["node"]) or order in seen:  # copies share many shards
                        continue
                    if len(group["node"]) < 64:
                        seen.add(order)
                    if len(seen) > MOST_SEEN // 10:
                        seen.clear()
                    yield linked(group["node"], np.stack([group[c] for c in PRINTS], 1).view(np.uint64), group["size"], first)

        return _emit(found())

    close = shards.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(search, "a long, b long").distinct()
    found = pinned(components(close), scratch)
    groups = found.select("component", "node").unionByName(found.select("component", F.col("component").alias("node"))).distinct()
    cells = pinned(_cells(groups.join(nodes.select("node", "size"), "node"), "component", CELL), scratch)
    texts = _texts(rows, cells.select("node").distinct().join(nodes.select("node", "th"), "node"))
    full = cells.join(map_batches(texts, lambda batch: {"node": batch.column("node"), "grams": [shingles(t).tobytes() for t in batch.column("text").to_pylist()]}, "node long, grams binary"), "node")
    keys2 = ["component", "i", "j"]
    columns2 = ["node", "part", "i", "j", "grams"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[tuple[int, int]]]:
            for group in _whole_groups(batches, keys2, columns2):
                group, first = _sides(group, columns2)
                if len(group["node"]) > 1 and first < len(group["node"]):
                    yield similar(group["node"], [np.frombuffer(g, np.uint64) for g in group["grams"]], first)

        return _emit(found())

    return full.repartition(*keys2).sortWithinPartitions(*keys2).mapInArrow(check, "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text) and component_id of every row."""
    rows = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    often = common(rows)

    def run(batch: pa.RecordBatch) -> dict:
        grams = [shingles(t) for t in batch.column("text").to_pylist()]
        prints = np.stack([fingerprint(g) for g in grams]).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "node": [node_of(g) for g in grams], "size": [len(g) for g in grams]} | {c: prints[:, k] for k, c in enumerate(PRINTS)}

    sets = pinned(map_batches(rows, run, "doc_id long, th long, node long, size long, " + ", ".join(f"{c} long" for c in PRINTS)))
    scratch: list[str] = []
    found = components(links(rows.select("th", "text"), sets, often, scratch))
    drop(docs.sparkSession, scratch)
    nodes = pinned(sets.groupBy("node").agg(F.min("doc_id").alias("low")).join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component")))
    lows = pinned(nodes.groupBy("component").agg(F.min("low").alias("component_id")))  # written, so that the join may split a large group
    return sets.select("doc_id", "th", "node").join(nodes.join(lows, "component").select("node", "component", "component_id"), "node").select("doc_id", "th", "component", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest id reachable over similar pairs) of every row."""
    return _grouped(docs, id_col, text_col).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group: that of the smallest id (null last), then of the smallest text hash.

    Rows are told apart by id and text, so an id that different texts share costs none of them; of rows equal in both one stays.
    """
    tag = "_" + "_".join(docs.columns)  # no column of docs begins so
    d, th = f"d{tag}", f"th{tag}"
    last = F.lit((1 << 63) - 1)
    keyed = docs.withColumn(d, F.coalesce(F.col(id_col).cast("long"), last)).withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([d, th])
    found = pinned(_grouped(docs, id_col, text_col).select(F.coalesce("doc_id", last).alias(d), F.col("th").alias(th), "component").distinct())
    stays = pinned(found.groupBy("component").agg(F.min(F.struct(d, th)).alias("s")))  # written, as above
    gone = found.join(stays, "component").where(F.struct(d, th) != F.col("s")).select(d, th)
    return keyed.join(gone, [d, th], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
