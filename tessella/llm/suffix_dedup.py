"""Removal of repeated passages by suffix arrays, over shards that can hold the repeats.

Every byte covered by a LENGTH-byte string that also starts elsewhere goes.  Each window of LENGTH bytes has a key, the
least hash of its GRAM-byte strings; equal windows have equal keys, and neighbouring windows mostly share theirs, so a
text falls into short runs of windows with one key.

1. Runs are counted by key; runs whose key occurs once cannot repeat and need no text.
2. Equal runs (same key, same hash of all their bytes) that occur at least twice are repeated throughout.
3. What remains are keys with different runs.  One run of each kind sends its bytes to its key's shard.  There a suffix
   array is built in two stages: suffixes smaller than their successors are sorted directly, the rest is induced by
   scanning the buckets, and adjacent common prefixes of LENGTH bytes or more mark the repeated windows.
4. Spans are united per document and cut out.

Runs of a key with very many kinds are cut once more by a second key, so a frequent passage whose surroundings always
differ is spread over shards.  Counting is pre-aggregated and its results are written before they are joined, so that the
joins on keys have plain exchanges on both sides, which Spark can split when a key is frequent.

Cases: a null or empty text, or one under LENGTH bytes, loses nothing; of repeated rows (same id and text) each counts as
an occurrence of its own and all are cut alike; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import delete_path, map_batches, shared_dir

LENGTH, GRAM = 200, 64
#: Bytes hashed at once; a longer text is taken in pieces that overlap by LENGTH - 1 bytes.
PIECE = 1 << 20
#: Bytes of one suffix array, about; a key's runs stay together.
BUNDLE = 1 << 18
#: Kinds of runs of one key from which the second key is used.
MANY_KINDS = 2000
SEPARATOR = b"\xff"  # never a byte of UTF-8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = [_mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * k)) * np.uint64(0x9E3779B97F4A7C15)) for k in range(3)]
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2^64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + LENGTH)
        with np.errstate(over="ignore"):
            _powers[0] = have = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return have


def window_keys(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The least mixed hash of the GRAM-byte strings of every LENGTH-byte window, and all the hashes."""
    h, step, mult = _BYTES[which][data], 1, 0x9FB21C651E98DF25
    while step < GRAM:
        h = h[:-step] * np.uint64(mult) + h[step:]
        mult, step = (mult * mult * 2 + 1) % (1 << 64), 2 * step
    h = _mix(h)
    w = LENGTH - GRAM + 1
    n = len(h)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n]), h


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: text number, start, number of windows, key, hash of the run's bytes, inner.

    inner: the least hash occurs at several places in the run, so that windows inside it may be equal.
    """
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        lengths = np.array([len(x[2]) for x in held])
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        last = begin + lengths - LENGTH + 1
        keys, grams = window_keys(data)
        breaks = np.zeros(len(keys) + 1, bool)
        breaks[1:-1] = keys[1:] != keys[:-1]
        breaks[begin] = True
        breaks[last] = True
        at = np.flatnonzero(breaks)
        count = np.diff(np.append(at, len(keys)))
        owner = np.searchsorted(begin, at, side="right") - 1
        real = (at < last[owner]) & (count > 0)
        at, count, owner = at[real], count[real], owner[real]
        # The first place of the least hash moves within a run only where a window begins with it.
        moves = np.concatenate([[0], np.cumsum(grams[: len(keys)] == keys)])
        inner = moves[at + count - 1] > moves[at]
        power, inverse = _power_tables(len(data) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[1][data] * power[: len(data)])])
        print_ = _mix((total[at + count + LENGTH - 1] - total[at]) * inverse[at]) + count.astype(np.uint64)
        number = np.array([x[0] for x in held])[owner]
        start = np.array([x[1] for x in held])[owner] + at - begin[owner]
        found.append((number, start, count, keys[at].view(np.int64), print_.view(np.int64), inner))
        held.clear()

    for i, t in enumerate(texts):
        for p in range(0, len(t) - LENGTH + 1, PIECE):
            part = t[p : p + PIECE + LENGTH - 1]
            held.append((i, p, part))
            size += len(part)
            if size >= PIECE:
                flush()
                size = 0
    flush()
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(6))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def _runs(rows: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        number, start, count, key, print_, inner = runs_of([t.encode() for t in batch.column("text").to_pylist()])
        take = lambda c: batch.column(c).to_numpy()[number]
        return {"d": take("d"), "th": take("th"), "start": start, "n": count.astype(np.int32), "m": key, "sh": print_, "inner": inner.astype(bool)}

    return map_batches(rows.select("d", "th", "text"), run, "d long, th long, start long, n int, m long, sh long, inner boolean")


# --- the suffix array of a shard -------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array by two-stage sorting, in order as far as the first LENGTH bytes tell.

    Suffixes that are smaller than their successors are sorted directly; scanning the buckets (first bytes) upwards puts
    every other suffix behind its successor's place, in the order in which the successors come.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    wide = np.zeros(n + LENGTH, np.uint8)
    wide[:n] = data
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1  # the last suffix is larger than the empty one
    turn = np.flatnonzero(step)
    smaller = step[turn[np.searchsorted(turn, np.arange(n))]] > 0
    direct = np.flatnonzero(smaller)
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, LENGTH)[direct]).view(f"S{LENGTH}").ravel()
    direct = direct[np.argsort(strings, kind="stable")]
    first = data[direct]
    lows = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[int(data[-1])].append(np.array([n - 1]))  # its successor is the empty suffix, before all buckets
    out = []

    change = np.flatnonzero(data[1:] != data[:-1]) + 1
    stretch = np.zeros(n, np.int64)  # where the stretch of equal bytes around a position begins
    stretch[change] = change
    stretch = np.maximum.accumulate(stretch)

    def hand_on(placed: np.ndarray, byte: int) -> None:
        """Put the larger predecessors of placed suffixes into their buckets, but for this one."""
        before = placed[placed > 0] - 1
        before = before[~smaller[before] & (data[before] != byte)]
        to = data[before]
        for b in np.unique(to):
            induced[b].append(before[to == b])

    for byte in range(256):
        if induced[byte]:
            heads = np.concatenate(induced[byte])
            # In a stretch of one byte each suffix induces the one before it: first all heads, then all their
            # predecessors, and so on.
            count = heads - stretch[heads] + 1
            back = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            placed = (np.repeat(heads, count) - back)[np.argsort(back, kind="stable")]
            out.append(placed)
            hand_on(placed, byte)
        own = direct[lows[byte] : lows[byte + 1]]
        if len(own):
            out.append(own)
            hand_on(own, byte)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix and the one before it, LENGTH at most."""
    wide = np.zeros(len(data) + LENGTH, np.uint8)
    wide[: len(data)] = data
    view = np.lib.stride_tricks.sliding_window_view(wide, LENGTH)
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 65536):
        b = min(len(order), a + 65536)
        differ = view[order[a:b]] != view[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    return out


def repeated_windows(snippets: list[bytes]) -> list[np.ndarray]:
    """For each snippet the starts of its LENGTH-byte windows that occur at another place of any snippet."""
    data = np.frombuffer(SEPARATOR.join(snippets) + SEPARATOR, np.uint8)
    order = suffix_array(data)
    size = np.array([len(s) for s in snippets])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    owner = np.searchsorted(begin, order, side="right") - 1
    whole = order - begin[owner] + LENGTH <= size[owner]  # starts of windows that end inside their snippet
    order = order[whole]
    prefix = common_prefixes(data, order)
    again = prefix >= LENGTH
    again[:-1] |= again[1:]
    mine = np.sort(order[again])
    cut = np.searchsorted(mine, begin)
    return [mine[a:b] - s for a, b, s in zip(cut, [*cut[1:], len(mine)], begin, strict=True)]


def _search(snippets: DataFrame) -> DataFrame:
    """(d, th, start, end): repeated spans found in the shards; snippets: m, m2, once, inner, d, th, start, bytes."""
    schema = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        found = []
        for (once, _, d, th, start, _), at in zip(rows, repeated_windows([r[-1] for r in rows]), strict=True):
            if once and len(at):
                gaps = np.flatnonzero(np.diff(at) > LENGTH)
                for a, b in zip([0, *(gaps + 1)], [*gaps, len(at) - 1], strict=True):
                    found.append((d, th, start + int(at[a]), start + int(at[b]) + LENGTH))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], schema=schema) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, bundle, size, seen = None, [], [], 0, set()
        for batch in batches:
            for k, k2, *row in zip(*(batch.column(c).to_pylist() for c in ("m", "m2", "once", "inner", "d", "th", "start", "bytes")), strict=True):
                if (k, k2) != now:
                    if len(group) > 1 or group and group[0][1]:
                        bundle += group
                        size += sum(len(g[-1]) for g in group)
                    if size >= BUNDLE:
                        if out := solve(bundle):
                            yield out
                        bundle, size = [], 0
                    now, group, seen = (k, k2), [], set()
                if (at := tuple(row[2:5])) not in seen:  # repeated rows of other batches
                    seen.add(at)
                    group.append(row)
        if (bundle := bundle + (group if len(group) > 1 or group and group[0][1] else [])) and (out := solve(bundle)):
            yield out

    return snippets.repartition("m", "m2").sortWithinPartitions("m", "m2").mapInArrow(run, "d long, th long, start long, end long")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    parts, last, runs = [], 0, 0
    for a, b in sorted(spans):
        if a > last or not runs:
            parts.append(text[last:a])
            runs += 1
        last = max(last, b)
    return b"".join([*parts, text[last:]]), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left; null: all of them) of every row."""
    spark = docs.sparkSession
    folder = shared_dir(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        # Shuffle files of finished steps go when the driver's JVM collects the objects that stand for them.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = _rows(docs, id_col, text_col)
    runs = keep(_runs(rows.where(F.octet_length("text") >= LENGTH)), "runs")
    counted = runs.groupBy("m").agg(F.count("*").alias("c"), F.min("sh").alias("low"), F.max("sh").alias("high"), F.max("inner").alias("inner")).where("c > 1 or inner")
    keys = keep(counted.select("m", ((F.col("low") != F.col("high")) | F.col("inner")).alias("mixed")), "keys")
    again = keep(runs.join(keys, "m"), "again")
    for done in ("runs", "keys"):
        delete_path(spark, f"{folder}/{done}")
    kinds = again.groupBy("m", "sh").agg(F.count("*").alias("c"), F.min(F.struct("d", "th", "start")).alias("rep"), F.first("mixed").alias("mixed"))
    known = keep(kinds.where("mixed or c > 1").select("m", "sh", "rep", "mixed", (F.col("c") > 1).alias("whole")), "known")
    many = keep(known.where("mixed").groupBy("m").count().where(F.col("count") > MANY_KINDS).select("m", F.lit(True).alias("many")), "many")
    known = known.join(many, "m", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    marked = again.drop("mixed").join(known, ["m", "sh"]).select("d", "th", F.struct("start", "n", "m", "inner", "whole", "many", (F.col("mixed") & (F.struct("d", "th", "start") == F.col("rep"))).alias("send")).alias("r"))
    # Repeated rows (same id and text) have equal runs, which count above and are held once here.
    mine = marked.groupBy("d", "th").agg(F.collect_set("r").alias("runs"))
    met = rows.join(mine, ["d", "th"], "left").select("doc_id", "d", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("runs").isNotNull(), F.col("text").cast("binary")).alias("bytes"), F.when(F.col("runs").isNull(), F.col("text").cast("binary")).alias("clean"), "runs")
    clean_digest = F.sha2("clean", 256)
    met = keep(met.withColumn("clean", F.when(F.col("runs").isNull(), clean_digest)), "met")
    for done in ("again", "known", "many"):
        delete_path(spark, f"{folder}/{done}")

    def send(batch: pa.RecordBatch) -> dict:
        out: list[tuple] = []
        sent = set()
        for d, th, text, own in zip(*(batch.column(c).to_pylist() for c in ("d", "th", "bytes", "runs")), strict=True):
            if (d, th) in sent:  # repeated rows send once
                continue
            sent.add((d, th))
            for r in own:
                if not r["send"]:
                    continue
                piece = text[r["start"] : r["start"] + r["n"] + LENGTH - 1]
                if not r["many"]:
                    out.append((r["m"], 0, not r["whole"], r["inner"], d, th, r["start"], piece))
                    continue
                second, _ = window_keys(np.frombuffer(piece, np.uint8), 2)
                edges = [0, *(np.flatnonzero(second[1:] != second[:-1]) + 1).tolist(), len(second)]
                for a, b in zip(edges, edges[1:]):
                    out.append((r["m"], int(second[a].astype(np.int64)), not r["whole"], r["inner"], d, th, r["start"] + a, piece[a : b + LENGTH - 1]))
        return {k: [o[i] for o in out] for i, k in enumerate(("m", "m2", "once", "inner", "d", "th", "start", "bytes"))}

    texts = met.where("exists(runs, r -> r.send)").select("d", "th", "bytes", "runs")
    snippets = map_batches(texts, send, "m long, m2 long, once boolean, inner boolean, d long, th long, start long, bytes binary")
    found = keep(_search(snippets).groupBy("d", "th").agg(F.collect_set(F.struct("start", "end")).alias("found")), "found")

    def finish(batch: pa.RecordBatch) -> dict:
        kept, removed, count = [], [], []
        for text, own, more in zip(*(batch.column(c).to_pylist() for c in ("bytes", "runs", "found")), strict=True):
            spans = [(r["start"], r["start"] + r["n"] + LENGTH - 1) for r in own if r["whole"]] + [(s["start"], s["end"]) for s in more or ()]
            left, n = _cut(text, spans)
            kept.append(left)
            removed.append(len(text) - len(left))
            count.append(n)
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_removed": removed, "n_spans": count, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept": kept}

    touched = met.where("runs is not null").drop("clean").join(found, ["d", "th"], "left")
    done = map_batches(touched.select("doc_id", "n_bytes", "bytes", "runs", "found"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = met.where("runs is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("clean").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return done.unionByName(whole)
