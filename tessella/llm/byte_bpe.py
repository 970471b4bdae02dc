"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts are cut into chunks that overlap by OVERLAP code points; a text of up to CHUNK code points is one chunk and is
encoded where it is read, the chunks of a longer one are dealt out over the cluster.  Each is pre-tokenised from its own
start, so its first boundaries may be wrong, but a pre-token depends only on what follows its start: from the first
boundary that a chunk shares with its predecessor on, both agree.  There the chunks are stitched.  Where the overlap shows no common boundary
(one huge pre-token), the predecessor goes on over the following chunks until they resynchronise, so the result is always
that of the whole text.  Decoding concatenates the raw bytes of the ids.

Cases: a null or empty text has no ids; repeated rows come back repeated; a null id is kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import id_and_text, map_batches

CHUNK, OVERLAP = 32_768, 1024
#: A boundary is trusted if so many code points of the chunk follow it: the pattern looks ahead less than that.
LOOK_AHEAD = 8
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker remembers; the memory is emptied when it is full.
MOST_CACHED = 200_000
ENCODED = "doc_id long, ids binary, decoded binary"


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _memory(path: str) -> dict[str, bytes]:
    """Ids of pieces that this worker has seen."""
    return {}


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, last: bool) -> list[int]:
    """Starts of the pre-tokens from 0 on, and the end if this is the text's last chunk; only trusted ones."""
    found = [m.start() for m in _pattern().finditer(text)]
    if last:
        return [*found, len(text)]
    while len(found) > 1 and found[-1] > len(text) - LOOK_AHEAD:
        found.pop()
    # The pre-token that ends at a boundary must have ended by a character seen in the chunk, and so it did.
    return found


class Chunk:
    """A stretch of a text from code point `start`, with its trusted boundaries."""

    def __init__(self, start: int, text: str, last: bool, bounds: list[int] | None = None):
        self.start, self.text, self.last = start, text, last
        self.bounds = [start + b for b in boundaries(text, last)] if bounds is None else bounds

    def slice(self, a: int, b: int) -> str:
        return self.text[a - self.start : b - self.start]


def stitched(chunks: list[Chunk]) -> Iterator[tuple[Chunk, int, int]]:
    """(chunk, from, to): stretches between true boundaries that together are the text, each within one chunk."""
    now, at = chunks[0], 0
    k = 1
    step = 1
    while not now.last:
        nxt = chunks[k]
        common = sorted(p for p in set(now.bounds) & set(nxt.bounds) if p >= at)
        if common:
            yield now, at, common[0]
            now, at = nxt, common[0]
            k += 1
            step = 1
            continue
        # No common boundary: go on from the last trusted one over the next chunks, twice as many each time.
        upto = min(len(chunks), k + step)
        true = [b for b in now.bounds if b >= at]
        held = true[-1] if true else at
        if held > at:
            yield now, at, held
        text = now.slice(held, now.start + len(now.text))
        for c in chunks[k:upto]:
            text += c.slice(held + len(text), c.start + len(c.text))
        now, at = Chunk(held, text, chunks[upto - 1].last), held
        k = upto
        step *= 2
    yield now, at, now.start + len(now.text)


def encode_stretch(enc: tiktoken.Encoding, chunk: Chunk, a: int, b: int, cache: dict[str, bytes]) -> bytes:
    """Ids of the pre-tokens of [a, b), each encoded separately, as little-endian unsigned 32-bit integers."""
    inside = chunk.bounds if a == chunk.start and b == chunk.start + len(chunk.text) else [x for x in chunk.bounds if a <= x < b]
    text, shift = chunk.text, chunk.start
    edges = [x - shift for x in inside if x < b] + [b - shift]
    pieces = [text[p:q] for p, q in zip(edges, edges[1:])]
    found = list(map(cache.get, pieces))
    if None in found:
        if len(cache) >= MOST_CACHED:
            cache.clear()
        for i, piece in enumerate(pieces):
            if found[i] is None:
                found[i] = np.array(enc._encode_single_piece(piece.encode()), "<u4").tobytes()
                if len(piece) < 100:
                    cache[piece] = found[i]
    return b"".join(found)


def encode_chunks(enc: tiktoken.Encoding, chunks: list[Chunk], cache: dict[str, bytes]) -> tuple[bytes, bytes]:
    """The ids of a text from its chunks in order, and the bytes that they decode to."""
    ids = b"".join(encode_stretch(enc, chunk, a, b, cache) for chunk, a, b in stitched(chunks))
    return ids, enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def cut(text: str) -> list[tuple[int, str, bool]]:
    """(start, text, last) of a text's overlapping chunks."""
    return [(s, text[s : s + CHUNK + OVERLAP], s + CHUNK + OVERLAP >= len(text)) for s in range(0, max(1, len(text) - OVERLAP), CHUNK)]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (raw bytes) of every row."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)
    rows = id_and_text(docs)

    def whole(batch: pa.RecordBatch) -> dict:
        enc, cache = encoding(path), _memory(path)
        done = [encode_chunks(enc, [Chunk(*c) for c in cut(t)], cache) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": [x for x, _ in done], "decoded": [x for _, x in done]}

    def split(batch: pa.RecordBatch) -> dict:
        parts = [(d, u, *c) for d, u, t in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "uid", "text")), strict=True) for c in cut(t)]
        return {k: [p[i] for p in parts] for i, k in enumerate(("doc_id", "uid", "start", "text", "last"))}

    def pretokenise(batch: pa.RecordBatch) -> dict:
        bounds = [np.array(Chunk(s, t, x).bounds, np.int64) for s, t, x in zip(*(batch.column(k).to_pylist() for k in ("start", "text", "last")), strict=True)]
        return {k: batch.column(k) for k in ("doc_id", "uid", "start", "text", "last")} | {"bounds": bounds}

    def stitch(group: pa.Table) -> pa.Table:
        got = sorted(group.to_pylist(), key=lambda r: r["start"])
        ids, decoded = encode_chunks(encoding(path), [Chunk(r["start"], r["text"], r["last"], r["bounds"]) for r in got], _memory(path))
        return pa.table({"doc_id": pa.array([got[0]["doc_id"]], pa.int64()), "ids": pa.array([ids], pa.binary()), "decoded": pa.array([decoded], pa.binary())})

    short = map_batches(rows.where(F.char_length("text") <= CHUNK), whole, ENCODED)
    long = rows.where(F.char_length("text") > CHUNK).withColumn("uid", F.monotonically_increasing_id())
    part = "doc_id long, uid long, start long, text string, last boolean"
    dealt = map_batches(long, split, part).repartition("uid", "start")
    marked = map_batches(dealt, pretokenise, f"{part}, bounds array<long>")
    return short.unionByName(marked.groupBy("uid").applyInArrow(stitch, ENCODED))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes."""
    done = encode_documents(docs, path)
    return done.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trips(ids: bytes, path: str) -> str:
    """The hex SHA-256 of what ids decode to."""
    return hashlib.sha256(encoding(path).decode_bytes(np.frombuffer(ids, "<u4").tolist())).hexdigest()


def decode_documents(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """doc_id and text from ids; bytes that are no UTF-8 are replaced, as decoders do."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoding(path)
        return {"doc_id": batch.column("doc_id"), "text": [enc.decode_bytes(np.frombuffer(b or b"", "<u4").tolist()).decode(errors="replace") for b in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", F.col(ids_col).alias("ids")), run, "doc_id long, text string")
