"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' word sequences go into one automaton.  Streaming a document's words through it gives, at each word, the
longest sequence ending there that occurs in some item; a word sequence of WINDOW item words (or a whole shorter item)
that ends at this word is a hit, and every word it covers is contaminated.

The items are cut into shards of at most SHARD_WORDS words, one automaton each, and TOGETHER automata at most are held at
a time, so that driver, broadcasts and workers have a fixed bound.  With several shards the documents are streamed past
each with the hits found so far in two further columns, written between one set of automata and the next; spans are cut
out once, when all automata have read the whole text.  Windows never cross items, so sharding changes no result.

Cases: a null or empty text has no words and is not contaminated; an item without words has no window; repeated items
all count, each by its own id; items with a null id take no part; repeated document rows come back repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from tessella.llm._common import id_and_text, map_batches, pinned

WINDOW = 10
#: Words of one automaton at most (an item is never cut; about 0.1 GB per 100,000 words), and automata held at a time.
SHARD_WORDS, TOGETHER = 200_000, 2
#: A word, once A-Z are lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ANY_CASE = re.compile(_WORD.pattern.replace(r"\x60", r"\x40\x5B-\x60"))
#: Bytes to bytes: A-Z to a-z, everything that _WORD leaves out to a space (texts are UTF-8, so letters beyond ASCII stay).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z only, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items that each match belongs to."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        seen_at: list[set[int]] = [set()]
        shorts: list[tuple[int, list[bytes]]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                while len(seen_at) < len(self.length):
                    seen_at.append(set())
                if len(words) >= window:
                    seen_at[last].add(item)
            if 0 < len(words) < window:
                shorts.append((item, words))
        # Ends of items' prefixes, carried down the suffix links as far as strings of a window's length go.
        self.owners: dict[int, tuple[int, ...]] = {}
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            up = self.link[s]
            if seen_at[s] and self.length[up] < window:
                if self.length[s] >= window:
                    self.owners[s] = tuple(seen_at[s])
            elif up >= 0:
                seen_at[up] |= seen_at[s]
        #: For each state: the whole short items that end there, (words, item), longest first.
        ends: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for item, words in shorts:
            s = 0
            for w in words:
                s = self.next[s][w]
            ends[s].append((len(words), item))
        for s in reversed(order):
            ends[s] = sorted(ends[s], reverse=True) + ends[self.link[s]] if ends[s] else ends[self.link[s]]
        self.ends = ends
        self.least = min([window] * bool(self.owners) + [len(w) for _, w in shorts], default=0)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans [start, end), merged and in order, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.least:
            return spans, items
        nxt, link, length, owners, ends, window = self.next, self.link, self.length, self.owners, self.ends, self.window
        root = nxt[0]
        state = size = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is None:
                if w not in root:
                    state = size = 0
                    continue
                while to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                size = length[state]
            state = to
            size += 1
            cover = 0
            if size >= window:
                cover = window
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                items.update(owners[s])
                if size > window and spans and spans[-1][1] == i:  # the span before just grows
                    cover = 1
            if ends[state]:
                for n, item in ends[state]:
                    if n <= size:
                        items.add(item)
                        cover = max(cover, n)
            if cover:
                start = i + 1 - cover
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def automata(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[SuffixAutomaton]:
    """One automaton after the other, each over a bounded number of item words; items are streamed, not collected."""
    now, size = [], 0
    for r in items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(r.t)
        if now and size + len(words) > shard_words:
            yield SuffixAutomaton(now, window)
            now, size = [], 0
        now.append((r.i, words))
        size += len(words)
    yield SuffixAutomaton(now, window)


def ids_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _united(spans: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of both lists in order, touching or overlapping ones joined."""
    if not spans or not more:
        return spans or more
    out: list[tuple[int, int]] = []
    for s, e in sorted([*spans, *more]):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: What becomes of a batch, given the words of each row, their hit spans and the items hit.
Finish = Callable[[pa.RecordBatch, list[list[bytes]], list[list[tuple[int, int]]], list[set[str]]], pa.RecordBatch | dict]


def _streamed(docs: DataFrame, machines: Iterator[SuffixAutomaton], text_col: str, finish: Finish, schema: str | StructType) -> DataFrame:
    """docs past every automaton; the last one hands each batch to finish()."""
    names = [f"_{k}_" + "_".join(docs.columns) for k in ("spans", "items")]  # no column of docs has these names
    carried = StructType([*docs.schema.fields, StructField(names[0], BinaryType()), StructField(names[1], ArrayType(StringType()))])
    machine, out, held = next(machines), docs, []
    while machine is not None:
        after = next(machines, None)
        held.append(docs.sparkSession.sparkContext.broadcast(machine))

        def run(batch: pa.RecordBatch, shared=held[-1], last=after is None) -> pa.RecordBatch | dict:
            words = [words_of(t) for t in batch.column(text_col).to_pylist()]
            found = [shared.value.match(w) for w in words]
            spans, items = [a for a, _ in found], [set(map(str, b)) for _, b in found]
            if names[0] in batch.schema.names:
                before = [[(s, e) for s, e in np.frombuffer(x, np.int64).reshape(-1, 2).tolist()] for x in batch.column(names[0]).to_pylist()]
                spans = list(map(_united, before, spans))
                items = [a.union(b) for a, b in zip(items, batch.column(names[1]).to_pylist(), strict=True)]
                batch = batch.drop_columns(names)
            if last:
                return finish(batch, words, spans, items)
            return batch.append_column(names[0], pa.array([np.array(x, np.int64).tobytes() for x in spans], pa.binary())).append_column(names[1], pa.array(list(map(sorted, items)), pa.list_(pa.string())))

        out = map_batches(out, run, schema if after is None else carried)
        if after is not None and len(held) >= TOGETHER:
            out = pinned(out)
            for b in held:
                b.destroy()
            held = []
        machine = after
    return out


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges, merged) and items (ids as sorted strings) of every row."""

    def finish(batch, words, spans, found) -> dict:
        return {"doc_id": batch.column("doc_id"), "n_words": list(map(len, words)), "spans": [[{"s": a, "e": b} for a, b in x] for x in spans], "items": list(map(sorted, found))}

    return _streamed(id_and_text(docs), automata(items, window, shard_words), "text", finish, "doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    found = hits(docs, items, window, shard_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut(batch: pa.RecordBatch, text_col: str, every: list[list[tuple[int, int]]], most_share: float) -> pa.RecordBatch:
    """The batch with each row's spans cut out of its text, without rows whose spans cover more than most_share of their words."""
    kept, texts = [], []
    for t, spans in zip(batch.column(text_col).to_pylist(), every, strict=True):
        if not spans:
            kept.append(True)
            texts.append(t)
            continue
        at = [m.span() for m in _ANY_CASE.finditer(t)]
        kept.append(sum(e - s for s, e in spans) <= most_share * len(at))
        cut, last = [], 0
        for s, e in spans:
            cut.append(t[last : at[s][0]].rstrip(" "))
            last = at[e - 1][1]
        cut.append(t[last:])
        texts.append("".join(cut))
    where = batch.schema.get_field_index(text_col)
    return batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type)).filter(pa.array(kept, pa.bool_()))


def remove_spans(docs: DataFrame, items: DataFrame, most_share: float = 0.5, window: int = WINDOW, shard_words: int = SHARD_WORDS, text_col: str = "text") -> DataFrame:
    """docs with the hit spans cut out of the text; rows whose hits cover more than most_share of their words go."""

    def finish(batch, words, spans, found) -> pa.RecordBatch:
        return _cut(batch, text_col, spans, most_share)

    return _streamed(docs, automata(items, window, shard_words), text_col, finish, docs.schema)
