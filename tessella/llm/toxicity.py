"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the token classes of a clause: insult, threat and target (each on for SCOPE tokens behind its
trigger), negation (likewise) and reported speech (on to the end of the clause).  Their product is one deterministic
machine, built once.  Its moves emit the patterns that end at a token: an insult in its context, an insult aimed at a
target before or behind it, and a threat with its target behind it, the last two unless negated or reported.  A document's
score is a logistic function of how many clauses matched each pattern, never of isolated words alone.

The insult lexicon (whole words and word beginnings) and the pattern weights are learned from labelled rows: a bounded
sample of at most TRAIN_POSITIVE toxic and TRAIN_NEGATIVE other rows, chosen by a hash of the id.  In inflected languages
one form of a stem may be innocent chance while several are not, so a word beginning is learned together with the number
of different words (up to most_forms) that must begin so in a document before it counts.  Tasks read the texts; the driver
gets counts, for each toxic row of the sample the telling features that it has, and five numbers a row.

Settings holds what fitting leaves open.  Its values are those that cross_validated() prefers (log loss, four folds) among
lengths from 3 to 8, 1 to 4 forms and odds of 3 to 25, on the training rows of sf0.1; rows that are held out took no part
in that.

Cases: a null or empty text has no clause and gets the score of the intercept; repeated rows are scored alike; a null id
counts as not held out; of several labels of an id the higher counts, and of several texts of a labelled id the smallest
is learned from; with no labelled rows at all, only the built-in threat pattern can raise a score.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import id_and_text, map_batches, pinned

TRAIN_POSITIVE, TRAIN_NEGATIVE = 3000, 5000
THRESHOLD = 0.3
#: Tokens over which a context word, an insult or a word of harm still acts.
SCOPE = 4


@dataclass(frozen=True)
class Settings:
    """What fitting leaves open."""

    #: Lengths of the word beginnings that the lexicon may have.
    lengths: tuple[int, ...] = (4, 5, 6, 7, 8)
    #: Most different words with one beginning that an entry of the lexicon can ask for.
    most_forms: int = 2
    #: How many times as frequent among toxic rows a telling feature is, at equal numbers of rows.
    odds: float = 12.0
    #: Whether telling features that the covering did not need complete the lexicon.
    complete: bool = True


SETTINGS = Settings()

# Fixed word lists: context words of English, German, French and Spanish.
NEGATION = {"not", "never", "no", "isn't", "aren't", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ningún"}
REPORT = {"said", "says", "called", "wrote", "quoted", "claimed", "reported", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó"}
TARGET = {"you", "your", "you're", "they", "he", "she", "him", "her", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "ils", "tú", "usted", "ustedes", "ellos"}
THREAT = {"kill", "hurt", "destroy", "beat", "shoot", "stab", "töten", "umbringen", "schlagen", "tuer", "frapper", "matar", "golpear"}

OTHER, INSULT, HARM, AIMED, NEGATE, QUOTE = range(6)
PATTERNS = ("insult", "aimed_insult", "negated_insult", "quoted_insult", "threat")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
#: Stripped from a word when the lexicon is learned.
_EDGES = ".,;:!?()[]{}\"'|*#$%&<>-_=+/\\`~…«»“”„"


def _countdown(trigger: int) -> dict[tuple[int, int], int]:
    """A transducer that is on for SCOPE tokens after the trigger class: (state, class) -> state."""
    return {(s, c): SCOPE if c == trigger else max(0, s - 1) for s in range(SCOPE + 1) for c in range(6)}


def _latch(trigger: int) -> dict[tuple[int, int], int]:
    """A transducer that stays on to the end of the clause once the trigger class was read."""
    return {(s, c): int(s or c == trigger) for s in range(2) for c in range(6)}


def compose() -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """The product of the five transducers: next state and emitted patterns by [state][class]."""
    parts = (_countdown(NEGATE), _latch(QUOTE), _countdown(AIMED), _countdown(INSULT), _countdown(HARM))
    states = list(product(range(SCOPE + 1), range(2), *[range(SCOPE + 1)] * 3))
    number = {s: i for i, s in enumerate(states)}
    moves, emits = [], []
    for s in states:
        negated, quoted, aimed, insulted, harm = s
        moves.append([number[tuple(t[(x, c)] for t, x in zip(parts, s, strict=True))] for c in range(6)])
        out: list[tuple[int, ...]] = [()] * 6
        out[INSULT] = (2 if negated else 3 if quoted else 1 if aimed else 0,)
        if not negated and not quoted:
            out[AIMED] = (1,) * bool(insulted) + (4,) * bool(harm)
        emits.append(out)
    return moves, emits


_MOVES, _EMITS = compose()


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    #: Word beginning -> strength from each number of forms on.
    prefixes: dict[str, dict[int, float]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))
    bias: float = -3.0

    def __post_init__(self) -> None:
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.needles = [*self.words, *self.prefixes, *THREAT]

    def strengths(self, words: set[str]) -> dict[str, float]:
        """Strength of each insult among the different words of a document."""
        forms = Counter(w[:n] for w in words for n in self.lengths if len(w) >= n and w[:n] in self.prefixes)
        active = {p: max((s for least, s in self.prefixes[p].items() if n >= least), default=0.0) for p, n in forms.items()}
        found = {w: self.words[w] if w in self.words else max((active.get(w[:n], 0.0) for n in self.lengths), default=0.0) for w in words}
        return {w: s for w, s in found.items() if s}

    def clause_counts(self, text: str) -> list[float]:
        """Summed strengths of the clauses that match each pattern; a clause counts once per pattern, by its strongest match."""
        low = text.lower()
        if not any(x in low for x in self.needles):
            return [0.0] * len(PATTERNS)
        clauses = [_WORD.findall(clause) for clause in _CLAUSE.split(low)]
        strength = self.strengths({w for clause in clauses for w in clause})
        total = [0.0] * len(PATTERNS)
        for clause in clauses:
            if not any(w in strength or w in THREAT for w in clause):
                continue
            state, last, best = 0, 0.0, [0.0] * len(PATTERNS)
            for word in clause:
                s = strength.get(word, 0.0)
                last = s or last
                c = INSULT if s else HARM if word in THREAT else AIMED if word in TARGET else NEGATE if word in NEGATION else QUOTE if word in REPORT else OTHER
                for k in _EMITS[state][c]:
                    best[k] = max(best[k], 1.0 if k == 4 else last)
                state = _MOVES[state][c]
            total = [a + b for a, b in zip(total, best, strict=True)]
        return total

    def score(self, text: str) -> float:
        z = self.bias + sum(w * math.log1p(x) for w, x in zip(self.weights, self.clause_counts(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _features(text: str, settings: Settings = SETTINGS) -> set[str]:
    """The words of a text, and its word beginnings with one star for each form up to most_forms."""
    words = {w for w in (w.strip(_EDGES) for w in text.lower().split()) if w.isalpha()}
    forms = Counter(w[:n] for w in words for n in settings.lengths if len(w) >= n)
    return words | {p + "*" * k for p, n in forms.items() for k in range(1, min(n, settings.most_forms) + 1)}


def floor_of(toxic: int) -> int:
    """Toxic rows that a feature must mark."""
    return max(3, toxic // 400)


def is_strong(hits, against, toxic: int, clean: int, settings: Settings = SETTINGS):
    """Whether a feature of so many toxic and other rows is telling; for numbers and for columns."""
    ratio = max(1, clean) / max(1, toxic)
    return (hits >= floor_of(toxic)) & (hits * ratio**0.5 >= settings.odds * (against + 0.2))


def learn_lexicon(rows: list[set[str]], counts: dict[str, tuple[int, int]], clean: int, settings: Settings = SETTINGS) -> tuple[dict[str, float], dict[str, dict[int, float]]]:
    """Sequential covering of the toxic rows: the feature that marks most of those not marked yet, less the other rows
    that it marks, comes next.

    rows: the strong features of each toxic row; counts: the toxic and other rows that have each of them.
    """
    strong: dict[str, set[int]] = defaultdict(set)
    for i, features in enumerate(rows):
        for x in features:
            strong[x].add(i)
    ratio, floor = max(1, clean) / max(1, len(rows)), floor_of(len(rows))
    against = {x: n for x, (_, n) in counts.items()}
    words_by_start: dict[str, list[str]] = defaultdict(list)
    for w in strong:
        if w[-1] != "*":
            for n in settings.lengths:
                words_by_start[w[:n]].append(w)

    def as_word(x: str) -> str:
        """The one word that nearly all rows with a word beginning have, if there is one."""
        same = [w for w in words_by_start.get(x.rstrip("*"), ()) if x[-1] == "*" and len(strong[w]) >= 0.9 * len(strong[x])]
        return max(same, key=lambda w: (len(strong[w]), w), default=x)

    def weight(x: str) -> float:
        return math.log((len(strong[x]) + 0.5) * ratio / (against[x] + 0.5)) / 4

    left, chosen = set(range(len(rows))), {}
    queue = [(against[x] - len(s), against[x], -len(x), x) for x, s in strong.items()]
    heapq.heapify(queue)
    while queue:  # gains only shrink, so a stale head is put back with its present gain
        old, hits, size, x = heapq.heappop(queue)
        gain = strong[x] & left
        if hits - len(gain) > old:
            if len(gain) - hits >= floor:
                heapq.heappush(queue, (hits - len(gain), hits, size, x))
            continue
        if len(gain) - hits < floor:
            break
        left -= gain
        x = as_word(x)
        chosen[x] = weight(x)
    if settings.complete:
        # Features as telling as the chosen ones that mostly occur beside them complete the lexicon.
        least = max(2 * floor, max((len(strong[x]) for x in chosen), default=0) // 8)
        starts = {x.rstrip("*") for x in chosen if x[-1] == "*"}
        begun = {x.rstrip("*")[:n] for x in chosen for n in range(1, len(x) + 1)}
        for x in sorted(strong, key=lambda x: (len(x), x)):
            start = x.rstrip("*")
            known = any(start[:n] in starts for n in range(1, len(start) + 1)) or x[-1] == "*" and start in begun
            if not known and not against[x] and len(strong[x]) >= least and as_word(x) == x and x not in chosen:
                chosen[x] = weight(x)
                begun |= {start[:n] for n in range(1, len(start) + 1)}
                if x[-1] == "*":
                    starts.add(start)
    prefixes: dict[str, dict[int, float]] = defaultdict(dict)
    for x, w in chosen.items():
        if x[-1] == "*":
            prefixes[x.rstrip("*")][x.count("*")] = w
    return {x: w for x, w in chosen.items() if x[-1] != "*"}, dict(prefixes)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression; the last column of x is the constant."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def weighted(lexicon: ToxicityModel, labels: list[int], counts: list[list[float]]) -> ToxicityModel:
    """The lexicon with pattern weights learned from labelled rows' clause counts."""
    x = np.log1p(np.column_stack([np.array(counts, float).reshape(len(labels), len(PATTERNS)), np.full(len(labels), math.e - 1)]))
    w = _logistic(x, np.array(labels, float))
    # A pattern that training rows hardly show keeps a share of the plain insult's weight.
    seen, plain = (x[:, :-1] > 0).sum(0), max(w[0], 0.5)
    prior = [plain, 1.2 * plain, 0.2 * plain, 0.4 * plain, 1.5 * plain]
    weights = [float(w[k]) if seen[k] >= 20 else prior[k] for k in range(len(PATTERNS))]
    return ToxicityModel(lexicon.words, lexicon.prefixes, weights, float(w[-1]))


UNTAUGHT = ToxicityModel(weights=[0.0, 0.0, 0.0, 0.0, 2.5])


def fit(samples: list[tuple[int, str]], settings: Settings = SETTINGS) -> ToxicityModel:
    """Learn lexicon and weights from (label, text) rows in memory; fit_from_tables() does the same over tables."""
    if not samples:
        return UNTAUGHT
    features = [(y, _features(t, settings)) for y, t in samples]
    hits, against = Counter(), Counter()
    for y, f in features:
        (hits if y else against).update(f)
    toxic = sum(y for y, _ in samples)
    counts = {x: (n, against[x]) for x, n in hits.items() if is_strong(n, against[x], toxic, len(samples) - toxic, settings)}
    lexicon = ToxicityModel(*learn_lexicon([f & counts.keys() for y, f in features if y], counts, len(samples) - toxic, settings))
    return weighted(lexicon, [y for y, _ in samples], [lexicon.clause_counts(t) for _, t in samples])


def cross_validated(samples: list[tuple[int, str]], settings: Settings, folds: int = 4) -> tuple[int, int, float]:
    """Toxic rows missed, other rows marked, and log loss a row, each row scored by a model fitted without its fold."""
    missed, marked, loss = 0, 0, 0.0
    fold = [zlib.crc32(t.encode()) % folds for _, t in samples]  # copies of a text share a fold
    for k in range(folds):
        model = fit([s for s, f in zip(samples, fold, strict=True) if f != k], settings)
        for (y, t), f in zip(samples, fold, strict=True):
            if f == k:
                p = model.score(t)
                missed += y and p < THRESHOLD
                marked += not y and p >= THRESHOLD
                loss -= math.log(max(1e-6, p if y else 1 - p)) / len(samples)
    return missed, marked, loss


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y and text: a bounded, hash-ordered sample of labelled rows that are not held out, one row for each id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = F.xxhash64("doc_id")
    picked = known.where("y = 1").orderBy(order, "doc_id").limit(TRAIN_POSITIVE).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(TRAIN_NEGATIVE))
    return id_and_text(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit_from_tables(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> ToxicityModel:
    """Fit on training_rows(); texts stay in the tasks."""
    rows = pinned(training_rows(docs, labels))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic + clean:
        return UNTAUGHT

    def count(batch: pa.RecordBatch) -> dict:
        found = Counter(), Counter()
        for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found[y].update(_features(t, settings))
        keys = list(found[0] | found[1])
        return {"x": keys, "toxic": [found[1][k] for k in keys], "clean": [found[0][k] for k in keys]}

    sums = map_batches(rows, count, "x string, toxic long, clean long").groupBy("x").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = {r["x"]: (r["t"], r["c"]) for r in sums.where(is_strong(F.col("t"), F.col("c"), toxic, clean, settings)).collect()}
    known = set(counts)

    def telling(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "x": [sorted(_features(t, settings) & known) for t in batch.column("text").to_pylist()]}

    marked = sorted((r["doc_id"], r["x"]) for r in map_batches(rows.where("y = 1"), telling, "doc_id long, x array<string>").collect())
    lexicon = ToxicityModel(*learn_lexicon([set(x) for _, x in marked], counts, clean, settings))

    def clauses(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "n": [lexicon.clause_counts(t) for t in batch.column("text").to_pylist()]}

    scored = sorted((r["doc_id"], r["y"], r["n"]) for r in map_batches(rows, clauses, "doc_id long, y int, n array<double>").collect())
    return weighted(lexicon, [y for _, y, _ in scored], [x for _, _, x in scored])


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": [model.score(t) for t in batch.column("text").to_pylist()]}

    return map_batches(id_and_text(docs), run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score threshold or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def crc_remainder(doc_id: int) -> int:
    """What held_out() computes, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
