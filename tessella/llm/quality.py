"""Quality rules whose cutoffs are risk-controlled.

Each rule rejects a document whose feature exceeds a cutoff.  The cutoffs of all rules are tried jointly, as one nested
ladder: each rung lowers some of them, so what a rung rejects, all later ones reject.  The ladder is laid on the rows that
are not labelled good: next comes the rule and cutoff with the largest share of rows labelled poor among what it adds;
after these all rules come down together.  Each stratum (language) walks the ladder on its labelled good rows, from the
mildest rung on, as long as the exact (Clopper-Pearson) upper bound of the share of good rows rejected stays within RISK.
Trying in an order fixed without these rows needs no correction; across strata the error LEVEL is divided (Bonferroni).
So with probability 1 - LEVEL no stratum loses more than RISK of its good documents to these rules.  A stratum gets no
rule if even no rejected row does not show that: below ln(LEVEL / strata) / ln(1 - RISK) good rows, 217 with four strata.

All labelled rows are used; only counts by rule and cutoff and the number of strata reach the driver.  Strata are walked in
tasks, and their last rungs are joined to the rows.

Cases: a null or empty text has no words and fails the base rule; a null stratum counts as one of its own; repeated rows
come back repeated, and labels that occur more than once for an id count once (the lowest); without labels there are no
cutoffs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import map_batches, pinned

RISK, LEVEL = 0.02, 0.05
#: Cutoffs of a rule: STEPS equal steps of the feature's range 0..1.
STEPS = 200
RULES = ("symbol_share", "dup_line_share", "repeat_share", "caps_share", "long_word_share")
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
#: Bytes of a word from which it counts as long.
LONG_WORD = 24


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_caps, n_long."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        sum(len(w) >= LONG_WORD for w in words),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum ("=" and its name, or null) and the measures of every row."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        got = [measures(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "stratum": batch.column("stratum")} | {k: [g[i] for g in got] for i, k in enumerate(MEASURES)}

    return map_batches(rows, run, "doc_id long, stratum string, " + ", ".join(f"{k} long" for k in MEASURES))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _shares() -> dict[str, F.Column]:
    share = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.lit(1), F.col(b)))
    return dict(zip(RULES, (share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_caps", "n_words"), share("n_long", "n_words")), strict=True))


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial, for k below its mean: terms shrink from k down; those left out are below e^-40 of all."""
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    i = np.arange(k, max(0, k - 400 - 40 * math.isqrt(k)), -1, dtype=float)
    steps = np.log(i) - np.log(n - i + 1) + math.log1p(-p) - math.log(p)
    return top + math.log1p(float(np.exp(np.cumsum(steps)).sum()))


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact one-sided upper bound of a binomial share with k of n seen."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and _log_tail(k, n, mid) > math.log(level):
            low = mid
        else:
            high = mid
    return high


def cutoffs(counts: dict[tuple[str, str], list[int]], risk: float = RISK, level: float = LEVEL) -> dict[tuple[str, str], float]:
    """counts: good rows by step of the feature, for each (stratum, rule) -> the strictest cutoff that is safe.

    Each rule is tried alone, within its part of the risk; verdicts() walks ladder() instead, which needs fewer rows.
    """
    each, part = level / max(1, len(counts)), risk / len(RULES)
    found = {}
    for key, steps in counts.items():
        n, over = sum(steps), 0
        for s in range(STEPS, 0, -1):  # a document is rejected if its step is s or more
            over += steps[s] if s < len(steps) else 0
            if upper_bound(over, n, each) > part:
                break
            found[key] = s
    return found


def ladder(poor: dict[str, list[int]], others: dict[str, list[int]]) -> dict[str, list[int]]:
    """From rows labelled poor and unlabelled ones by step, for each rule: for each step the first rung that rejects it.

    Rungs count from 1; step 0 is never rejected and has a rung beyond all.
    """
    now = dict.fromkeys(RULES, STEPS + 1)
    first: dict[str, list[int]] = {r: [0] * (STEPS + 1) for r in RULES}
    rung = 0
    while True:
        best = (0.0, 0, "", 0)
        for rule in RULES:
            gain = cost = 0
            for s in range(now[rule] - 1, 0, -1):
                gain, cost = gain + poor[rule][s], cost + others[rule][s]
                if poor[rule][s]:
                    best = max(best, (gain / (gain + cost + 1), gain, rule, s))
        if not best[1]:
            break
        _, _, rule, low = best
        for s in range(now[rule] - 1, low - 1, -1):
            rung += 1
            first[rule][s] = rung
        now[rule] = low
    for s in range(STEPS, 0, -1):
        rung += 1
        for rule in RULES:
            if s < now[rule]:
                first[rule][s] = rung
    for rule in RULES:
        first[rule][0] = rung + 1
    return first


def walk(counts: dict[str, dict[int, int]], risk: float = RISK, level: float = LEVEL) -> dict[str, int]:
    """counts: good rows by the first rung that rejects them, for each stratum -> the last rung that is safe."""
    each = math.log(level / max(1, len(counts)))
    found = {}
    for key, rungs in counts.items():
        n, over = sum(rungs.values()), 0
        safe = lambda k, n=n: k < n * risk and _log_tail(k, n, risk) <= each  # noqa: E731  the bound of k of n is within the risk
        if not safe(0):
            continue
        for rung in sorted(rungs):
            over += rungs[rung]
            if not safe(over):
                found[key] = rung - 1
                break
    return found


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, stratum_col: str = "lang") -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row."""
    seen = pinned(measured(docs, stratum_col=stratum_col))
    shares = {r: F.floor(c * STEPS).cast("int") for r, c in _shares().items()}
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    rows = seen.where(~base_failed()).join(known, "doc_id", "left")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("step")) for r, c in shares.items()]))
    poor, others = ({r: [0] * (STEPS + 1) for r in RULES} for _ in range(2))
    for r in rows.where("q is null or q <> 1").select((F.coalesce("q", F.lit(1)) == 0).alias("poor"), rules.alias("r")).groupBy("poor", "r.rule", "r.step").count().collect():
        (poor if r["poor"] else others)[r["rule"]][r["step"]] = r["count"]
    first = ladder(poor, others)
    rung = F.least(*[F.element_at(F.array(*map(F.lit, first[r])), c + 1) for r, c in shares.items()])
    counts = pinned(rows.where("q = 1").groupBy("stratum", rung.alias("rung")).agg(F.count("*").alias("n")))
    strata = counts.select("stratum").distinct().count()

    def last(group: pa.Table) -> pa.Table:
        key = group.column("stratum")[0].as_py()
        got = walk({key: dict(zip(group.column("rung").to_pylist(), group.column("n").to_pylist(), strict=True))}, risk, level / strata)
        return pa.table({"stratum": pa.array(list(got), pa.string()), "last": pa.array(list(got.values()), pa.int32())})

    limits = pinned(counts.groupBy("stratum").applyInArrow(last, "stratum string, last int"))
    rejected = F.coalesce(rung <= F.col("last"), F.lit(False))
    failed = base_failed()
    return seen.join(limits, "stratum", "left").select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
