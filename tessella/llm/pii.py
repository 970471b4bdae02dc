"""Personal data: base patterns plus candidate gradient boosting.

Base spans (e-mail, IP address, card number, phone number) come from fixed patterns and checks and always stay.  High-recall
generators propose further, overlapping spans (written-out addresses, phone and card numbers in other layouts).  Boosted
regression trees over format and context features score them, a logistic link calibrated on lines of its own turns scores
into probabilities, and per-kind thresholds that reach PRECISION on a third set of lines select what is added; of
overlapping choices the most probable stays.  All is trained here, on lines written by a seeded generator.

Cases: a null or empty text has no spans; repeated rows are treated alike; null ids are kept.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm._common import id_and_text, map_batches

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TRAINING_LINES, TREES, DEPTH, RATE = 6000, 60, 3, 0.2
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches per kind that pass their check, by start, then kind."""
    out: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        # The part before the @ reaches back as far as its characters go, but not into the match before.
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append(("email", start, end))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Candidate generators: high recall, spans may overlap.
#: What stands for the @ of an address; the part before it is read backwards from there, that behind it by _WRITTEN_HOST.
_AT = re.compile(r"\s?(?:\(at\)|\[at\])\s?|\sat\s|\s?@\s?", re.I)
_WRITTEN_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?(?:\(dot\)|\[dot\])\s?|\sdot\s|\.)[A-Za-z0-9-]{2,24}){1,4}", re.I)
MOST_LOCAL = 64
_WRITTEN_IP = re.compile(r"(?<![\w.:])(?:[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\))\s?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")
#: A run of digit groups; each span of whole groups with 9 to 19 digits is a candidate.
_DIGITS = re.compile(r"(?<![0-9])[0-9]+(?:[\x20()./-]{1,2}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
FEWEST_DIGITS, MOST_PHONE, LEAST_CARD, MOST_DIGITS = 9, 13, 13, 19
_PHONE_LAYOUT = re.compile(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{5,8}|0[0-9](?:[ .][0-9]{2}){4}")
_CARD_LAYOUT = re.compile(r"[0-9]{13,19}|[0-9]{4}([-./ ])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([- ])[0-9]{6}\2[0-9]{5}")
_HINTS = {
    "email": re.compile(r"e-?mail|mail|contact|write|reach|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|login|from|client", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|karte|carte|tarjeta|cc\b|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|ring|anruf|móvil|dial", re.I),
}
_COUNTER_HINT = re.compile(r"order|invoice|ref|isbn|version|id\b|no\.|nr|serial|sku|date|build|article|page|dataset", re.I)
CONTEXT = 32


def candidates(text: str) -> list[Span]:
    out: list[Span] = []
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - MOST_LOCAL) and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and text[start].isalnum() and not (start and text[start - 1].isalnum()) and (host := _WRITTEN_HOST.match(text, m.end())):
            out.append(("email", start, host.end()))
    if "[.]" in text or "(.)" in text or "::" in text or text.count(":") > 6:
        out += [("ip", *m.span()) for m in _WRITTEN_IP.finditer(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= FEWEST_DIGITS:
            out += _number_spans(text, m.start(), m.end())
    return out


def _number_spans(text: str, start: int, end: int) -> Iterator[Span]:
    """Phone and card candidates among the digit groups of a run: for each first group at most as many as MOST_DIGITS."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    beyond = text[end : end + 1]
    last = len(groups) - (beyond.isalnum() or beyond == "_")  # a group that runs on into a word is none
    for i, (a, _) in enumerate(groups):
        if a and text[a - 1] == "(":
            a -= 1
        if a and (text[a - 1].isalnum() or text[a - 1] in "_+"):
            continue
        n = 0
        for x, b in groups[i:last]:
            n += b - x
            if n > MOST_DIGITS:
                break
            if FEWEST_DIGITS <= n <= MOST_PHONE:
                yield "phone", a, b
            if n >= LEAST_CARD:
                yield "card", a, b


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = _NOT_DIGIT.sub("", s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    marks = {c for c in s if not c.isalnum()}
    return [
        float(KINDS.index(kind)),
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(groups[-1] if groups else 0),
        float(len(marks)),
        float("(" in s),
        float(s.count("-")),
        float(s.count(" ")),
        float(s.count(".")),
        float(s.count("/")),
        float(len(digits) >= 13 and luhn(digits)),
        float(groups in ([3, 3, 4], [4, 4, 4, 4], [4, 6, 5], [3, 3, 3], [2, 2, 2, 2, 2], [5, 6], [3, 4, 4])),
        len(set(digits)) / max(1, len(digits)),
        float(bool(_HINTS[kind].search(before))),
        float(bool(_HINTS[kind].search(after))),
        float(bool(_COUNTER_HINT.search(before))),
        float(digits[:2] in ("19", "20")),
        float(digits[:1] == "0"),
        float("@" in s),
        float(bool(re.search(r"(?:\(at\)|\[at\])", s, re.I))),
        float(bool(re.search(r"dot", s, re.I))),
        float(bool(re.search(r"(?:com|org|net|edu|io|de|fr|es|uk|info|example)$", s, re.I))),
        float(before[-1:].isspace() or not before),
        float(after[:1].isspace() or not after or after[:1] in ".,;"),
        float(bool(_PHONE_LAYOUT.fullmatch(s))),
        float(bool(_CARD_LAYOUT.fullmatch(s))),
        float(s.count("(") - s.count(")")),
        float(len({c for c in re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", s)})),
        float(groups[0] if groups else 0),
        # Digits next to the span, with at most two characters between.
        float(len(m.group(1)) if (m := re.search(r"([0-9]+)[\x20()./-]{1,2}$", before)) else 0),
        float(len(m.group(1)) if (m := re.match(r"[\x20()./-]{1,2}([0-9]+)", after)) else 0),
    ]


class BoostedTrees:
    """Gradient boosting of the logistic loss with small trees over quantile-binned features."""

    BINS = 16

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.nodes: list[list[tuple[int, float, float]]] = []
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        p = y.mean()
        self.bias = math.log(p / (1 - p))
        f = np.full(len(y), self.bias)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            grad, hess = y - q, q * (1 - q)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            place = np.zeros(len(y), int)
            for node in range(len(tree)):
                here = np.flatnonzero(place == node)
                g, h = grad[here].sum(), hess[here].sum()
                tree[node] = (-1, 0.0, self.rate * g / (h + 1.0))
                if 2 * node + 2 >= len(tree) or len(here) < 20:
                    continue
                best, split = 1e-6, None
                for j, c in enumerate(cuts):
                    if len(c):
                        gl = np.cumsum(np.bincount(binned[here, j], grad[here], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[here, j], hess[here], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, split = gain[k], (j, k)
                if split:
                    j, k = split
                    tree[node] = (j, float(cuts[j][k]), tree[node][2])
                    place[here] = np.where(binned[here, j] <= k, 2 * node + 1, 2 * node + 2)
            self.nodes.append(tree)
            f += np.array([tree[i][2] for i in range(len(tree))])[place]
        return self

    def margin(self, row: list[float]) -> float:
        total = self.bias
        for tree in self.nodes:
            at = 0
            while tree[at][0] >= 0:
                at = 2 * at + 1 + (row[tree[at][0]] > tree[at][1])
            total += tree[at][2]
        return total

    def calibrate(self, margins: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that the trees were not grown on."""
        for _ in range(200):
            q = 1 / (1 + np.exp(-(self.scale * margins + self.shift)))
            w = q * (1 - q) + 1e-6
            g = np.array([((y - q) * margins).sum() - 0.01 * (self.scale - 1), (y - q).sum()])
            h = np.array([[(w * margins**2).sum() + 0.01, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            self.scale, self.shift = self.scale + step[0], self.shift + step[1]
            if np.abs(step).max() < 1e-9:
                break

    def probability(self, row: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * self.margin(row) + self.shift))))


def training_lines(seed: int, count: int = TRAINING_LINES) -> list[tuple[str, list[Span]]]:
    """Lines with personal data in many layouts, and look-alikes without any; with the true spans."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "er", "tion", "sh", "ing", "ou", "the", "ré", "eu", "lo", "ba")) for _ in range(r.randint(1, 4)))

    def card() -> str:
        x = r.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        return r.choice((x, " ".join(x[i : i + 4] for i in range(0, 16, 4)), "/".join(x[i : i + 4] for i in range(0, 16, 4)), ".".join(x[i : i + 4] for i in range(0, 16, 4))))

    def phone() -> str:
        return r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(6)}", f"0{d(4)}-{d(6)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"))

    def mail() -> str:
        at, dot = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), ("@", " dot "), ("(AT)", "."), (" at ", "."), (" @ ", ".")))
        return f"{r.choice('abcdefgh')}{word()}{r.choice(('', '.', '_'))}{d(r.randint(0, 2))}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}".encode("ascii", "ignore").decode()

    def ip() -> str:
        six = [f"{r.randrange(65536):x}" for _ in range(8)]
        k = r.randint(1, 4)
        return r.choice(("[.]".join(str(r.randint(0, 255)) for _ in range(4)), ":".join(six), f"{':'.join(six[:k])}::{':'.join(six[k : k + r.randint(1, 3)])}"))

    def noise() -> str:
        return r.choice((f"{r.randint(1950, 2040)}-{d(2)}-{d(2)} {d(2)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1950, 2040)} {d(2)}.{d(2)}", d(r.randint(9, 19)), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(1)} {d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(2)}.{d(4)}-{d(2)}.{d(2)}.{d(4)}", f"{d(5)}-{d(5)}-{d(5)}", f"{word()} at {word()} dot {word()}", f"the {word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"{word()} @ {word()}", f"{r.choice(('a', 'b', 'add', 'de'))}::{r.choice(('fa', 'e', 'bad', 'c'))}", " ".join(d(2) for _ in range(6))))

    def beside() -> tuple[str, list[Span]]:
        """Two to four numbers side by side, with the true spans."""
        value, true = "", []
        for k in r.choices(("phone", "card", "noise"), (5, 2, 3), k=r.randint(2, 4)):
            x = {"phone": phone, "card": card, "noise": lambda: r.choice((noise(), d(r.randint(1, 5)), str(r.randint(1950, 2040))))}[k]()
            value += value and r.choice((" ", " ", " ", ", ", " / ", " or ", "\n"))
            if k != "noise":
                true.append((k, len(value), len(value) + len(x)))
            value += x
        return value, true

    out = []
    for _ in range(count):
        if r.random() < 0.4:
            value, true = beside()
            head = f"{' '.join(word() for _ in range(r.randint(0, 6)))} {r.choice(('', '', 'phone', 'tel', 'call', 'card', 'order', 'ref'))} ".replace("  ", " ").lstrip()
            out.append((f"{head}{value} {word()} {word()}.", [(k, len(head) + a, len(head) + b) for k, a, b in true]))
            continue
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        if r.random() < 0.5:
            kind = r.choice(KINDS)
            value = {"card": card, "phone": phone, "email": mail, "ip": ip}[kind]()
            hint = r.choice(("", "", {"card": "card", "phone": r.choice(("phone", "tel", "call")), "email": "mail", "ip": "host"}[kind]))
            head = f"{lead} {hint} ".replace("  ", " ").lstrip()
            out.append((f"{head}{value} {word()} {word()}.", [(kind, len(head), len(head) + len(value))]))
        else:
            hint = r.choice(("", "", "order", "invoice", "ref", "ISBN", "version", "id"))
            out.append((f"{lead} {hint} {noise()} {word()} {word()}.".replace("  ", " ").lstrip(), []))
    return out


def labelled(lines: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    x, y, kinds = [], [], []
    for text, true in lines:
        for c in candidates(text):
            x.append(features(text, c))
            # Of the overlapping spans of a run of digits only the true one is right.
            y.append(float(c in true if c[0] in ("card", "phone") else any(c[0] == k and c[1] < b and a < c[2] for k, a, b in true)))
            kinds.append(c[0])
    return np.array(x), np.array(y), kinds


@lru_cache(maxsize=1)
def trained() -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and each kind's threshold: the lowest calibrated one that reaches PRECISION.  Trees, calibration and
    thresholds each have lines of their own."""
    x, y, _ = labelled(training_lines(1))
    model = BoostedTrees().fit(x, y)
    x, y, _ = labelled(training_lines(2, TRAINING_LINES // 2))
    model.calibrate(np.array([model.margin(r) for r in x.tolist()]), y)
    x, y, kinds = labelled(training_lines(3, TRAINING_LINES // 2))
    p = np.array([model.probability(r) for r in x.tolist()])
    limits = {}
    for k in KINDS:
        mine = np.array([c == k for c in kinds])
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[k] = max(0.5, float(p[mine][order][good[-1]])) if len(good) else 1.1
    return model, limits


def all_spans(text: str, model: BoostedTrees, limits: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and base with added spans, each by start, then kind."""
    base = base_spans(text)
    scored = []
    for c in candidates(text):
        if not any(c[1] < b and a < c[2] for _, a, b in base) and (p := model.probability(features(text, c))) >= limits[c[0]]:
            scored.append((-p, c[1], c))
    added: list[Span] = []
    for _, _, c in sorted(scored):
        if not any(c[1] < b and a < c[2] for _, a, b in added):
            added.append(c)
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, and spans (all)."""
    model, limits = trained()

    def run(batch: pa.RecordBatch) -> dict:
        found = [all_spans(t, model, limits) for t in batch.column("text").to_pylist()]
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        return {"doc_id": batch.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(s) for _, s in found]}

    return map_batches(id_and_text(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with every span replaced by its kind in square brackets; of overlapping ones the first counts."""
    model, limits = trained()

    def cleaned(t: str | None) -> str | None:
        if not t:
            return t
        parts, at = [], 0
        for k, a, b in all_spans(t, model, limits)[1]:
            if a >= at:
                parts += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join([*parts, t[at:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index(text_col)
        return batch.set_column(i, batch.schema.field(i), pa.array([cleaned(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    return map_batches(docs, run, docs.schema)


