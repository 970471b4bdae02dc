"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import collections
import hashlib
import math
import os
import random
import re
import string
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import byte_bpe, decontaminate, html_text, pii, quality, queries, shard, simhash, suffix_dedup, token_files, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "null id"), (5, "Ünï cödé " * 40), (6, "x" * 70_000), (7, "word " * 9_000), (8, "word " * 9_000)]


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that the operators use themselves
        for name in ("score", "spans", "fp", "shard", "n_words", "th", "row", "bucket", "file"):
            df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# --- 1 decontamination -----------------------------------------------------------------------------------------------


def brute_hits(items, words, window):
    wins = collections.defaultdict(set)
    for i, w in items:
        for k in [tuple(w[j : j + window]) for j in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)] if w else []:
            wins[k].add(i)
    hit, found = set(), set()
    for n in {len(k) for k in wins}:
        for j in range(len(words) - n + 1):
            if (k := tuple(words[j : j + n])) in wins:
                hit.update(range(j, j + n))
                found |= wins[k]
    return hit, found


def test_automaton_finds_what_brute_force_finds():
    for seed in range(400):
        r = random.Random(seed)
        window = r.choice([2, 3, 4])
        items = [(i, [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 9))]) for i in range(r.randint(0, 6))]
        words = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(0, 30))]
        spans, found = decontaminate.SuffixAutomaton(items, window).match(words)
        assert ({x for a, b in spans for x in range(a, b)}, found) == brute_hits(items, words, window)


def test_words_fold_only_ascii():
    text = "Aéß Zz9\tfoo_bar[x]`q`{é}~ \x7fÀB1/2:3@A"
    low = "".join(c.lower() if c.isascii() else c for c in text)
    assert [w.decode() for w in decontaminate.words_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_sharded_automata_agree_with_one(spark, odd):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abcdef") for _ in range(n))
    items = spark.createDataFrame([(i, text(r.randint(0, 8))) for i in range(20)] + [(20, None), (None, "a b c d")], "item_id long, text string")
    docs = docs_of(spark, [(i, text(60)) for i in range(30)] + ODD)
    one = sorted(map(str, decontaminate.report(docs, items, 4).collect()))
    assert one == sorted(map(str, decontaminate.report(docs, items, 4, shard_words=20).collect()))
    assert len(one) == 30 + len(ODD)


def test_spans_are_removed(spark):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    docs = docs_of(spark, [(1, f"Before it {'x ' * 20}{passage}, after."), (2, passage), (3, "clean text"), (4, None)])
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert 2 not in left and left[3] == "clean text" and left[4] is None
    assert "three" not in left[1] and left[1].endswith(", after.") and left[1].startswith("Before it")


# --- 2 personal data -------------------------------------------------------------------------------------------------


def test_sharded_removal_agrees_with_one(spark, odd):
    r = random.Random(4)
    word = lambda: r.choice("abcdefg")
    base = [f"t{i}" for i in range(60)]
    # Passages that overlap in a document and belong to items of different shards, and random ones.
    items = [(i, " ".join(base[8 * i : 8 * i + 14])) for i in range(6)] + [(10 + i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(12)]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, " ".join(["x"] * i + base[: 2 * i] + ["y"] * i)) for i in range(30)]
    docs, items = docs_of(spark, rows).unionByName(odd), spark.createDataFrame(items, "item_id long, text string")
    for share in (0.5, 1.0):
        whole = sorted(map(str, decontaminate.remove_spans(docs, items, share, window=4).collect()))
        for words in (15, 40):
            assert sorted(map(str, decontaminate.remove_spans(docs, items, share, window=4, shard_words=words).collect())) == whole


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_match_the_patterns():
    for seed in range(3000):
        r = random.Random(seed)
        al = r.choice(["a@b.", "@a..-", "12.", "0 1-2+().3456789", "+1 .(2)", "0123456789- "])
        t = "".join(r.choice(al) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t)


def test_added_spans_are_right_on_held_out_lines():
    model, limits = pii.trained()
    x, y, kinds = pii.labelled(pii.training_lines(77, 1500))
    p = np.array([model.probability(r) for r in x.tolist()])
    chosen = p >= np.array([limits[k] for k in kinds])
    assert y[chosen].mean() > 0.96 and (chosen & (y == 1)).sum() / y.sum() > 0.9
    _, every = pii.all_spans("write to jane.roe (at) example (dot) com or a@b.org", model, limits)
    assert [s[0] for s in every] == ["email", "email"]


def test_numbers_side_by_side_are_found():
    model, limits = pii.trained()
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.all_spans(t, model, limits)[1]]
    assert found("call 555-123-4567 555-987-6543 now") == [("phone", "555-123-4567"), ("phone", "555-987-6543")]
    assert found("(555) 123-4567 (555) 987-6543") == [("phone", "(555) 123-4567"), ("phone", "(555) 987-6543")]
    assert ("phone", 0, 12) in pii.candidates("555-123-4567 2024 edition")
    # Per first group at most as many spans as digits.
    assert len(pii.candidates(" ".join(["1"] * 1000))) <= 2 * pii.MOST_DIGITS * 1000
    lines = [x for x in pii.training_lines(78, 1500) if sum(k in ("card", "phone") for k, _, _ in x[1]) > 1]
    true = [(t, s) for t, spans in lines for s in spans]
    assert len(lines) > 300 and sum(s in pii.all_spans(t, model, limits)[1] for t, s in true) >= 0.95 * len(true)
    wrong = [s for t, spans in lines for s in set(pii.all_spans(t, model, limits)[1]) - {*pii.base_spans(t), *spans}]
    assert len(wrong) <= 0.02 * len(true)


#: Lines and the span that some generator must propose, in layouts that the trainer does not write.
LAYOUTS = [
    ("reach joe.smith at mail.example.org today", "email", "joe.smith at mail.example.org"),
    ("Jane_Roe(AT)Example.Org", "email", "Jane_Roe(AT)Example.Org"),
    ("x [at] host-1 [dot] co [dot] uk", "email", "x [at] host-1 [dot] co [dot] uk"),
    ("a.b @ c.de", "email", "a.b @ c.de"),
    ("from 2001:db8::ff00:42:8329 on", "ip", "2001:db8::ff00:42:8329"),
    ("10(.)0(.)0(.)7", "ip", "10(.)0(.)0(.)7"),
    ("0049/30/1234567", "phone", "0049/30/1234567"),
    ("12-34-56-78-90", "phone", "12-34-56-78-90"),
    ("4111.1111.1111.1111 2031", "card", "4111.1111.1111.1111"),
    ("3782 822463 10005 7 7", "card", "3782 822463 10005"),
]


def test_generators_propose_unseen_layouts():
    for text, kind, part in LAYOUTS:
        a = text.index(part)
        assert (kind, a, a + len(part)) in pii.candidates(text), text
    plain = "They met at home. Then at the A.B. at 12:30:45, std::vector @ all, a@, at at at. " * 50
    assert len(pii.candidates(plain)) <= 100


def test_selection_matches_brute_force():
    model, limits = pii.trained()
    for text, _ in pii.training_lines(5, 400):
        text = text + " a@b.org +1 (212) 555-0100"
        base = brute_spans(text)
        left = {c: model.probability(pii.features(text, c)) for c in set(pii.candidates(text))}
        left = {c: p for c, p in left.items() if p >= limits[c[0]] and all(c[2] <= a or b <= c[1] for _, a, b in base)}
        want = list(base)
        while left:
            best = max(left, key=lambda c: (left[c], -c[1], [-x for x in c[0].encode()], -c[2]))
            want.append(best)
            left = {c: p for c, p in left.items() if c[2] <= best[1] or best[2] <= c[1]}
        found, every = pii.all_spans(text, model, limits)
        assert found == base and sorted(every) == sorted(want)


def test_redaction(spark):
    docs = docs_of(spark, [(1, "mail a@b.org now"), (2, None), (3, "clean")])
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "mail [EMAIL] now", 2: None, 3: "clean"}


# --- 3 byte-level BPE ------------------------------------------------------------------------------------------------


def test_chunks_stitch_to_the_whole(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 40)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 12)
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.DEFAULT_RANKS))
    for seed in range(800):
        r = random.Random(seed)
        al = r.choice(["ab '", "a \n", "a'slltre ", "é1 .,\t", "a", "  \n\r", "ab12 '!?é "])
        t = "".join(r.choice(al) * r.choice([1, 1, 1, 2, 30]) for _ in range(r.randint(0, 90)))
        ids, back = byte_bpe.encode_chunks(enc, [byte_bpe.Chunk(*c) for c in byte_bpe.cut(t)], {})
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and back == t.encode()


def test_bpe_table(spark, odd):
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.DEFAULT_RANKS))
    want = collections.Counter((d, hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ODD)
    assert collections.Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(odd).collect()) == want
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(odd)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((d, t or "") for d, t in ODD)


# --- 4 Arrow files ---------------------------------------------------------------------------------------------------


def test_token_files(spark, tmp_path):
    rows = [(d, t) for d, t in ODD if d is not None]
    tok = Tokenizer.from_file(public_tokenizers.path(token_files.DEFAULT_TOKENIZER))
    more = [(100 + i, f"Hello World {i} <|endoftext|> it's ÀÉ é x y") for i in range(40)]
    manifest = token_files.write(docs_of(spark, rows + more), str(tmp_path), bucket_bytes=30_000)
    assert manifest.select("file").distinct().count() > 1
    got = collections.Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(manifest).collect())
    at, want = 0, collections.Counter()
    for d, t in sorted(rows + more, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert got == want
    few = spark.createDataFrame([(b, 10 + b) for b in range(0, 9000, 7)], "bucket int, n_tokens long")
    sums = {r.bucket: r.first for r in token_files.firsts(few).collect()}
    assert sums == {b: sum(10 + x for x in range(0, b, 7)) for b in range(0, 9000, 7)}
    one = token_files.SequenceFile(manifest.first().file)
    ids, mask = one.sequence(0)
    assert len(ids) == len(mask) == token_files.LENGTH


class Counted:
    """A tokenizer that notes what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, texts, **how):
        self.seen += " ".join(texts).split()
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_word_encoder_matches_the_library_on_odd_words():
    path, r = public_tokenizers.path(token_files.DEFAULT_TOKENIZER), random.Random(4)
    tok, enc = Tokenizer.from_file(path), token_files.WordEncoder(path)
    pool = ["a", "Ab", "Straße", "ÀÉ", "e\u0301", "\u0301", "\u0338", "İ", "ı", "ΟΔΟΣ", "ǅ", "\u212b", "漢字", "か\u3099", "12", "²", "<|endoftext|>", "<|", "it's", "'s", "'ll", "</w>", "\0", "\x1c", "\x85", "\u00a0", "\u2028", "\u200b", "\U00031350", *string.punctuation]
    for _ in range(60):
        texts = ["", *("".join(r.choice(pool if r.random() < 0.75 else " \n\t\r\v\f") for _ in range(r.randint(0, 60))) for _ in range(30))]
        ids, n = enc.encode(pa.array(texts))
        want = [[*e.ids, 1] for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_word_encoder_gives_the_library_letters_once():
    enc = token_files.WordEncoder(public_tokenizers.path(token_files.DEFAULT_TOKENIZER))
    enc.tokenizer = seen = Counted(enc.tokenizer)
    for text in ("plain Plain, PLAIN$$$ other%%,", "plain%%, Other$$$ other plain"):
        enc.encode(pa.array([text] * 3))
    assert sorted(seen.seen) == sorted(["plain", "other", ",", "$$$", "%%,"])


def test_word_encoder_is_right_while_it_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_CACHED", 50)
    monkeypatch.setattr(token_files, "CALL", 7)
    path, r = public_tokenizers.path(token_files.DEFAULT_TOKENIZER), random.Random(6)
    tok, enc = Tokenizer.from_file(path), token_files.WordEncoder(path)
    for _ in range(40):
        text = " ".join(r.choice(["w", "Über", "x1"]) + r.choice("abcdefgh") * r.randint(0, 9) + r.choice(["", "", "!", "?!"]) for _ in range(30))
        assert enc.encode(pa.array([text]))[0].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]
        assert len(enc.known) + len(enc.older) <= 2 * (50 + 60)


def test_word_encoder_costs_less_than_a_lookup_for_each_word():
    r = random.Random(5)
    words = list({"".join(r.choices(string.ascii_lowercase, k=r.randint(2, 10))) for _ in range(5000)})
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(300)]
    enc, lookup, column = token_files.WordEncoder(public_tokenizers.path(token_files.DEFAULT_TOKENIZER)), {w.encode(): b"xx" for w in words}, pa.array(texts)

    def seconds(work):
        work()  # what is learnt does not count
        took = []
        for _ in range(5):
            at = time.process_time()
            work()
            took.append(time.process_time() - at)
        return min(took)

    whole, plain = seconds(lambda: enc.encode(column)), seconds(lambda: [b"".join([lookup[w] for w in t.encode().split()]) for t in texts])
    assert whole < plain, (whole, plain)


# --- 5 quality -------------------------------------------------------------------------------------------------------


def test_measures_match_brute_force():
    for seed in range(500):
        r = random.Random(seed)
        t = "".join(r.choice(["a", "b", "ab", " ", "\n", "\t", "#", "é", " ", "A"]) for _ in range(r.randint(0, 80)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.measures(t)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_bounds_are_exact_and_cutoffs_hold_their_risk():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality.upper_bound(3, 50, 0.05) == pytest.approx(0.1478, abs=2e-4)
    # Many rows: P(X <= 200000) of 10^7 at 0.0201, by the normal law with its continuity correction.
    deviations = (200_000.5 - 201_000) / (201_000 * 0.9799) ** 0.5
    assert math.exp(quality._log_tail(200_000, 10**7, 0.0201)) == pytest.approx(math.erfc(-deviations / 2**0.5) / 2, rel=0.02)
    rng = np.random.default_rng(5)
    broken = 0
    for _ in range(60):
        train = np.clip((rng.exponential(0.05, 4000) * quality.STEPS).astype(int), 0, quality.STEPS)
        found = quality.cutoffs({("en", "symbol_share"): np.bincount(train, minlength=quality.STEPS + 1).tolist()})
        if found:
            broken += np.exp(-found["en", "symbol_share"] / quality.STEPS / 0.05) > quality.RISK / len(quality.RULES)
    assert broken <= 60 * quality.LEVEL * 2.5


def test_quality_keeps_clean_rows(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{clean} {i}") for i in range(300)] + [(1000, clean + " ###" * 200)] + ODD
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(None, 1), (1, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.verdicts(docs_of(spark, rows), labels).collect() if r.doc_id and 10 < r.doc_id < 300}
    assert all(got.values())


def test_ladder_holds_its_risk():
    assert quality.walk({"a": {3: 0, 900: 217}, "b": {900: 216}, "c": {900: 217}, "d": {900: 217}}).keys() == {"a", "c", "d"}
    rng = np.random.default_rng(6)
    zeros = {r: [0] * (quality.STEPS + 1) for r in quality.RULES}
    first = quality.ladder(zeros, zeros)
    never = first["caps_share"][0]
    broken = 0
    for _ in range(200):
        steps = np.clip((rng.exponential(0.05, (600, len(quality.RULES))) * quality.STEPS).astype(int), 0, quality.STEPS)
        rungs = np.min([np.array(first[r])[steps[:, j]] for j, r in enumerate(quality.RULES)], axis=0)
        last = quality.walk({"en": collections.Counter(rungs.tolist())})["en"]
        cut = min(s for s in range(1, quality.STEPS + 1) if first["caps_share"][s] <= last) / quality.STEPS
        broken += 1 - (1 - np.exp(-cut / 0.05)) ** len(quality.RULES) > quality.RISK
        assert last < never
    assert broken <= 200 * quality.LEVEL * 2


def test_ladder_starts_where_poor_rows_are():
    poor, others = ({r: [0] * (quality.STEPS + 1) for r in quality.RULES} for _ in range(2))
    poor["symbol_share"][20] = 30
    others["dup_line_share"][60] = others["symbol_share"][0] = 100
    first = quality.ladder(poor, others)
    assert first["symbol_share"][20] < first["dup_line_share"][60] < first["dup_line_share"][0]
    for steps in first.values():  # nested
        assert steps[1:] == sorted(steps[1:], reverse=True) and min(steps) > 0


def test_junk_of_each_language_is_rejected(spark):
    r = random.Random(5)
    rows, labels = [], []
    for k, lang in enumerate(("en", "de", "es", "fr", None)):
        clean = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(80))
        for i in range(260):
            rows.append((1000 * k + i, clean() + "\nsame\nsame" * (i % 50 == 0), lang))
            labels.append((1000 * k + i, 1))
        for i in range(20):  # half of the junk has a label
            rows.append((1000 * k + 500 + i, clean() + " ##" * 30, lang))
            labels += [(1000 * k + 500 + i, 0)] * (i < 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not any(x.base_failed for x in got.values())
    assert not any(got[1000 * k + 500 + i].kept for k in range(5) for i in range(20))
    for k in range(5):
        assert sum(not got[1000 * k + i].kept for i in range(260)) <= 260 * quality.RISK


# --- 6 SimHash -------------------------------------------------------------------------------------------------------


def brute_fingerprint(t, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark):
    for _, t in [*ODD[:7], (0, "one two"), (0, "A b C d"), (0, "a a a a a b")]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(5)]
    items = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) for b in base for _ in range(60)})
    tree = simhash.BKTree(items)
    for x in items[:80]:
        assert sorted(tree.within(x, 3)) == [i for i, y in enumerate(items) if (x ^ y).bit_count() <= 3]


@pytest.mark.parametrize("nodes", [simhash.TREE_NODES, 16])
def test_components_match_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash, "TREE_NODES", nodes)
    r = random.Random(3)
    fps = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(40):
            x ^= sum(1 << r.randrange(64) for _ in range(r.randint(1, 4)))
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame(list(enumerate(signed)), "node long, fp long"))).collect()
    got = dict(enumerate(range(len(fps)))) | {x.node: x.component for x in found}
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    for i in range(len(fps)):
        a = i
        while parent[a] != a:
            a = parent[a]
        assert got[i] == a


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got[1, 1] == got[2, 1] == got[3, 1] == 1 and got[4, 4] == 2 and got[8, 7] == 1 and got[None, None] == 1
    assert simhash.near_duplicates(empty).count() == 0


# --- 7 sharding ------------------------------------------------------------------------------------------------------


def test_shards_are_exact_and_uniform(spark, odd):
    df = spark.range(1000, numPartitions=7)
    got = shard.shuffle_into_shards(df, 16).toPandas()
    assert sorted(got.id) == list(range(1000))
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    rng = np.random.default_rng(0)
    x = [shard._large(rng, 3000, 7000, 500) for _ in range(2000)]
    assert abs(np.mean(x) - 150) < 1 and abs(np.std(x) - 10) < 0.6
    m = np.mean([shard.matrix([10, 30], 4, s) for s in range(400)], axis=0)
    assert np.allclose(m, [[2.5] * 4, [7.5] * 4], atol=0.2)
    assert shard.placed(odd).count() == len(ODD)


def test_shards_hold_whole_rows(spark, odd, tmp_path):
    got = shard.placed(odd, 4, folder=f"{tmp_path}/shards").collect()
    rows = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert len(rows) == len(ODD) and collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(ODD)
    assert {r.lang for r in rows} == {"en"} and {r.th for r in rows} == {"clash"}
    of = lambda r: (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.shard, r.slot)
    assert {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got} == set(map(of, rows)) and len({(r.shard, r.slot) for r in rows}) == len(ODD)


# --- 8 suffix arrays -------------------------------------------------------------------------------------------------


def test_suffix_arrays_and_repeats(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LENGTH", 8)
    for seed in range(400):
        r = random.Random(seed)
        al = r.choice([b"ab", b"abc", b"a", b"\x00ab", bytes(range(1, 120))])
        d = bytes(r.choice(al) for _ in range(r.randint(1, 80)))
        order = suffix_dedup.suffix_array(np.frombuffer(d, np.uint8))
        heads = [d[i : i + 8].ljust(8, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(len(d))) and heads == sorted(heads)
        snippets = [bytes(r.choice(al) for _ in range(r.randint(8, 40))) for _ in range(r.randint(1, 6))]
        count = collections.Counter(s[i : i + 8] for s in snippets for i in range(len(s) - 7))
        for s, got in zip(snippets, suffix_dedup.repeated_windows(snippets)):
            assert got.tolist() == [i for i in range(len(s) - 7) if count[s[i : i + 8]] > 1]


def brute_removed(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        yield d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("many", [suffix_dedup.MANY_KINDS, 1])
def test_repeats_match_brute_force(spark, monkeypatch, many, empty):
    monkeypatch.setattr(suffix_dedup, "MANY_KINDS", many)
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefghij klmno") for _ in range(n))
    passage, other = noise(450), noise(230)
    rows = [(i, noise(r.randint(0, 500)) + r.choice(["", passage, passage[r.randint(0, 200) :], other, other[:199], other + passage]) + noise(r.randint(0, 300))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "-" * 500), (102, noise(90) * 5), (103, None), (104, ""), (None, passage), (105, "é" * 150), (106, rows[0][1]), (106, rows[0][1])]
    got = collections.Counter(tuple(x[:5]) for x in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect())
    assert got == collections.Counter(brute_removed(rows))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_many_repeated_rows(spark):
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghij klmno") for _ in range(n))
    same, other, part = noise(6000), noise(3000), noise(400)
    rows = [(7, same)] * 600 + [(None, other)] * 600 + [(9, other)] + [(10 + i, noise(300) + part + noise(50)) for i in range(20)]
    got = collections.Counter(tuple(x[:5]) for x in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect())
    assert got == collections.Counter(brute_removed(rows))


# --- 9 toxicity ------------------------------------------------------------------------------------------------------


def toxic_sample(seed, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "the", "ing", "ou", "sh"]) for _ in range(r.randint(1, 3)))
    out = []
    for i in range(n):
        y = i % 8 == 0
        words = [word() for _ in range(r.randint(10, 60))]
        if y:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "grobx" + word()]))
        out.append((int(y), " ".join(words) + "."))
    return out


def test_toxicity_learns_words_and_beginnings():
    model = toxicity.fit(toxic_sample(1, 1600))
    held = toxic_sample(2)
    said = [model.score(t) >= toxicity.THRESHOLD for _, t in held]
    assert np.mean([s == bool(y) for s, (y, _) in zip(said, held)]) > 0.98
    plain, quoted, negated = (model.score(t) for t in ("he is an idiot here.", "she said he was an idiot.", "he is not an idiot."))
    assert plain > quoted > 0 and plain > negated
    assert 0 <= model.score("") <= 1 and model.score("") < toxicity.THRESHOLD


def test_inflected_stems_count_from_several_forms():
    r = random.Random(6)
    ends = ["em", "est", "ung", "er", "keit", "lich"]
    word = lambda: "".join(r.choice(["an", "er", "the", "ing", "ou", "sh"]) for _ in range(r.randint(2, 4)))

    def sample(n):
        out = []
        for i in range(n):
            words = [word() for _ in range(r.randint(20, 60))]
            some = r.sample(ends, 3 if i % 8 == 0 else i % 8 == 1)  # one form alone is innocent
            for e in some * (1 if i % 8 == 0 else 4):
                words.insert(r.randrange(len(words)), "gromp" + e)
            out.append((int(i % 8 == 0), " ".join(words) + "."))
        return out

    model = toxicity.fit(sample(1600))
    assert np.mean([(model.score(t) >= toxicity.THRESHOLD) == bool(y) for y, t in sample(400)]) > 0.98


def test_the_grammar_reads_contexts():
    model = toxicity.ToxicityModel(words={"idiot": 1.0})
    found = lambda t: {p for p, n in zip(toxicity.PATTERNS, model.clause_counts(t), strict=True) if n}
    assert found("what an idiot") == {"insult"} and found("you are an idiot") == {"aimed_insult"}
    assert found("idiot, that is what you are") == {"insult", "aimed_insult"}
    assert found("this idiot went far far away from there before you") == {"insult"}
    assert found("he is not an idiot") == {"negated_insult"} and found("someone said that idiot left") == {"quoted_insult"}
    assert found("i will kill you") == {"threat"} and found("kill some time") == set() and found("i will not kill you") == set()
    assert found("they said i would kill you") == set() and found("kill it. you know") == set()


def test_tables_and_memory_give_one_model(spark):
    rows = [(i, t) for i, (_, t) in enumerate(toxic_sample(3, 1200))]
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(toxic_sample(3, 1200))] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    learned = toxicity.fit_from_tables(docs_of(spark, [*rows, *rows[:50]]), labels)
    alone = toxicity.fit([(y, t) for i, (y, t) in enumerate(toxic_sample(3, 1200)) if toxicity.crc_remainder(i) != 2])
    assert learned.words == alone.words and learned.prefixes == alone.prefixes
    assert np.allclose([*learned.weights, learned.bias], [*alone.weights, alone.bias])


def test_held_out_rows(spark, odd):
    got = {r.doc_id: r.h for r in odd.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (d is not None and toxicity.crc_remainder(d) == 2) for d, h in got.items())


# --- 10 pages --------------------------------------------------------------------------------------------------------


def test_pages_of_other_seeds():
    model, r = html_text.trained(), random.Random(99)
    right = extra = missed = 0
    for _ in range(200):
        source, content = html_text.training_page(r)
        got = set(html_text.extract(source, model).split("\n\n"))
        right, extra, missed = right + len(got & content), extra + len(got - content), missed + len(content - got)
    assert right / (right + extra) > 0.96 and right / (right + missed) > 0.94


def test_marginals_match_enumeration():
    model = html_text.trained()
    parent = [-1, 0, 0, 1, 1]
    features = [[0], [3, 18], [4], [16], [5, 20]]
    own = [1 / (1 + np.exp(-sum(model.weights[k] for k in on))) for on in features]
    total, each = 0.0, np.zeros(5)
    for bits in range(32):
        x = [bits >> i & 1 for i in range(5)]
        p = np.prod([own[i] if x[i] else 1 - own[i] for i in range(5)]) * np.prod([model.pair[x[parent[i]]][x[i]] for i in range(1, 5)])
        total += p
        each += p * np.array(x)
    assert np.allclose(model.marginals(parent, features), each / total)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain &amp; simple"), (4, "u", "<p>a<p>b"), (5, "u", "<article><h1>T</h1><p>Some text, which goes on &lt;here&gt;.\n</p></article><footer>f</footer>"), (None, "u", "<script>x</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got[1] == got[2] == got[None] == "" and got[3] == "plain & simple" and got[5] == "T\n\nSome text, which goes on <here>."


def test_broken_pages_take_linear_time():
    model = html_text.trained()
    for piece in ("<b c ", "<p x='", "<!--", "<head>", "<div>", "</p>", "<li><p>", "<td", "&amp", "<script>", "<h1>", "</b ", "<a href=\"", "< ", "<!"):
        for tail in ("", "\"", "'", ">", "</div>" * 50_000):
            began = time.process_time()
            html_text.extract(f"<p>start</p>{piece * (300_000 // len(piece))}{tail}", model)
            assert time.process_time() - began < 6, (piece, tail[:6])


def test_pages_are_read_as_browsers_do():
    model = html_text.trained()
    read = lambda body: html_text.extract(body, model)
    assert read("&<b>amp;</b> x") == "&amp; x" and read("a &amp;amp; b &#65;&eacute;") == "a &amp; b Aé"
    assert read("x<!-->y<!-- z -->w") == "xyw"
    long = "A sentence which is long enough to be kept as the main text of this page. " * 3
    assert read(f"<article><p title=it's>{long}</p><p class=\"a > b\">{long}don't</p></article>") == f"{long.strip()}\n\n{long}don't"
    assert read(f"<article><p>{long}<b class=x\">bold</b></p></article>") == f"{long}bold"


# --- all on odd and empty tables -------------------------------------------------------------------------------------


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    items = spark.createDataFrame([(1, "word word word"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for df, n in ((odd, len(ODD)), (empty, 0)):
        assert decontaminate.report(df, items).count() == n
        assert decontaminate.report(df, items.limit(0)).count() == n
        assert pii.find(df).count() == n
        assert byte_bpe.digests(df).count() == n
        assert token_files.round_trip(df).count() == n
        for known in (labels, none):
            assert quality.verdicts(df, known).count() == n
            assert toxicity.score_documents(df, toxicity.fit_from_tables(df, known)).count() == n
        assert shard.placed(df).count() == n
        assert suffix_dedup.remove_repeats(df).count() == n
        assert set(pii.redact(df).columns) == set(df.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), c.sql(queries.ORACLE[name]).df()
    rows = lambda df: sorted(df[sorted(df.columns)].astype(str).itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_queries_give_their_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some text {i} of a.b@c.org " * (i % 7), "en", "web", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in {"documents": docs, "benchmark": spark.createDataFrame([(1, "some text")], "item_id long, text string"), "labels": spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"), "pages": spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    want = {
        "op1_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
        "op3_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op4_arrow_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op5_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op10_html": "page_id bigint, url string, text string, n_chars bigint",
    }
    assert set(want) | set(queries.ORACLE) == set(queries.QUERIES)
    for name, columns in want.items():
        out = queries.QUERIES[name](spark, str(tmp_path))
        assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == columns, name
        assert out.count() == (1 if name == "op10_html" else 40)
