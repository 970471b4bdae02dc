"""The corpus pipeline against what each of its stages does alone, on planted rows."""

import hashlib
import random

import numpy as np
import public_tokenizers

import corpus_pipeline
from tessella.llm import byte_bpe, decontaminate, near_copies, pii, toxicity


def five_word_shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows, items, labels):
    known = {d: y for d, y in labels}
    model = toxicity.fit([(known[d], t or "") for d, t in sorted(rows) if d in known and toxicity.crc_remainder(d) != 2])
    rows = [(d, t) for d, t in rows if model.score(t or "") < toxicity.THRESHOLD]
    group = dict(enumerate(range(len(rows))))
    grams = [five_word_shingles(t) for _, t in rows]
    changed = True
    while changed:
        changed = False
        for a in group:
            for b in group:
                if group[a] != group[b] and 5 * (n := len(grams[a] & grams[b])) >= 4 * (len(grams[a]) + len(grams[b]) - n):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    low = {}
    for i, g in group.items():
        low[g] = min(low.get(g, rows[i][0]), rows[i][0])
    rows = [r for i, r in enumerate(rows) if r[0] == low[group[i]]]
    machine = decontaminate.SuffixAutomaton([(i, decontaminate.words_of(t)) for i, t in items])
    spans, limits = pii.trained()
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.DEFAULT_RANKS))
    out = {}
    for d, t in rows:
        t = t or ""
        hit, _ = machine.match(decontaminate.words_of(t))
        if hit:
            at = [m.span() for m in decontaminate._ANY_CASE.finditer(t)]
            if 2 * sum(b - a for a, b in hit) > len(at):
                continue
            for a, b in reversed(hit):
                t = t[: at[a][0]].rstrip(" ") + t[at[b - 1][1] :]
        for k, a, b in reversed(pii.all_spans(t, spans, limits)[1]):
            t = f"{t[:a]}[{k.upper()}]{t[b:]}"
        out[d] = hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["an", "er", "the", "ing", "ou", "sh", "ble"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    rows = [(i, text(r.randint(5, 120))) for i in range(120)]
    rows += [(200 + i, f"{text(20)} idiot {text(20)}") for i in range(30)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, f"{text(60)} {items[2][1]} {text(10)}"), (303, items[1][1]), (304, f"{text(30)} a.b@c.org {text(9)}"), (305, None), (306, "")]
    labels = [(d, int(200 <= d < 230)) for d, _ in rows if d < 230]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == brute(rows, items, labels)
    assert 303 not in got and 300 not in got and 302 in got and not any(200 <= d < 230 for d in got)


def test_all_but_the_last_stage_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_near_duplicate_stage_matches_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(1, 90)))) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(100 + i, f"{passage} {t}") for i, t in rows[:20]]
    for i in range(150):  # copies of copies with one word more, less or different
        words = r.choice(rows)[1].split()
        at = r.randrange(len(words))
        words[at : at + r.randint(0, 1)] = [f"new{i}"] * r.randint(0, 1)
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, f"{passage} {i}") for i in range(40)] + [(3000, None), (3001, ""), (None, rows[5][1]), (4, rows[4][1])]
    rows += [(7, rows[9][1]), (7, "an unrelated text under an id that another one has"), (None, "no id"), (None, "no id"), (None, "No ID")]

    sets = [five_word_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    members = {g: [i for i in range(len(rows)) if group[i] == g] for g in group}
    stays = {g: {rows[i] for i in m if key(i) == min(map(key, m))} for g, m in members.items()}
    assert sum(1000 <= d < 1150 for d, _ in rows if d) - sum(any(1000 <= (d or 0) < 1150 for d, _ in s) for s in stays.values()) > 60
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, th int")
    for cell in (1024, 7):
        monkeypatch.setattr(near_copies, "CELL", cell)
        monkeypatch.setattr(near_copies, "TREE_NODES", 2 * cell)
        monkeypatch.setattr(near_copies, "CELL_SHINGLES", 300 * cell)
        left = [(d.doc_id, d.text) for d in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
        assert len(left) == len(stays)
        for s in stays.values():
            assert sum(x in s for x in left) == 1


def test_near_duplicate_stage_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert corpus_pipeline.near_duplicate_stage(spark, docs, "").collect() == []


def test_order_of_shingles_counts_all_documents(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 50, raising=False)
    rows = [(f"the passage that every one of these has {i} and then word{i} goes{i} on{i} alone{i}",) for i in range(400)] + [(None,), ("",)]
    want = np.zeros(near_copies.COUNTERS, np.int64)
    for (t,) in rows:
        np.add.at(want, np.unique(near_copies.shingles(t)) % np.uint64(near_copies.COUNTERS), 1)
    want[want <= 8 + 4 * want.sum() / near_copies.COUNTERS] = 0
    assert want.max() == 400
    assert (near_copies.common(spark.createDataFrame(rows, "text string").repartition(5)) == want).all()
    assert not near_copies.common(spark.createDataFrame([], "text string")).any()


def test_wide_fingerprints_of_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(4)
    for n in (5, 10, 40, 300):
        worst = 0
        for _ in range(400):
            g = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            other = np.concatenate([g[: n - n // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64)]) if n >= 10 else g[:-1]
            worst = max(worst, int(np.bitwise_count(near_copies.fingerprint(g) ^ near_copies.fingerprint(np.unique(other))).sum()))
        assert worst <= near_copies.RADIUS


def test_bit_map_holds_its_keys(spark):
    keys = np.random.default_rng(5).integers(-(2**63), 2**63, 3000)
    known = near_copies._bit_map(spark.createDataFrame([(int(k),) for k in keys], "th long"), "th")
    assert near_copies._in_bit_map(known, keys).all()
    assert near_copies._in_bit_map(known, np.random.default_rng(6).integers(-(2**63), 2**63, 3000)).mean() < 0.1
