"""The training-data operators against brute force, round trips and held-out accuracy, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("palimpsest.llm")

from palimpsest.llm import common, decontaminate, html_text, language_model, licenses, nearest, ngram_join, packing, quality, substring_dedup, token_ids, token_orc  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **extra):
    """Rows with the columns of documents and columns whose names operators use inside."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for name in ("id", "n", "h", "sha", "posted", "comp", "x", "score", "start", "length", "piece", "word"):
        df = df.withColumn(name, F.lit(7))
    return df


def corpus(seed=3):
    """Texts with copies, near copies, shared passages, repeats, empty and null ones, and a long one."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", "   \n\t ", "one", "One", "two words", "two  words", "é ü 漢字"]
    base = [text(rng.randint(30, 140)) for _ in range(25)]
    texts += base + base[:6] + [base[0].upper()]
    for b in base[:8]:
        for k in (1, 2, 4):
            words = b.split()
            for _ in range(k):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
            texts.append(" ".join(words))
    passage = text(45)
    texts += [f"{text(rng.randint(5, 60))}\n{passage} {text(rng.randint(5, 60))}" for _ in range(20)]
    texts += [text(40) + " " + "again " * 90, text(3000)]
    return texts


TEXTS = corpus()


def word_lists(texts):
    return [WORD.findall(t or "") for t in texts]


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_words_and_rolling():
    col = pa.array([" a  b\x0bc\n", "", "x\xa0y", "\x1c z"], pa.large_string())
    flat, offsets = common.split_words(col)
    assert [flat.to_pylist()[a:b] for a, b in zip(offsets, offsets[1:])] == [WORD.findall(t) for t in col.to_pylist()]
    values = np.array([3, 5, 3, 5, 9], np.uint64)
    h = common.rolling(values, 2, substring_dedup.BASES[0])
    assert h[0] == h[2] and h[0] != h[1] and len(h) == 4 and len(common.rolling(values, 6, 3)) == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 9), (20, 21), (21, 20), (6, 6)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 3, 9: 3, 20: 20, 21: 20}


# --- op1


def test_language_model(spark):
    rows = language_model.score_texts(docs_of(spark, TEXTS)).collect()
    out = {r["doc_id"]: r for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    tokens = {i: WORD.findall(lower(t)) + ["\n"] for i, t in enumerate(TEXTS)}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(TEXTS)
    for i, ws in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert sum(out[i]["score"] for i in tokens if not held[i]) > sum(out[i]["base_score"] for i in tokens if not held[i])


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    model = language_model.Model.start(np.ones(language_model.CLASSES), np.ones(language_model.VOCABULARY))
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    inputs = rng.integers(0, language_model.INPUTS, (3, 2))
    words = rng.integers(0, language_model.VOCABULARY, 6)
    kinds = words // language_model.CLASS_WORDS
    state = np.zeros((2, language_model.HIDDEN))

    def loss():
        h, _ = model.run(inputs, state, False)
        return -model.outputs(h.reshape(-1, language_model.HIDDEN), kinds, words, False)[0].sum()

    h, tape = model.run(inputs, state, True)
    _, g = model.outputs(h.reshape(-1, language_model.HIDDEN), kinds, words, True)
    g |= model.backward(inputs, tape, g.pop("h").reshape(3, 2, -1), np.ones((3, 2)))
    for name, at in (("recur", (1, 2)), ("recur", (3, 40)), ("gate_bias", (35,)), ("class_w", (2, int(kinds[0])))):
        before = model.w[name][at]
        model.w[name][at] = before + 1e-3
        up = loss()
        model.w[name][at] = before - 1e-3
        down = loss()
        model.w[name][at] = before
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=2e-3)


def test_language_model_scores_token_by_token():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    lex = language_model.Lexicon([(w, 3000 - i) for i, w in enumerate(words)] + [("\n", 50)], [("zz", 5, 2), ("yx", 4, 2)] + [("", 0, 0)] * (language_model.TAILS - 1), 10_000, 3100)
    model = language_model.Model.start(lex.class_mass, lex.word_mass)
    model.w = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(np.float32) for k, x in model.w.items()}
    texts = [" ".join(rng.choice([*words[:40], *words[1000:], "uzz", "new"], n)) for n in (0, 1, 7, 60, 300)]
    boxed = lambda x: type("Box", (), {"value": x})
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})
    got = [r for b in language_model._score(boxed(lex), boxed(model.pack()))([batch]) for r in b.to_pylist()]
    w, n = {k: x.astype(float) for k, x in model.w.items()}, language_model.HIDDEN
    share = lambda logits: np.exp(logits) / np.exp(logits).sum()
    counts, own = {**{x: 3000 - i for i, x in enumerate(words)}, "\n": 50}, lex.own
    for text, r in zip(texts, got):
        h, code, total = np.zeros(n), 0, 0.0
        for word in [*text.split(), "\n"]:
            x, a = w["embed"][code] + w["gate_bias"], h @ w["recur"]
            z, gate = 1 / (1 + np.exp(-(x[:n] + a[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + a[n : 2 * n])))
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + gate * a[2 * n :])
            top = share(h @ w["class_w"] + w["class_b"])
            if word in own:
                c, k = divmod(own[word], language_model.CLASS_WORDS)
                p, code = top[c] * share(h @ w["word_w"][c] + w["word_b"][c])[k], own[word]
            else:
                tail = {"zz": 0, "yx": 1}.get(word[-2:], language_model.TAILS)
                p = top[-1] * share(h @ w["tail_w"] + w["tail_b"])[tail] / lex.tail_total[tail]
                p, code = p * (counts.get(word, 0) + 1), language_model.VOCABULARY + tail
            total += np.log10(p)
        assert r["score"] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_language_model_windows_cover_every_token():
    lengths = np.array([1, 17, 8, 3, 40, 1])
    seen = []
    for at, _ in language_model.windows(lengths, 3, 8):
        seen += at[at >= 0].tolist()
    assert sorted(seen) == list(range(lengths.sum()))


def test_language_model_trains_long_texts_in_one_carried_state(monkeypatch):
    assert (language_model.VOCABULARY, language_model.TAILS, language_model.HIDDEN) == (2048, 63, 24)
    starts, real = [], language_model.Learner.step
    monkeypatch.setattr(language_model.Learner, "step", lambda self, *args: (starts.append(args[-1].copy()), real(self, *args))[1])
    monkeypatch.setattr(language_model, "TaskContext", type("Here", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": staticmethod(lambda: 0)}))}))
    lex = language_model.Lexicon([("w", 2000), ("\n", 1)], [("", 0, 0)] * (language_model.TAILS + 1), 2001, 2)
    boxed = lambda x: type("Box", (), {"value": x})
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["w " * 2000]})
    rows = list(language_model._train(boxed(lex), boxed(language_model.Model.start(lex.class_mass, lex.word_mass).pack()))([batch]))
    assert len(rows) == 1 and len(starts) > 1
    assert all(len(x) == 1 and (k == 0 or x.any()) for k, x in enumerate(starts))


def test_language_model_gain_does_not_fall_with_partitions(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    gains = {}
    for parts in (1, 8, 64):
        r = language_model.score_texts(docs.repartition(parts, "doc_id")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        gains[parts] = (r[0] - r[1]) / r[2]
    assert min(gains.values()) > 0.3 and gains[64] > 0.9 * gains[8] and gains[8] > 0.9 * gains[1], gains


def test_language_model_empty(spark):
    assert language_model.score_texts(docs_of(spark, [])).count() == 0
    r = language_model.score_texts(docs_of(spark, [None])).collect()
    assert len(r) == 1 and r[0]["n_tokens"] == 1


# --- op2


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op2_quality_classifier(spark, d)
    labels = common.table(spark, d, "labels").select("doc_id", "quality")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())


def test_quality_odd_tables(spark):
    docs = docs_of(spark, [None, "", "a", "x " * 50_000, "a"])
    none = spark.createDataFrame([], "doc_id long, quality int, n int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 1), (2, None, 1), (3, 5, 1)], "doc_id long, quality int, n int")
    assert {r["predicted"] for r in quality.score_quality(docs, one).collect()} == {1}
    assert quality.score_quality(docs_of(spark, []), one).count() == 0


# --- op3


def by_force(texts, n, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(comp)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and den * len(a & b) >= num * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if before == comp:
            break
    return {i: (len(s), comp[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_ngram_join(spark, n, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs_of(spark, TEXTS), n, num, den).collect()}
    assert got == by_force(TEXTS, n, num, den)


def test_ngram_join_large_lists_in_parts(spark, monkeypatch):
    # small chunks, buckets and parts; most shingles travel beside the blocks
    for name, value in (("DEAL_SHINGLES", 700), ("BUCKET_SHINGLES", 500), ("OWNERS_SENT", 1), ("PAIRS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs_of(spark, TEXTS), 3, 3, 5, group=2, part=2).collect()}
    assert got == by_force(TEXTS, 3, 3, 5)


def test_ngram_join_lists_meet_components_once_and_grow_with_the_input(spark, monkeypatch):
    def rows_of(times):
        seen, plans = {}, {}

        def noted(df, name):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            out = common.stored(df, name)
            seen.setdefault(name, out.count())
            return out

        monkeypatch.setattr(ngram_join, "stored", noted)
        texts = [re.sub(r"(\S+)", rf"\1x{k}", t or "") for k in range(times) for t in TEXTS]
        ngram_join.similar_groups(docs_of(spark, texts), n=3, num=9, den=10).count()
        return seen, plans

    (one, plans), (five, _) = rows_of(1), rows_of(5)
    assert "LeftOuter" in plans["ngram-rooted"] and "LeftOuter" not in plans["ngram-live"]
    assert one["ngram-rooted"] == one["ngram-lists"] > 0
    assert five["ngram-rooted"] < 6 * one["ngram-rooted"]  # of equally rare shingles hashes choose the keys


def test_ngram_join_passage_that_unlike_texts_share(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + " " + passage for _ in range(5000)]
    src = docs_of(spark, texts).select("doc_id", "text")
    assert {r["component_id"] for r in ngram_join.similar_groups(src, 3, 9, 10).collect()} == set(range(5000))
    scan = src.mapInArrow(ngram_join._scan(3), ngram_join.SCAN)
    classes = scan.groupBy(*ngram_join.KEY).agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.col("doc_id"))
    posted = ngram_join._posted(src, scan, classes, 3, 9, 10)
    assert posted.count() == 0  # what they share comes last in the order, so none of them is in a list


def test_ngram_join_repeated_ids_with_other_texts(spark):
    texts = TEXTS[8:30]
    df = docs_of(spark, texts).union(docs_of(spark, texts[3:] + texts[:3]))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, 3, 9, 10).collect())
    force = by_force(texts + texts[3:] + texts[:3], 3, 9, 10)
    least = {}
    for i, (_, c) in force.items():
        least[c] = min(least.get(c, i % len(texts)), i % len(texts))
    assert got == collections.Counter((i % len(texts), n, least[c]) if n else (i % len(texts), 0, i % len(texts)) for i, (n, c) in force.items())


def test_near_duplicate_stage_keeps_rows_by_id_and_text(spark, sf):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(2, a), (5, a + " z"), (5, b), (7, c), (7, None), (8, b + " z"), (9, c), (9, c), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.near_duplicate_stage(spark, docs, sf).collect()), key=repr)
    # a null text is a near copy of nothing, and the smallest of its doc_id
    assert got == sorted([(2, a), (5, b), (7, None), (None, a), (None, None)], key=repr)


def test_ngram_join_groups_that_share_without_linking_are_searched_in_cells(spark, monkeypatch):
    rng = random.Random(11)
    blocks = [" ".join(f"b{k}w{x}" for x in range(12)) for k in range(30)]
    texts = [" ".join(blocks[k] for k in sorted(rng.sample(range(30), 20))) for _ in range(1500)]
    texts += [t + " end" for t in texts[:40]]
    seen = []
    search = ngram_join._compared
    sizes = spark.sparkContext.accumulator(0)

    def compared(rows, cuts, num, den):
        for x, y in zip(cuts, cuts[1:]):
            sizes.add(int(y - x > 2 * 64 + 64))  # hashes deal parts of about 64
        return search(rows, cuts, num, den)

    monkeypatch.setattr(ngram_join, "_compared", compared)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(docs_of(spark, texts), n=3, num=9, den=10, part=64).collect()}
    assert sizes.value == 0 and not seen
    assert [got[1500 + k] for k in range(40)] == [got[k] for k in range(40)]
    assert len(set(got.values())) == len({frozenset(zip(w, w[1:], w[2:])) for w in word_lists(texts[:1500])})


def test_t_occurrence():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randint(1, 50))) for _ in range(rng.randint(1, 12))]
        needed = rng.randint(1, 8)
        count = collections.Counter(x for one in lists for x in one)
        assert sorted(ngram_join.t_occurrence(lists, needed)) == sorted((x, c) for x, c in count.items() if c >= needed)


def test_ngram_join_empty(spark):
    assert ngram_join.similar_groups(docs_of(spark, [])).count() == 0
    assert {r["component_id"] for r in ngram_join.similar_groups(docs_of(spark, [None, "", None])).collect()} == {0, 1, 2}


# --- op4


def edits(a, b):
    """Least edits that turn a into a part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    items = [text(rng.randint(60, 150)) for _ in range(6)] + ["short", None, ""]
    texts = [None, "", "a", text(300)]
    for k in range(30):
        x = list(items[k % 6])
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(x))
            kind = rng.randrange(3)
            x[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice("XYZ")]
        texts.append(text(rng.randint(0, 80)) + "".join(x).upper() + text(rng.randint(0, 80)))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    for size in (1 << 20, 200):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs_of(spark, texts), table, size).collect()}
        want = {}
        for i, t in enumerate(texts):
            for j, x in enumerate(items):
                m = len((x or "").strip())
                if m >= decontaminate.Q and (d := edits(x.strip(), (t or "").lower())) <= decontaminate.edits_allowed(m):
                    want[i, j] = d
        assert got == want
    assert decontaminate.find_leaks(docs_of(spark, texts), table.limit(0)).count() == 0


def test_decontaminate_many_items_times_many_rows(spark):
    # row * len(items) + item goes far beyond 2 ** 23
    rng = random.Random(8)
    items = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)).strip() for _ in range(9000)]
    texts = [f"so {items[(7 * k) % 9000]} it is" if k % 3 else "nothing here" for k in range(3000)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["start"]) for r in decontaminate.find_leaks(docs_of(spark, texts).coalesce(1), table).collect()}
    assert got == {(k, (7 * k) % 9000, 0, 3) for k in range(3000) if k % 3}


def test_decontaminate_thousands_of_items_of_the_corpus_own_words():
    import tracemalloc

    rng = random.Random(3)
    syllables = ["an", "er", "on", "the", "tion", "ing", "re", "nd", "ou", "hat"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(4000)] + ["the", "of", "and"] * 300
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(100, 500))] for _ in range(600)]
    runs = lambda n: [w for _ in range(n) for w in (lambda t, a: t[a : a + 5])(rng.choice(texts), rng.randrange(90))]
    items = [(i, " ".join(runs(8))) for i in range(16_000)]
    planted = {}
    for k in range(0, 600, 4):
        i = rng.randrange(len(items))
        x = items[i][1]
        for _ in range(k % 3):
            at = rng.randrange(len(x))
            x = x[:at] + "#" + x[at + 1 :]
        texts[k] = [*texts[k][:20], x, *texts[k][20:]]
        planted[k, i] = sum(a != b for a, b in zip(x, items[i][1]))
    col = pa.array([" ".join(t) for t in texts], pa.large_string())
    data, edges = quality._bytes_of(col)
    tracemalloc.start()
    known = decontaminate.Items(items)
    found = {(r, i): d for r, i, d, _, _ in known.search(decontaminate.fold(data), edges)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == planted
    assert peak < 1 << 30


def test_decontaminate_long_text_in_stretches_and_hits_in_parts(monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abc def") for _ in range(n))
    items = [(i, x) for i, x in enumerate([text(90), text(40), "ab " * 30, "a" * 50, text(200)])]
    rows = [text(50) + items[0][1] + text(7) + "a" * 400 + items[4][1] + "ab " * 40 + text(90), items[1][1], text(300) + items[4][1], ""]
    col = pa.array(rows, pa.large_string())
    data, edges = quality._bytes_of(col)
    want = list(decontaminate.Items(items).search(data, edges))
    assert {(r, i) for r, i, *_ in want} >= {(0, 0), (0, 2), (0, 3), (0, 4), (1, 1), (2, 4)}
    monkeypatch.setattr(decontaminate, "STRETCH", 100)
    monkeypatch.setattr(decontaminate, "MOST_HITS", 50)
    assert list(decontaminate.Items(items).search(data, edges)) == want


def test_decontaminate_repeated_rows_ties_and_a_very_long_text(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from here"
    texts = [f"{item} and {item}", f"{item} and {item}", "x " * 400_000 + item, "x" * 50]
    table = spark.createDataFrame([(7, item), (8, item), (7, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["start"]) for r in decontaminate.find_leaks(docs_of(spark, texts).union(docs_of(spark, texts[:1])), table).collect())
    # an item that is there twice is found twice; of equal occurrences the first counts
    assert got == sorted([(0, i, 0, 0) for i in (7, 7, 8)] * 2 + [(1, i, 0, 0) for i in (7, 7, 8)] + [(2, i, 0, 800_000) for i in (7, 7, 8)])


# --- op5


def test_licenses(spark):
    mit = "Copyright (c) X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    texts = [None, "", "plain text.", "a.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", mit]
    got = [(r["n_sentences"], r["licenses"]) for r in licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(0, ""), (0, ""), (0, ""), (1, "MIT"), (2, "Apache-2.0,CC-BY-NC-4.0"), (2, "MIT")]
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


ORIGINALS = {
    "MIT": """MIT License

Copyright (c) 2026 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
""",
    "Apache-2.0": """   Copyright 2026 A. Person

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0
""",
    "BSD-2-Clause": """Copyright (c) 2026, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
""",
    "GPL-3.0-or-later": """Copyright (C) 2026  A. Person

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful.
""",
    "GPL-2.0-or-later": """Copyright (C) 2026  A. Person

    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful.
""",
    "ISC": """ISC License

Copyright (c) 2026 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "GPL-3.0-only": "This work is licensed under the GNU General\nPublic License, version 3.\n",
    "CC-BY-NC-4.0": "Licensed under\nCC BY-NC 4.0.\n",
    "CC-BY-4.0": "Licensed under\nCC BY 4.0.\n",
    "CC-BY-SA-4.0": "Licensed under\nCC BY-SA 4.0.\n",
    "CC0-1.0": "Licensed under\nCC0 1.0.\n",
}
ORIGINALS["BSD-3-Clause"] = ORIGINALS["BSD-2-Clause"].replace(
    "THIS SOFTWARE",
    """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""",
)


def gnu(kind, what, version, later, stop=";"):
    end = f"either version {version} of the License, or\n(at your option) any later version." if later else f"version {version} of the License."
    return f"This {what} is free software{stop} you can redistribute it and/or modify\nit under the terms of the {kind} as published by\nthe Free Software Foundation, {end}\n\nIt is distributed in the hope that it will be useful.\n"


GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public\nLicense", "GNU Affero General Public License"
ORIGINALS |= {
    "GPL-2.0-only": gnu(GPL, "program", "2", False), "LGPL-2.1-only": gnu(LGPL, "library", "2.1", False), "LGPL-2.1-or-later": gnu(LGPL, "library", "2.1", True),
    "LGPL-3.0-only": gnu(LGPL, "library", "3", False, ":"), "LGPL-3.0-or-later": gnu(LGPL, "library", "3", True, ":"),
    "AGPL-3.0-only": gnu(AGPL, "program", "3", False, ":"), "AGPL-3.0-or-later": gnu(AGPL, "program", "3", True, ":"),
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.\n",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented.\n",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:\n",
    "BSD-4-Clause": ORIGINALS["BSD-2-Clause"].replace("THIS SOFTWARE", "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the University.\n\nTHIS SOFTWARE"),
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons\nAttribution-NoDerivatives 4.0 International License.\n", "CC-BY-NC-SA-4.0": "// SPDX-License-Identifier: CC-BY-NC-SA-4.0\n",
    "CC-BY-NC-ND-4.0": "# SPDX-License-Identifier: CC-BY-NC-ND-4.0\n",
}


def test_licenses_in_their_original_wrapped_texts(spark):
    assert set(ORIGINALS) == {name for name, _ in licenses.RULES}
    gpl3, gpl2, bsd = ORIGINALS["GPL-3.0-or-later"], ORIGINALS["GPL-2.0-or-later"], ORIGINALS["BSD-3-Clause"]
    more = [("GPL-3.0-or-later", gpl3.replace("Foundation,", "Foundation;")), ("GPL-2.0-or-later", gpl2.replace("Foundation;", "Foundation,")), ("BSD-3-Clause", re.sub(r"(\d)\. ", r"\1) ", bsd)), ("BSD-3-Clause", re.sub(r"\d\. ", "* ", bsd))]
    more += [("BSD-3-Clause", bsd.replace("the copyright holder nor", "the University of Somewhere nor")), ("BSD-2-Clause", ORIGINALS["BSD-2-Clause"].replace("2. Redist", "An unknown sentence. Another one.\n\n2. Redist"))]
    more += [("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"), ("", "the licence of permission, free software")]
    cases = [*ORIGINALS.items(), *more]
    got = [r["licenses"] for r in licenses.scan_licenses(docs_of(spark, [t for _, t in cases])).orderBy("doc_id").collect()]
    assert got == [n for n, _ in cases]


# --- op6


def cut_by_force(texts, n):
    lists = word_lists(texts)
    count = collections.Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = {}
    for k, w in enumerate(lists):
        gone = {j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_first_least():
    rng = np.random.default_rng(2)
    for span in (1, 2, 3, 7, 8, 28):
        x = rng.integers(0, 9, 60).astype(np.uint64)
        assert substring_dedup._first_least(x, span).tolist() == [i + int(x[i : i + span].argmin()) for i in range(61 - span)]


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup(spark, window):
    summary, cut = substring_dedup.remove_repeats(docs_of(spark, TEXTS), window)
    want = cut_by_force(TEXTS, window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in summary.collect()} == want
    texts = {r["doc_id"]: r["kept_text"] for r in cut.collect()}
    assert set(texts) == {i for i, x in want.items() if x[1]}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][2] for i, t in texts.items())


def test_substring_dedup_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_ROWS", 1)  # every repeated run is dealt to parts
    summary, _ = substring_dedup.remove_repeats(docs_of(spark, TEXTS), 12)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in summary.collect()} == cut_by_force(TEXTS, 12)


def test_substring_dedup_empty(spark):
    summary, cut = substring_dedup.remove_repeats(docs_of(spark, []))
    assert summary.count() == 0 and cut.count() == 0


# --- op7


def test_html_blocks():
    page = (
        "<html><head><title>T</title></head><body><header class='site-header'>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies.</div><aside>Side words here.</aside><article><h1>A &amp; B</h1><p>First&nbsp;one <b>bold</b>\n text.<p>Second &lt;p&gt;."
        "<div class=ad>Buy now.</div><p>Third.</p></article><section id='comments'><p>Nice post, thank you very much indeed.</p></section><form>Mail</form>"
        "<script>var a='<p>no</p>'</script><footer>&copy; me</footer></body></html>"
    )
    assert html_text.main_text(page) == "A & B\n\nFirst one bold text.\n\nSecond <p>.\n\nThird."
    assert html_text.main_text("") == "" and html_text.main_text("<<a<<") is not None and html_text.main_text("<p") == ""


def test_html_the_cut_decides_between_neighbours():
    long = "A rather long paragraph of text with many words in it, so that it is the main part of this page."
    page = f"<div><p>{long}</p><p>Yes.</p><p>{long}</p><p><a href=x>See this other page for more</a></p><p>{long}</p></div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
    blocks = html_text.blocks_of(page)
    alone = [html_text.preference(b) > 0 for b in blocks]
    assert alone == [True, False, True, False, True, False, False]
    assert html_text.main_text(page) == f"{long}\n\nYes.\n\n{long}\n\nSee this other page for more\n\n{long}"


def test_html_names_count_as_wholes():
    text = "Words that make a sentence of the article, and more of them."
    for kept in ("content-with-sidebar", "side-effects", "meta-analysis", "page", "shared-memory"):
        assert html_text.main_text(f'<div class="{kept}"><p>{text}</p></div>') == text
    for gone in ("sidebar", "site-footer", "promoBox", "ad-slot2 wide", "main-nav"):
        assert html_text.main_text(f'<article><p>{text}</p></article><div class="{gone}"><p>{text}</p></div>') == text
    assert html_text.main_text(f"<article><p>{text}</p><p><math>x = 1</math></p></article>") == f"{text}\n\nx = 1"


def test_html_deep_long_and_broken_pages():
    page = "<div>" * 20_000 + "<option>" * 3000 + "<p>y</b></i> and some words that make it long enough to stay here." * 20_000
    assert html_text.main_text(page).count("y and some words") == 20_000


def test_html_unclosed_quotes_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<x " * 200_000 + '"', "<x '\" " * 100_000, "<p class='a>" * 50_000 + "<i title=\"" * 50_000):
        html_text.main_text(page)
    assert time.process_time() - began < 10
    assert html_text.main_text("<p title=\"a > b\">Text of some length that stays, as it is all there is.</p>") == "Text of some length that stays, as it is all there is."
    assert html_text.main_text("<p title=\"a>Text of some length that stays, as it is all there is.</p>") == "Text of some length that stays, as it is all there is."


def test_html_weights_are_fitted_to_marked_pages(spark):
    """Marks held out: the fitted classifier errs less than the one it starts from, and the cut mends most of what is left."""
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    weights = html_text.fit_weights(pages.where("page_id % 2 = 0"))
    start = list(html_text.WEIGHTS.values())
    assert weights != start and weights[-html_text.MARKS :] == start[-html_text.MARKS :]
    assert html_text.fit_weights(pages.withColumn("html", F.lit("<p>no marks</p>"))) == start == html_text.fit_weights(pages.where("false"))
    errors = {}
    for name, w in (("start", start), ("fitted", weights)):
        w = [*w[: -html_text.MARKS], 0, 0]
        alone = cut = n = 0
        for r in pages.where("page_id % 2 = 1").collect():
            blocks = html_text.blocks_of(r["html"])
            labels = [b.what[2] and not b.what[0] for b in blocks]
            prefer = [html_text.preference(b, w) for b in blocks]
            kept = html_text.minimum_cut(prefer, html_text.edges_of(blocks))
            alone += sum((p > 0) != x for p, x in zip(prefer, labels))
            cut += sum(k != x for k, x in zip(kept, labels))
            n += len(blocks)
        errors[name] = (alone, cut, n)
    assert errors["fitted"][0] < errors["start"][0] and errors["start"][1] < 0.6 * errors["start"][0] and errors["fitted"][1] <= errors["fitted"][0]


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 9)
        prefer = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        cost = lambda x: sum(max(p, 0) if not k else max(-p, 0) for p, k in zip(prefer, x)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(prefer, edges)) == pytest.approx(best)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Some text that is long enough to be the article of this page.</p>"), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_text.extract_text(pages).collect()
    assert len(rows) == 4 and all(r["n_chars"] == len(r["text"]) for r in rows) and sum(r["n_chars"] > 0 for r in rows) == 1


# --- op8


def test_nearest_recall_and_odd_vectors(spark):
    d = "/root/testdata/sf0.01"
    got = nearest.op8_nearest(spark, d).collect()
    rows = common.table(spark, d, "embeddings").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found, total = collections.defaultdict(set), 0
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -2
        hits += len({int(i) for i in ids[np.argsort(-s, kind="stable")[:5]]} & found[int(ids[q])])
        total += 5
    assert hits / total >= 0.9


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_nearest_recall_at_every_depth(spark, depth):
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    got = nearest.search(rows, F.col("vec_id") % 50 == 0, depth=depth).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect()
    table = rows.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for r in got:
        s = np.where(ids == r["query_id"], -2, unit @ unit[ids == r["query_id"]][0])
        hits += len({int(i) for i in ids[np.argsort(-s, kind="stable")[:5]]} & set(r["found"]))
    assert len(got) == 40 and hits >= 0.9 * 5 * len(got)


def test_nearest_compares_a_falling_share():
    rng = np.random.default_rng(3)
    shares, recalls = [], []
    for n in (2000, 20_000):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        depth, asked = nearest.depth_for(n), np.arange(40)
        s = x[asked] @ x.T
        s[asked, asked] = -2
        want = np.argsort(-s, axis=1)[:, :5]
        seen = np.zeros((40, n), bool)
        for t in range(nearest.TABLES * depth):
            have, probes = nearest.joined_axes(x, t, depth, 1)[:, 0], nearest.joined_axes(x[asked], t, depth, nearest.probes_for(depth))
            for i in range(40):
                seen[i] |= np.isin(have, probes[i])
        shares.append(seen.mean())
        recalls.append(np.mean([seen[i, want[i]].mean() for i in range(40)]))
    assert min(recalls) >= 0.9 and shares[0] < 0.55 and shares[1] < 0.25


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_nearest_finds_what_its_probes_hold(spark, depth, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 16)  # axes in several chunks of vectors and of queries
    rng = np.random.default_rng(depth)
    x = rng.standard_normal((300, 16)).astype(np.float32).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest.search(df.union(df), F.col("vec_id") % 3 == 0, 3, depth).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    x = x.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 3):
        seen = np.zeros(300, bool)
        for t in range(nearest.TABLES * depth):
            seen |= np.isin(nearest.joined_axes(unit, t, depth, 1)[:, 0], nearest.joined_axes(unit[q : q + 1], t, depth, nearest.probes_for(depth))[0])
        seen[q] = False
        at = np.flatnonzero(seen)
        if len(at) > 3:
            s = unit[at] @ unit[q]
            best = np.lexsort((at, -s.round(12)))[:3]
            assert got[q] == [(int(at[i]), round(float(s[i]), 9)) for i in best]
        assert len(got[q]) == 3


def test_nearest_exact_where_few(spark):
    nan = float("nan")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (50, [1.0, 1.0]), (100, [1.0, 0.0, 0.0]), (8, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("x", F.lit(2))
    rows = nearest.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 3, 50, 2], 50: [0, 1, 2, 3]}
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0


# --- op9 and op10


def test_encoding_is_that_of_the_library():
    rng = random.Random(1)
    signs = [*"ab c\n\n  \t'sé　ñ1!\x85\r漢\xa0", " the", "'ll", " \n", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + [t or "" for t in TEXTS]
    ids, offsets = token_ids.encode_texts(pa.array(texts, pa.large_string()))
    tok = token_ids.tokenizer(token_ids.TOKENIZER)
    for i, x in enumerate(tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == x.ids


def test_encoding_knows_a_word_whatever_marks_follow(monkeypatch):
    rng = random.Random(2)
    signs = [*"aZé×ñ1 .,!&$'-_\"漢\n\u0301\u0640", "'s", "don't", "word", "<|endoftext|>", "a'", "'ll."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [f"a {word}{mark} a" for word in ("cider", "ELM") for mark in ("", ".", ",", "!!", "&&&")]
    fresh = token_ids.Known(token_ids.TOKENIZER)
    monkeypatch.setattr(token_ids, "known", lambda name: fresh)
    seen = []
    monkeypatch.setattr(token_ids, "_encode", lambda pieces, tok, f=token_ids._encode: (seen.extend(pieces), f(pieces, tok))[1])
    ids, offsets = token_ids.encode_texts(pa.array(texts, pa.large_string()))
    for i, x in enumerate(fresh.tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == x.ids
    assert [x for x in seen if "cider" in x] == [" cider"] and len(seen) == len(set(seen))
    again, _ = token_ids.encode_texts(pa.array(texts, pa.large_string()))
    assert (again == ids).all()


def expected_ids(end):
    tok = token_ids.tokenizer(token_ids.TOKENIZER)
    return [[*x.ids, end] for x in tok.encode_batch_fast([t or "" for t in TEXTS], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_orc(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_orc.write_token_orc(docs_of(spark, TEXTS).orderBy(F.desc("doc_id")), path)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_orc.token_rows(spark, path).collect()}
    at, want = 0, {}
    for i, ids in enumerate(expected_ids(2)):
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want
    one = token_orc.read_token_orc(spark, path).where("doc_id = 9")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in one._jdf.queryExecution().toString() and one.first()["ids"] == expected_ids(2)[9]
    token_orc.write_token_orc(docs_of(spark, []), f"file://{tmp_path}/none")
    assert token_orc.token_rows(spark, f"file://{tmp_path}/none").count() == 0


def test_packing(spark):
    rows = packing.pack(packing.cut_pieces(docs_of(spark, TEXTS)), shard=50).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    for i, ids in enumerate(expected_ids(0)):
        at = 0
        for k in range(-(-len(ids) // 2048)):
            r = pieces.pop((i, k))
            assert r["start"] == at and r["length"] <= 2048 and (k == 0 or r["length"] == 2048) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) + 3
    assert packing.pack(packing.cut_pieces(docs_of(spark, []))).count() == 0


def test_genetic_packing_beats_best_fit():
    rng = np.random.default_rng(5)
    lengths = []
    for _ in range(40):  # forty full bins of three pieces, which best-fit breaks up
        a = int(rng.integers(780, 1000))
        b = int(rng.integers(513, (2048 - a) // 2 + 1))
        lengths += [a, b, 2048 - a - b]
    length = np.sort(lengths)[::-1].copy()
    plain = packing._fresh(length, 2048, rng, 0.0)
    best = packing.evolve(length, 2048, 7, [])[0]
    assert np.bincount(best, weights=length).max() <= 2048 and len(best) == 120
    assert plain.max() + 1 >= 45 and best.max() + 1 <= 42


@pytest.mark.parametrize("n", [250, 1000, 4000])
def test_genetic_packing_gains_at_every_size(n):
    rng = np.random.default_rng(n)
    length = np.sort(rng.integers(410, 1024, n))[::-1].copy()
    first = packing.evolve(length, packing.CAPACITY, 1, [])
    again = packing.evolve(length, packing.CAPACITY, 2, first[:2])
    bins = [int(x.max()) + 1 for x in (packing._fresh(length, packing.CAPACITY, rng, 0.0), again[0])]
    assert bins[0] - bins[1] >= 0.5 * (bins[0] - packing.least_bins(length, packing.CAPACITY))


def test_least_bins():
    rng = random.Random(6)
    assert packing.least_bins(np.array([], np.int64), 10) == 0 and packing.least_bins(np.array([6, 6, 6]), 10) == 3
    for _ in range(60):
        x = [rng.randint(1, 10) for _ in range(rng.randint(1, 7))]
        bins = lambda left, room: 0 if not left else min([1 + bins(left[1:], [*room, 10 - left[0]])] + [bins(left[1:], room[:k] + [r - left[0]] + room[k + 1 :]) for k, r in enumerate(room) if r >= left[0]])  # noqa: B023, E731
        assert packing.least_bins(np.array(x), 10) <= bins(x, [])


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(4)
    length = rng.integers(1, 900, 300)
    a, b = (packing._fresh(length, 2048, rng, 0.3) for _ in range(2))
    child = packing.crossover(a, b, length, 2048, rng)
    assert len(child) == 300 and np.bincount(child, weights=length).max() <= 2048 and (np.bincount(child) > 0).all()


# --- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    kept = docs
    for (_, stage), check in zip(corpus_pipeline.STAGES[:4], (None, "near", "cut", "leaks")):
        before = kept.orderBy("doc_id").collect()
        kept = common.stored(stage(spark, kept, sf), "test-stage")
        assert kept.columns == columns
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        ids = [r["doc_id"] for r in before]
        texts = [r["text"] for r in before]
        if check == "near":
            force = by_force(texts, 5, 4, 5)
            assert set(after) == {ids[i] for i, (_, c) in force.items() if c == i}
        elif check == "cut":
            for i, x in cut_by_force(texts, 35).items():
                left = after.get(ids[i])
                assert (left is None) == (x[1] > 0 and x[1] == x[0])
                assert left is None or hashlib.sha256(" ".join(WORD.findall(left)).encode()).hexdigest() == x[2]
        elif check == "leaks":
            items = [" ".join(r["text"].lower().split()) for r in common.table(spark, sf, "benchmark").collect()]
            assert not any(x in " ".join(t.lower().split()) for t in after.values() for x in items)
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)


# --- repeated rows


def repeated(spark, texts, times=2):
    df = docs_of(spark, texts)
    for _ in range(times - 1):
        df = df.union(docs_of(spark, texts))
    return df


def test_language_model_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HOT", 20)  # most words come by the join
    rows = language_model.score_texts(repeated(spark, TEXTS[8:20])).collect()
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == 24 and all(len(x) == 2 for x in out.values())
    tokens = [WORD.findall(lower(t)) + ["\n"] for t in TEXTS[8:20]]
    c = collections.Counter(w for i, ws in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = 2 * sum(c.values()), len(c)
    for i, ws in enumerate(tokens):
        for r in out[i]:
            assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(c[w] > 0 for w in ws))
            assert r["base_score"] == pytest.approx(sum(np.log10((2 * c[w] + 1) / (n + v + 1)) for w in ws))


def test_substring_dedup_repeated_rows(spark):
    texts = TEXTS[:12] + TEXTS[-8:]
    summary, cut = substring_dedup.remove_repeats(repeated(spark, texts, 3))
    want = cut_by_force(texts * 3, 35)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in summary.collect())
    assert got == sorted((i % len(texts), *x) for i, x in want.items())
    stage = substring_dedup.substring_stage(spark, repeated(spark, texts, 3), "").collect()
    left = [i % len(texts) for i, x in want.items() if not (x[1] and x[1] == x[0])]
    assert sorted(r["doc_id"] for r in stage) == sorted(left)


def test_packing_repeated_rows(spark):
    rows = packing.pack(packing.cut_pieces(repeated(spark, TEXTS, 3)), shard=50).collect()
    once = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.cut_pieces(docs_of(spark, TEXTS)).collect()]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(once * 3)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_with_repeated_rows(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())
    near = ids(stages["n-gram Jaccard join"](spark, docs.union(docs), sf))
    assert near == ids(stages["n-gram Jaccard join"](spark, docs, sf)) and set(near.values()) == {1}
    leaks = stages["benchmark decontamination"]
    assert ids(leaks(spark, docs.union(docs), sf)) == {i: 2 * n for i, n in ids(leaks(spark, docs, sf)).items()}
    good = stages["quality classifier"](spark, docs.union(docs), sf)
    assert set(ids(good).values()) == {2}


def test_stages_with_odd_tables(spark, sf):
    import corpus_pipeline

    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    texts = [None, "", "  \n", "one", long, "The quick fox, a rather plain text of its own. " * 3]
    odd = docs_of(spark, texts).union(docs_of(spark, ["nobody's text"]).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        rows = got.collect()
        if name == "best-fit packing":
            assert {r["doc_id"] for r in rows} == set(range(len(texts)))
        else:
            assert got.columns == odd.columns and None in {r["doc_id"] for r in rows}
            if name != "quality classifier":
                assert {r["doc_id"]: r["text"] for r in rows} == {**dict(enumerate(texts)), None: "nobody's text"}
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_token_orc_stripes_indexes_and_bloom_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 1 << 16)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(30_000)]
    path = f"file://{tmp_path}/ids"
    token_orc.write_token_orc(docs_of(spark, texts).select("doc_id", "text"), path)
    orc, stripes, blooms, indexes = spark._jvm.org.apache.orc, 0, 0, 0
    conf = spark._jsc.hadoopConfiguration()
    for file in (tmp_path / "ids").glob("*.orc"):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"file://{file}"), orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for k in range(reader.getStripes().size()):
            kinds = [str(s.getKind()) for s in rows.readStripeFooter(reader.getStripes().get(k)).getStreamsList()]
            stripes, blooms, indexes = stripes + 1, blooms + any("BLOOM" in x for x in kinds), indexes + kinds.count("ROW_INDEX")
        assert reader.getRowIndexStride() == token_orc.ROW_STRIDE
    assert stripes > len(list((tmp_path / "ids").glob("*.orc"))) and blooms == stripes and indexes > stripes
