"""Tokeniser fertility, periodic runs and hard negatives against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("palimpsest.llm")

from palimpsest.llm import common, fertility, hard_negatives, periodic_runs, token_ids  # noqa: E402

from test_llm import TEXTS, WORD, docs_of  # noqa: E402

# --- op11


def plain_rules(text, lang):
    """The same definitions, one text at a time, encoded by the libraries without a cache."""
    words = WORD.findall(text or "")
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    bad = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    tok = token_ids.tokenizer(fertility.BYTES)
    ids = [i for w in words for i in tok.encode(" " + w, add_special_tokens=False).ids]
    model, is_byte, _ = fertility.pieces(fertility.PIECES)
    cut = [i for w in words for i in model.encode(w)]
    n = max(len(ids), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) or 0.0
    per_token, fallback = sum(map(len, words)) / n, sum(bool(is_byte[i]) for i in cut) / max(len(cut), 1)
    letters = Counter(s for w in words for ch in w for a, b, s in fertility.SCRIPTS if a <= ord(ch) < b)
    script = next(s for _, _, s in fertility.SCRIPTS if letters[s] == max(letters.values())) if letters else "other"
    band = fertility.band_of(lang, script, fertility.BANDS)
    least = band.entropy + 0.5 * math.log2(min(n, 512))
    good = band.least <= per_token <= band.most and fallback <= band.fallback and entropy >= least - 1e-9
    counts = (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(covered))
    return *counts, bad, not bad and good, script, len(ids), per_token, fallback, entropy


def test_fertility_against_the_libraries(spark):
    rng = random.Random(2)
    prose = "Зимой снег лежал на полях и лес молчал под тяжёлым небом а река шла подо льдом к морю".split()
    odd = [
        " ".join(rng.choice(prose) + rng.choice(["", "ся", "."]) for _ in range(120)), "漢字かな交じり文 " * 70, " ".join(chr(0x1F600 + rng.randrange(60)) * 3 for _ in range(80)),
        " ".join(chr(0x1200 + rng.randrange(300)) * 4 for _ in range(90)), "## $$ %% | <a> " * 60 + "\nline\nline\r\nline\n \n \nline", "1234 5678 90 " * 40, "x" * 100_000,
        " ".join(str(rng.random()) for _ in range(200)), "aa bb cc aa bb cc dd", "aa bb aa bb aa", "\x1c \x0b\x0c", "café " * 60,
    ]
    texts = [*TEXTS, *odd, *odd[:2]]
    got = {r["doc_id"]: r for r in fertility.fertility_rules(docs_of(spark, texts), F.col("lang")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want, r = plain_rules(text, "en"), got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "n_tokens")) == want[:9], (i, text and text[:60])
        assert (r["chars_per_token"], r["fallback_share"], r["token_entropy"]) == pytest.approx(want[9:], abs=1e-9)
        assert (r["reason"] is None) == r["kept"]


def test_fertility_bands_reject():
    bands = fertility.BANDS
    assert fertility.band_of("en", "latin", bands) == bands["en"] and fertility.band_of("en", "cyrillic", bands) == bands["cyrillic"]
    assert fertility.band_of(None, "latin", bands) == bands["latin"] and fertility.band_of("xx", "thai", bands) == bands["other"]
    band = fertility.Band(1.0, 5.0, 0.1, 1.5)
    assert [fertility.verdict(band, *x) for x in ((0.9, 0, 9, 100), (5.1, 0, 9, 100), (2, 0.2, 9, 100), (2, 0, 5.9, 1000), (1.0, 0.1, 6.0, 1000), (5.0, 0.0, 1.5, 0))] == [
        "few characters per token", "many characters per token", "byte fallback", "token entropy", None, None,
    ]


def test_fertility_tells_labelled_junk_from_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = fertility.op11_tokenizer_fertility(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n[1, True] > 200
    assert n[0, False] >= n.get((0, True), 0) / 2


def test_fertility_runs_of_many_words_are_numbered_anew(monkeypatch):
    code = np.array([0, 1, 2, 9, 0, 1, 2, 3, 0, 1, 2], np.int64)
    for size in (10, 1 << 40):
        assert fertility.repeated_run_words(code, size, np.array([0, 7, 11])).tolist() == [6, 0]


def test_fertility_odd_tables(spark):
    empty = fertility.fertility_rules(docs_of(spark, ["x"]).where("false"))
    assert empty.count() == 0 and empty.schema == fertility.fertility_rules(docs_of(spark, ["x"])).schema
    null_id = docs_of(spark, ["word " * 60, None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text_", F.lit(1))
    rows = fertility.fertility_rules(null_id.union(null_id)).collect()
    assert sorted((r["n_words"], r["kept"]) for r in rows) == [(0, False)] * 2 + [(60, False)] * 2


# --- op12


def plain_runs(words):
    """Every lag, every stretch; of stretches that several lags give, the smallest lag stays."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(key, text, tails):
    words = WORD.findall(text or "")
    n = len(words)
    if tails and key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in drop))


def periodic_texts():
    rng = random.Random(8)
    texts = list(TEXTS)
    for _ in range(400):
        v, n = rng.choice([1, 2, 3, 6, 40]), rng.randint(0, 90)
        words = [f"v{rng.randrange(v)}" for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            p, s, m = rng.randint(1, 9), rng.randint(0, max(n - 1, 0)), rng.randint(0, 60)
            for i in range(s + p, min(n, s + m)):
                words[i] = words[i - p]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    unit = " ".join(f"u{i}" for i in range(700))
    return [*texts, f"start {unit} {unit} {unit} {unit} end", f"start {unit} {unit} {unit} u0 end", "same " * 5000, "a b " * 7 + "a a a a a a", "a\xa0a " * 8]


@pytest.mark.parametrize("tails", [False, True])
def test_periodic_runs(spark, tails):
    texts = periodic_texts()
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs_of(spark, texts), tails).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert tuple(got[i])[1:8] == plain_row(i, text, tails), (i, text and text[:80])


def test_frequent_segments_split_until_stable():
    words = np.array([ord(c) for c in "abababab" + "x" + "cdcdcdcd" + "y" + "abcdefgh"], np.int64)
    begin, end = periodic_runs.frequent_segments(words, np.array([0, len(words)]))
    assert sorted(zip(begin.tolist(), end.tolist())) == [(0, 8), (9, 17)]
    # a word that is frequent in the whole is rare in the pieces, which splits them in a second pass
    words = np.array([ord(c) for c in "aaaaaaaa" + "b" + "cccccccc" + "z" + "dddddddd" + "b" + "eeeeeeee" + "y" + "b" + "ffffffff" + "b"], np.int64)
    begin, end = periodic_runs.frequent_segments(words, np.array([0, len(words)]))
    assert len(begin) == 5 and all(e - b == 8 for b, e in zip(begin, end))


def test_lag_scan_of_long_periodic_texts_is_fast():
    import time

    began = time.process_time()
    for code in (np.zeros(300_000, np.int64), np.arange(300_000) % 7777, np.random.default_rng(0).integers(0, 2, 300_000)):
        runs = periodic_runs.scan_lags(code, *periodic_runs.frequent_segments(code, np.array([0, len(code)])))
        assert runs
    assert time.process_time() - began < 60  # every lag at every place would be 10^10 comparisons each


def test_scan_without_splitting_is_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    code = np.concatenate([rng.integers(0, 30, 300), np.tile(rng.integers(0, 30, 11), 6), rng.integers(0, 30, 200)])
    offsets = np.array([0, len(code)])
    want = sorted(periodic_runs.scan_lags(code, *periodic_runs.frequent_segments(code, offsets)))
    monkeypatch.setattr(periodic_runs, "MOST_PASSES", 0)
    assert sorted(periodic_runs.scan_lags(code, *periodic_runs.frequent_segments(code, offsets))) == want != []
    monkeypatch.setattr(periodic_runs, "SLICE", 50)
    assert sorted(periodic_runs.scan_lags(code, *periodic_runs.frequent_segments(code, offsets))) == want


def test_periodic_runs_odd_tables(spark):
    assert periodic_runs.periodic_runs(docs_of(spark, ["x"]).where("false"), True).count() == 0
    rows = docs_of(spark, ["a b " * 10, None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("start", F.lit("z"))
    got = sorted((r["n_runs"], r["n_words"], r["n_dropped"]) for r in periodic_runs.periodic_runs(rows.union(rows), True).collect())
    assert got == [(0, 0, 0)] * 2 + [(1, 20, 18)] * 2


# --- op13


def plain_negatives(rows, is_anchor):
    usable = {}
    for i, label, x in sorted((r for r in rows if None not in r and all(v is not None and math.isfinite(v) for v in r[2])), key=lambda r: (r[0], r[2], r[1])):
        usable.setdefault(i, (label, [int(v) for v in x]))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in filter(is_anchor, usable):
        la, xa = usable[a]
        others = sorted((-dot(xa, x), i, label == la) for i, (label, x) in usable.items() if i != a and len(x) == len(xa))
        for minus, p, _ in [o for o in others if o[2]][:5]:
            ps = -minus
            good = [(i, -m) for m, i, same in others if not same and 80 * ps <= -100 * m <= 100 * ps][:5]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(good)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, x array<double>").withColumn("id", F.lit("q")).withColumn("score", F.lit(1.5)).withColumn("block", F.lit(0))


@pytest.mark.parametrize("block, chunk", [(2048, 2048), (3, 17)])
def test_hard_negatives(spark, block, chunk):
    rng = np.random.default_rng(1)
    base = rng.integers(-40, 40, (12, 6))
    rows = [(i, int(rng.integers(0, 4)), [float(v) for v in base[rng.integers(0, 12)] + rng.integers(-3, 4, 6) * int(rng.integers(0, 2))]) for i in range(240)]
    rows += [(1000, 1, [0.0] * 6), (1007, 2, [0.0] * 6), (1010, 1, [3.0, 4.0]), (1011, 2, [3.0, 4.0]), (1012, 1, [3.0, 4.0]), (1020, 9, [1.0] * 6)]
    rows += [(None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2010, 1, None), (2020, 1, [math.nan] * 6), (2030, 1, [math.inf] + [1.0] * 5), (2040, 1, [None] + [1.0] * 5)]
    rows += [rows[3], (10, 3, [9.0] * 6), rows[20]]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, block=block, chunk=chunk).collect())
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and len(got) > 200


def test_hard_negatives_of_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(int(v)) for v in rng.integers(-(2**29), 2**29, 4)]) for i in range(60)]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, chunk=20).collect())
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) != []


def test_hard_negatives_empty(spark):
    some = vectors_of(spark, [(5, 1, [1.0]), (7, 2, [1.0])])
    for rows in (some, some.where("false")):
        out = hard_negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0


def test_spanning_tree_is_least_and_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (40, 5)).astype(float)
    x[7] = x[3]
    order, parent, edge = hard_negatives.spanning_tree(x)
    assert sorted(order.tolist()) == list(range(40)) and (parent[1:] < np.arange(1, 40)).all()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    left, total = set(range(1, 40)), 0.0  # Kruskal's total by Prim's cut rule, plainly
    inside = {0}
    while left:
        d, j = min((far[i, j], j) for i in inside for j in left)
        total += d
        inside.add(j)
        left.remove(j)
    assert edge.sum() == pytest.approx(total, rel=1e-6)
    rows = rng.integers(-20, 20, (300, 5)).astype(float)
    seen = []

    def wanted(v, low, high):
        s = rows @ x[order][v]
        assert (low <= s).all() and (s <= high).all()
        seen.append(v)
        return s > 250

    for v, at, s in hard_negatives.walk(x[order], parent, edge, rows, wanted):
        assert (s == rows[at] @ x[order][v]).all() and set(at.tolist()) == set(np.flatnonzero(rows @ x[order][v] > 250).tolist())
    assert len(seen) >= 40


def test_tree_bounds_spare_scores_where_anchors_lie_close():
    rng = np.random.default_rng(6)
    centre = rng.normal(0, 40, (4, 16))
    anchors = np.rint(centre[np.repeat(np.arange(4), 25)] + rng.normal(0, 1, (100, 16)))
    rows = np.rint(centre[rng.integers(0, 4, 4000)] + rng.normal(0, 12, (4000, 16)))
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    scored = []

    def wanted(v, low, high):
        mask = high >= hard_negatives._kth_largest(low, 5)
        scored.append(int(mask.sum()))
        return mask

    for v, at, s in hard_negatives.walk(anchors[order], parent, edge, rows, wanted):
        every = rows @ anchors[order][v]
        assert set(np.argsort(-every, kind="stable")[:5].tolist()) <= set(at.tolist()) or len(set(np.sort(every)[-6:])) < 6
    assert sum(scored) < 0.5 * 100 * 4000


def test_whole_components(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1.0 / 256, -1.0, 1e30],)], "x array<float>")
    assert df.select(hard_negatives.whole(F.col("x")).alias("x")).first()["x"] == [128.0, -1.0, 1.0, -256.0, 256 * float(np.float32(1e30))]
