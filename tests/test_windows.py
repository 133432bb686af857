"""Common runs, subsequences, windows between correlated runs, and promotion of skipped-ahead lines."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diff, sequences, similarity, windows
from palimpsest.sources.tables import hashed_lines


def test_heaviest_run_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 12))] for _ in range(2))
        weight, upto = {k: rng.randint(1, 4) for k in range(4)}, [0]
        for x in a:
            upto.append(upto[-1] + weight[x])
        i0, j0 = rng.randint(0, len(a)), rng.randint(0, len(b))
        i1, j1 = rng.randint(i0, len(a)), rng.randint(j0, len(b))
        best = (0, 0, 0, 0)
        for i in range(i0, i1):
            for j in range(j0, j1):
                n = 0
                while i + n < i1 and j + n < j1 and a[i + n] == b[j + n]:
                    n += 1
                if upto[i + n] - upto[i] > best[3]:
                    best = (i, j, n, upto[i + n] - upto[i])
        assert sequences._by_places(a, b, upto, i0, i1, j0, j1) == best == sequences._by_automaton(a, b, upto, i0, i1, j0, j1)


def test_repeated_words_cost_no_more_than_others():
    began = time.process_time()
    assert diff.richest_run(["word"] * 4000, ["word"] * 4000) == (0, 0, 4000)
    assert diff.longest_run(["x", "y"] * 4000, ["y", "x"] * 4000) == (0, 1, 7999)
    assert time.process_time() - began < 0.5


def table_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@pytest.mark.parametrize("kept", [1, 3, 512])
def test_subsequence_against_the_table(kept, monkeypatch):
    monkeypatch.setattr(sequences, "ROWS_KEPT", kept)
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("wxyz") for _ in range(rng.randint(0, 18))] for _ in range(2))
        assert sequences.subsequence(a, b) == table_lcs(a, b)
        assert sequences.subsequence(a, b, gone_first=False) == [(i, j) for j, i in table_lcs(b, a)]


def test_subsequence_of_ten_thousand_rows():
    rng = random.Random(5)
    a, b = ([rng.randrange(300) for _ in range(10_000)] for _ in range(2))
    tracemalloc.start()
    began = time.process_time()
    met = sequences.subsequence(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.process_time() - began < 20 and peak < 100 << 20
    assert all(a[i] == b[j] for i, j in met) and all(p < q for x, y in zip(met, met[1:]) for p, q in zip(x, y))


def test_gates_of_correlated_runs():
    few = lambda a, b: diff.Units(a, b).correlated(0, len(a), 0, len(b))
    pad, other = ["p", "q"], ["r", "s"]
    assert few(["x" * 15, *pad], ["x" * 15, *other]) == (0, 0, 0)  # 16 characters with the mark
    assert few(["x" * 16, *pad], ["x" * 16, *other]) == (0, 0, 1)
    assert few(["x" * 16, "p"], ["x" * 16, "r"]) == (0, 0, 0)  # both sides need three lines
    assert few(["x" * 15, "y" * 15, *pad], ["x" * 15, "y" * 15, *other]) == (0, 0, 0)
    assert few(["x" * 15, "y" * 16, *pad], ["x" * 15, "y" * 16, *other]) == (0, 0, 2)
    assert few([*"abcd", "p"], [*"abcd", "r"]) == (0, 0, 4)
    assert few(["a" * 20, "n", "b" * 20, "m"], ["b" * 20, "a" * 20, "k"]) == (0, 1, 1)  # of equal ones the first


def plain_windows(a, b):
    """The same recursion over every pair of starts."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i0, i1, j0, j1 = work.pop()
        best = (0, 0, 0, 0)
        if min(i1 - i0, j1 - j0) >= 3:
            for i in range(i0, i1):
                for j in range(j0, j1):
                    n = 0
                    while i + n < i1 and j + n < j1 and a[i + n] == b[j + n]:
                        n += 1
                    atoms = sum(len(x) + 1 for x in a[i : i + n])
                    if atoms > best[0]:
                        best = (atoms, i, j, n)
        atoms, i, j, n = best
        if n > 3 or n > 1 and atoms > 32 or n == 1 and atoms > 16:
            out.append((i, i + n, j, j + n, True))
            work += [w for w in ((i0, i, j0, j), (i + n, i1, j + n, j1)) if w[0] < w[1] or w[2] < w[3]]
        else:
            out.append((i0, i1, j0, j1, False))
    return sorted(out)


def random_docs(seed, n):
    rng = random.Random(seed)
    pool = [["t" * rng.randint(1, 30) + str(k) for k in range(size)] for size in (2, 5, 12)]
    texts = []
    for _ in range(n):
        lines = [rng.choice(rng.choice(pool)) for _ in range(rng.randint(0, 14))]
        if texts and rng.random() < 0.6:
            old = rng.choice(texts).split("\n")
            at = rng.randrange(len(old))
            lines = old[:at] + lines[: rng.randint(0, 3)] + old[at + rng.randint(0, 2) :]
        texts.append("\n".join(lines))
    return texts


def as_tables(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(texts)) for j in range(i + 1, min(i + 4, len(texts)))], "a_id long, b_id long")
    return docs, pairs


def test_correlated_windows(spark):
    texts = [*random_docs(3, 40), "same\n" * 9, "same\n" * 7, ""]
    docs, pairs = as_tables(spark, texts)
    got = {}
    for r in windows.correlated_windows(pairs, hashed_lines(docs)).collect():
        got.setdefault((r["a_id"], r["b_id"]), []).append((r["i0"], r["i1"], r["j0"], r["j1"], r["matched"]))
    held = [diff.paragraphs(t) for t in texts]
    pairs = [(r["a_id"], r["b_id"]) for r in pairs.collect()]
    assert {p: sorted(w) for p, w in got.items()} == {(i, j): plain_windows(held[i], held[j]) for i, j in pairs}
    assert sum(m for w in got.values() for *_, m in w) > 30


@pytest.mark.parametrize("detail", [True, False])
def test_pieces_give_the_same_as_whole_pairs(spark, detail):
    texts = random_docs(7, 30)
    docs, pairs = as_tables(spark, texts)
    rows = lambda **k: sorted(map(tuple, diff.diff(pairs, docs, detail, **k).collect()))
    want = rows()
    assert rows(long=6, piece=4) == want and rows(long=-1, piece=0) == want


def test_fifteen_thousand_lines_are_dealt_in_pieces(spark):
    rng = random.Random(6)
    a = [f"line {k} has {rng.randrange(10**6)} in it" for k in range(15_000)]
    b = [x if rng.random() < 0.98 else x + " and more" for x in a]
    docs, pairs = spark.createDataFrame([(1, "\n".join(a)), (2, "\n".join(b))], "doc_id long, text string"), spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    pieces = windows.correlated_windows(pairs, hashed_lines(docs), piece=3000).collect()
    assert len(pieces) >= 8 and max(r["i1"] - r["i0"] for r in pieces if not r["matched"]) < 3000
    out = diff.diff(pairs, docs).orderBy("seq_no").collect()
    assert "".join(r["text"] for r in out if r["status"] != "Inserted") == "".join(x + "\n" for x in a)
    assert "".join(r["text"] for r in out if r["status"] != "Deleted") == "".join(x + "\n" for x in b)
    assert [r["seq_no"] for r in out] == list(range(len(out))) and sum(r["status"] == "Inserted" for r in out) > 100


def plain_promotion(rows):
    """Stretch by stretch, with what came out so far."""
    out, i = [], 0
    while i < len(rows):
        if rows[i][0] != "Deleted":
            out.append(rows[i])
            i += 1
            continue
        start = i
        while i < len(rows) and rows[i][0] == "Deleted":
            i += 1
        gap, end, table = rows[start:i], i, False
        while end < len(rows) and rows[end][0] == "Equal" and end - i < 3 and not table:
            table = rows[end][3]
            end += 1
        if table and (not out or out[-1][0] in ("Equal", "Inserted")):
            taken = rows[i:end]
            out += [("Inserted", None, j, t) for _, _, j, t in taken] + gap + [("Deleted", k, None, t) for _, k, _, t in taken]
            i = end
        else:
            out += gap
    return out


def test_promote_skip_ahead(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for pair in range(150):
        seq = []
        for k in range(rng.randint(1, 20)):
            status = rng.choice(["Equal", "Equal", "Deleted", "Deleted", "Inserted"])
            seq.append((status, k if status != "Inserted" else None, k if status != "Deleted" else None, rng.random() < 0.5))
        rows += [(pair, pair + 1, k, *r) for k, r in enumerate(seq)]
        want[pair] = plain_promotion(seq)
    df = spark.createDataFrame(rows, "a_id long, b_id long, seq_no int, status string, i int, j int, in_table boolean")
    got = {}
    for r in windows.promote_skip_ahead(df).orderBy("a_id", "seq_no").collect():
        got.setdefault(r["a_id"], []).append((r["status"], r["i"], r["j"], r["in_table"]))
    assert got == want


def test_promoted_lines_become_moves(spark):
    line = lambda k: " ".join(f"w{k}x{x}" for x in range(8))
    head, gone, table = [line(1)], [line(2), line(3)], " | ".join(f"cell{k} of the table" for k in range(6))
    rows = [(d, k, x) for d, lines in ((1, [*head, *gone, line(4), table, line(5)]), (2, [*head, line(4), table, line(5)])) for k, x in enumerate(lines)]
    hashed = spark.createDataFrame(rows, "doc_id long, line_no int, line string").withColumn("h", F.sha1("line"))
    pairs = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    assert sorted((r["i"], r["j"]) for r in similarity.detect_moves(pairs, hashed).collect()) == [(3, 1), (4, 2)]
