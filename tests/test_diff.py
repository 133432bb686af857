"""The ordered alignment: hand cases, and the invariants of accepting and rejecting."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import diff


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("m m", "m", (0, 0, 1)),
        ("p q", "r s", (0, 0, 0)),
        ("a b a b", "a b", (0, 0, 2)),
        ("x a b y", "a b c a b", (1, 0, 2)),
    ],
)
def test_longest_run(a, b, want):
    assert diff.longest_run(a.split(), b.split()) == want


def test_longest_run_against_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        assert diff.longest_run(a, b) == best


@pytest.mark.parametrize(
    ("line", "want"),
    [("hi there", ["hi", " ", "there"]), ("3.14", ["3.14"]), ("a, b", ["a", ",", " ", "b"]), ("漢字x", ["漢", "字", "x"]), ("", []), ("end.", ["end", "."])],
)
def test_words(line, want):
    assert diff.words(line) == want


def test_statuses():
    assert diff.aligned("a b", "a b", True) == [("Equal", "a b\n")]
    assert diff.aligned("", "x", True) == [("Inserted", "x\n")]
    assert diff.aligned("x", "", True) == [("Deleted", "x\n")]
    assert diff.aligned("", "", True) == []
    assert diff.aligned("p q", "r s", False) == [("Deleted", "p q\n"), ("Inserted", "r s\n")]


TEXT = st.text(alphabet="ab c.\n1,é", max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.booleans())
def test_accept_and_reject_give_back_both_sides(a, b, detail):
    out = diff.aligned(a, b, detail)
    full = lambda t: "".join(s + "\n" for s in diff.paragraphs(t))
    assert "".join(t for s, t in out if s != "Inserted") == full(a)
    assert "".join(t for s, t in out if s != "Deleted") == full(b)
    assert all(x[0] != y[0] for x, y in zip(out, out[1:]))


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_no_revisions_against_itself(a):
    assert all(s == "Equal" for s, _ in diff.aligned(a, a, True))


def test_row_lcs():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 7))] for _ in range(2))
        out = diff._row_lcs(a, b)
        assert [i for s, i, _ in out if s != "Inserted"] == list(range(len(a)))
        assert [j for s, _, j in out if s != "Deleted"] == list(range(len(b)))
        assert all(a[i] == b[j] for s, i, j in out if s == "Equal")


def test_richest_run_against_brute_force():
    rng = random.Random(1)
    units = ["a", "bb", "ccc", " ", ",", diff.MARK]
    for _ in range(400):
        a, b = ([rng.choice(units) for _ in range(rng.randint(0, 10))] for _ in range(2))
        best, chosen = (0, 0), (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                rank = (sum(map(diff._content, a[i : i + n])), n)
                if rank[0] and rank > best:
                    best, chosen = rank, (i, j, n)
        assert diff.richest_run(a, b) == chosen


def test_words_of_content_outrank_longer_runs():
    # three short units in a row against one long word
    assert diff.richest_run(["x", ",", "y", "encyclopaedia"], ["encyclopaedia", "x", ",", "y"]) == (3, 0, 1)
    assert diff.richest_run([" ", ","], [" ", ","]) == (0, 0, 0)


def test_long_unlike_lines_are_aligned_in_time():
    rng = random.Random(2)
    a, b = (" ".join(f"{side}{rng.randrange(4000)}" for _ in range(8000)) for side in "ab")
    began = time.process_time()
    out = diff.aligned(a, b, True)
    assert time.process_time() - began < 5
    assert "".join(t for s, t in out if s != "Inserted") == a + "\n"


def test_moved_revisions(spark):
    from palimpsest.operators import similarity

    said = "one two three four five six"
    rows = [(1, 2, 1, "Deleted", said), (1, 2, 2, "Inserted", "quite other words than those before here"), (1, 2, 3, "Inserted", said), (1, 2, 4, "Deleted", "a b")]
    revs = spark.createDataFrame([(*r, "me", "now") for r in rows], "a_id long, b_id long, rev_no int, type string, text string, author string, date string")
    got = {r["rev_no"]: (r["type"], r["move_group_id"], r["is_move_source"]) for r in similarity.moved_revisions(revs).collect()}
    assert got == {1: ("Moved", 1, True), 2: ("Inserted", None, None), 3: ("Moved", 1, False), 4: ("Deleted", None, None)}
    text = diff.revision_json(similarity.moved_revisions(revs)).where("rev_no = 1").first()["json"]
    assert list(json.loads(text)) == ["type", "author", "date", "part", "moveGroupId", "isMoveSource", "formatChange", "text"]
    whole = json.loads(diff.revisions_to_json(similarity.moved_revisions(revs)).first()["json"])
    assert [x["type"] for x in whole] == ["Moved", "Inserted", "Moved", "Deleted"]
