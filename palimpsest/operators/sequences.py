"""Common runs and common subsequences of two lists of numbers, for use inside tasks.

Runs are found by joining equal places where there are few, and otherwise by an automaton of all stretches of one
list, so that a list of one repeated unit costs no more than any other. Subsequences take a bit for each place.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

DENSE = 6  # times as many equal places as units, from which on the automaton is cheaper
ROWS_KEPT = 512


def heaviest_run(a: Sequence[int], b: Sequence[int], upto: Sequence[int], i0: int, i1: int, j0: int, j1: int) -> tuple[int, int, int, int]:
    """(place in a, place in b, length, weight) of the heaviest run common to a[i0:i1] and b[j0:j1].

    upto[k] is the weight of the first k units of a; every unit weighs something. Of equally heavy runs the one that
    is first in a counts, then the one first in b. Without any: (0, 0, 0, 0).
    """
    held = Counter(b[j0:j1])
    places = sum(held.get(x, 0) for x in a[i0:i1])
    if not places:
        return 0, 0, 0, 0
    if places <= DENSE * (i1 - i0 + j1 - j0):
        return _by_places(a, b, upto, i0, i1, j0, j1)
    return _by_automaton(a, b, upto, i0, i1, j0, j1)


def _by_places(a, b, upto, i0, i1, j0, j1):
    at = defaultdict(list)
    for j in range(j0, j1):
        at[b[j]].append(j)
    best, ends = (0, 0, 0, 0), {}
    for i in range(i0, i1):
        now = {}
        for j in at.get(a[i], ()):
            n = now[j] = ends.get(j - 1, 0) + 1
            weight = upto[i + 1] - upto[i + 1 - n]
            if weight > best[3] or weight == best[3] and (i + 1 - n, j + 1 - n) < best[:2]:
                best = (i + 1 - n, j + 1 - n, n, weight)
        ends = now
    return best


def _by_automaton(a, b, upto, i0, i1, j0, j1):
    """For each end in a, the longest run that ends there and is anywhere in b: a walk through b's suffix automaton."""
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for j in range(j0, j1):
        x, now = b[j], len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(j)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = now
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    best, state, n = (0, 0, 0, 0), 0, 0
    for i in range(i0, i1):
        x = a[i]
        while state and x not in step[state]:
            state = link[state]
            n = length[state]
        if x in step[state]:
            state, n = step[state][x], n + 1
        else:
            state, n = 0, 0
        weight = upto[i + 1] - upto[i + 1 - n]
        if n and (weight > best[3] or weight == best[3] and (i + 1 - n, first[state] + 1 - n) < best[:2]):
            best = (i + 1 - n, first[state] + 1 - n, n, weight)
    return best


def subsequence(a: Sequence, b: Sequence, gone_first: bool = True) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, as a walk back through the table of lengths finds them.

    Going back from the ends, equal units are taken; else, if leaving out a unit of a loses nothing, that is done
    (gone_first; otherwise one of b), and else the other. A row of the table is a number with a bit for each place of
    b; every ROWS_KEPT-th row is kept, and the rows between are made again on the way back.
    """
    if not gone_first:
        return [(i, j) for j, i in subsequence(b, a)]
    m = len(b)
    full = (1 << m) - 1
    masks: dict = defaultdict(int)
    for j, x in enumerate(b):
        masks[x] |= 1 << j

    def next_row(row: int, x) -> int:
        met = row & masks.get(x, 0)
        return ((row + met) | (row - met)) & full

    kept, row = [full], full
    for i, x in enumerate(a):
        row = next_row(row, x)
        if (i + 1) % ROWS_KEPT == 0:
            kept.append(row)
    out, i, j, base, rows = [], len(a), m, -1, []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
            continue
        if (i - 1) // ROWS_KEPT != base:
            base = (i - 1) // ROWS_KEPT
            rows = [kept[base]]
            for k in range(base * ROWS_KEPT, min((base + 1) * ROWS_KEPT, len(a))):
                rows.append(next_row(rows[-1], a[k]))
        # how much longer it gets by the i-th unit of a: zeros among the first j bits of both rows
        low = (1 << j) - 1
        if (rows[i - 1 - base * ROWS_KEPT] & low).bit_count() == (rows[i - base * ROWS_KEPT] & low).bit_count():
            i -= 1
        else:
            j -= 1
    return out[::-1]
