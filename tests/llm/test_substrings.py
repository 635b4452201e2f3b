import random

import numpy as np
import pytest
from helpers import frame, odd_rows, sentence

from docloom.llm import substrings
from docloom.llm.suffixes import equal_windows, suffix_arrays


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(1)
    for _ in range(150):
        strings = []
        for _ in range(rng.integers(1, 8)):
            s = rng.integers(1, 1 + rng.integers(1, 6), rng.integers(0, 40)).tolist()
            strings.append((s[:3] * 8 if rng.random() < 0.3 else s) + [0])
        base = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        want = [int(base[k]) + i for k, s in enumerate(strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert suffix_arrays(np.array(sum(strings, [])), base).tolist() == want


def test_equal_windows():
    text = np.array([5, 6, 7, 1, 5, 6, 8, 1, 9, 5, 6, 7, 1, 0])
    place, group = equal_windows(text, np.array([0, len(text)]), np.arange(len(text)) < 11, 3)
    found = {}
    for p, g in zip(place.tolist(), group.tolist()):
        found.setdefault(g, set()).add(p)
    assert sorted(map(sorted, found.values())) == [[0, 9], [1, 10]]


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        change = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                change[k] += 1
                change[k + length] -= 1
            seen.add(w)
        gone = np.cumsum(change)[: len(raw)] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("hot,flush,limit", [(64, 350_000, 64 << 20), (5, 2_000, 64 << 20), (2, 500, 0)])
def test_equals_brute_force(spark, monkeypatch, hot, flush, limit):
    """With anchors that are hot in a task, only over tasks, or at both levels of cutting; with and without broadcasts."""
    monkeypatch.setattr(substrings, "HOT_UNITS", hot)
    monkeypatch.setattr(substrings, "_FLUSH_UNITS", flush)
    monkeypatch.setattr(substrings, "MAX_BROADCAST_BYTES", limit)
    rng = random.Random(7)
    passages = [sentence(rng, 30) for _ in range(4)]
    rows = []
    for k in range(90):
        parts = [sentence(rng, rng.randint(0, 20)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randint(60, len(p))])
        rows.append((k, "é".join(parts)))
    rows += [(200, "abc" * 200), (201, "x" * 99), (202, "x" * 100), (203, "x" * 101), (204, rows[5][1]), (205, "abc" * 100), (206, None), (207, "")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup_substrings(frame(spark, rows)).collect())
    assert got == sorted(brute(rows, 100))


def test_passage_in_a_third_of_the_documents(spark, monkeypatch):
    """Its edges are hot anchors; what is cut equals brute force, whether a task or only the whole finds them hot."""
    rng = random.Random(12)
    passage = sentence(rng, 45)
    rows = [(k, sentence(rng, rng.randint(3, 12)) + (" " + passage + " " if k % 3 == 0 else " ") + sentence(rng, rng.randint(3, 12))) for k in range(600)]
    want = sorted(brute(rows, 100))
    for partitions in (1, 40):
        docs = frame(spark, rows, extra=False).repartition(partitions, "doc_id")
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup_substrings(docs).collect())
        assert got == want


def test_bands_hold_every_window_once():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    owner, first, count, offset, anchor, unit = substrings.cut_units(data, np.array([0, len(data)]), 100, 40)
    windows = [(f + i, o - i) for f, c, o in zip(first, count, offset) for i in range(c)]
    for band in (8, 3, 1):
        k, inner, number, rest, key, body = substrings.cut_bands(data, first, count, offset, 100, band)
        parts = [(first[u] + i + j, r - j) for u, i, n, r in zip(k, inner, number, rest) for j in range(n)]
        assert sorted(parts) == sorted(windows) and number.max() <= band
        same = {}
        for u, i, n, r, x in zip(k, inner, number, rest, key):
            begin = first[u] + i
            low = begin + r - band * (r // band)
            same.setdefault(x, set()).add((data[low : low + 101 - band].tobytes(), r // band))
        assert all(len(v) == 1 for v in same.values())


def test_long_text(spark):
    rng = random.Random(8)
    block = sentence(rng, 30_000)
    rows = [(1, block * 7), (2, block[1000:3000])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.dedup_substrings(frame(spark, rows, extra=False)).collect())
    n = len(block)
    # later repeats go from their start on, unless the first bytes after a repeat also differ from what was there
    assert got[0][:2] == (1, 7 * n) and got[0][2] == 6 * n and got[0][3] == 1
    assert got[1] == (2, 2000, 2000, 1)


def test_ties_and_repeats(spark):
    rows = odd_rows() + [(30, "q" * 10 + "abcdefghij" * 15), (30, "abcdefghij" * 15 + "z" * 10), (30, "abcdefghij" * 15 + "z" * 10)]
    got = substrings.dedup_substrings(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text), set()).add((r.n_bytes, r.n_removed, r.n_spans))
    assert all(len(v) == 1 for v in by.values())
    assert by[(9, odd_rows()[-1][1])] == {(72000, 72000, 1)}
    assert len(substrings.dedup_substrings(frame(spark, [])).collect()) == 0


def test_repeated_rows_equal_brute_force(spark):
    rng = random.Random(9)
    passage = sentence(rng, 40)
    rows = [(k, sentence(rng, 20) + passage[rng.randrange(60) :] + sentence(rng, 20)) for k in range(12)]
    repeated = rows + rows[:6] * 2
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup_substrings(frame(spark, repeated)).collect())
    want = {r[0]: r for r in brute(rows, 100)}
    assert got == sorted(want[i] for i, _ in repeated)
