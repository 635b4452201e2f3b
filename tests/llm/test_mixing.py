import random

import pytest
from helpers import frame, odd_rows, sentence

from docloom.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = sum(w[s] for s in free)
        target = {s: left * w[s] / share for s in free} | {s: most * sizes[s] for s in capped}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped.update(over)


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice((0, 1, 5, 50, 1000)) for k in range(rng.randint(1, 9))} | ({None: 7} if seed % 2 else {})
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(want)


def test_mix(spark):
    rng = random.Random(9)
    rows = odd_rows() + [(100 + k, sentence(rng, rng.randint(20, 60))) for k in range(2000)]
    docs = frame(spark, rows)
    mixed = mixing.mix_sources(docs)
    got = mixed.collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.size == len((r.text or "").split())
        assert int(r.target / r.source_size) <= r.copies <= int(r.target / r.source_size) + 1
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] + 24000 for s in target)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs).collect()))
    emitted = mixing.emit_copies(mixing.mix_sources(frame(spark, rows, extra=False)))
    assert emitted.columns == ["doc_id", "lang", "source", "n_chars", "text"] or set(emitted.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    assert emitted.count() == sum(r.copies for r in got)


def test_no_python_on_the_way(spark):
    plan = mixing.mix_sources(frame(spark, [(1, "a b")], extra=False))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    got = mixing.mix_sources(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r.copies, r.target) for r in got] == [(0, 0.0), (0, 0.0)]
