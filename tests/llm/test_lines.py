import random
import re

from helpers import frame, odd_rows, sentence

from docloom.llm import lines


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        all_ = (t or "").split("\n")
        said = [k for k, line in enumerate(all_) if re.search(r"[^\x20\x09-\x0D]", line)]
        gone = set()
        for p in range(len(said) - 2):
            g = tuple(all_[said[p + j]] for j in range(3))
            gone.update(said[p : p + 3] if g in seen else ())
            seen.add(g)
        out[i] = (len(said), len(gone), "\n".join(line for k, line in enumerate(all_) if k not in gone))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(6)
    stock = [sentence(rng, 3) for _ in range(12)] + ["", " "]
    rows = [(k, "\n".join(rng.choices(stock, k=rng.randint(0, 14)))) for k in range(80)]
    rows += [(k, "\n".join(stock[:5] * 3)) for k in range(80, 90)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.deduped) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_odd_rows_and_empty_table(spark):
    text = "a\nb\nc"
    rows = odd_rows() + [(20, text), (20, text), (21, text), (None, text)]
    got = lines.dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.deduped == text for r in got if r.doc_id is None and r.text == text)
    assert all(r.deduped == "" for r in got if r.doc_id in (20, 21))
    assert all(r.deduped == r.text for r in got if r.doc_id in (1, 2, 3, 4))
    assert lines.dedup_lines(frame(spark, [])).count() == 0
