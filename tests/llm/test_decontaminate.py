import random
import re

import pytest
from helpers import frame, odd_rows, sentence

from docloom.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, width=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(width, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == v[k : k + n]:
                    hit.update(range(s, s + n))
                    found.add(item)
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def sample():
    rng = random.Random(2)
    items = [(str(k), sentence(rng, rng.choice((3, 12, 13, 20, 40)))) for k in range(12)] + [("none", None), ("blank", " - "), ("same", "a b c d e f g")]
    rows = odd_rows()
    for k in range(60):
        text = sentence(rng, 30).split()
        if k % 2:
            item = (items[rng.randrange(12)][1]).split()
            cut = item[: rng.randint(1, len(item))]
            text[10:10] = [w.upper() if rng.random() < 0.3 else w for w in cut]
        rows.append((100 + k, rng.choice((" ", ", ", " -- ")).join(text)))
    return items, rows


@pytest.mark.parametrize("max_windows", [200_000, 20])
def test_equals_brute_force(spark, max_windows):
    items, rows = sample()
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_contamination(frame(spark, rows), benchmark, max_windows=max_windows).collect()
    assert sorted((r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got) == sorted(brute(t, items) for _, t in rows)


@pytest.mark.parametrize("max_windows", [200_000, 20])
def test_items_without_id_hit(spark, max_windows):
    items, rows = sample()
    nameless = [(None if k % 2 else i, t) for k, (i, t) in enumerate(items)]
    benchmark = spark.createDataFrame(nameless, "item_id string, text string")
    got = decontaminate.find_contamination(frame(spark, rows), benchmark, max_windows=max_windows).collect()
    named = {i for i, _ in nameless}
    want = [(n, hit, [i for i in found if i in named], bad) for n, hit, found, bad in (brute(t, items) for _, t in rows)]
    assert sorted((r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got) == sorted(want)


def test_actions(spark):
    items, rows = sample()
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = frame(spark, rows, extra=False)
    found = decontaminate.find_contamination(docs, benchmark)
    kept = decontaminate.drop_contaminated(found)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for _, t in rows if not brute(t, items)[3])
    for r in decontaminate.remove_spans(found).collect():
        source = [t for i, t in rows if i == r.doc_id]
        assert any(len(words(r.text)) == brute(t, items)[0] - brute(t, items)[1] for t in source)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.find_contamination(frame(spark, []), none).count() == 0
    assert decontaminate.find_contamination(frame(spark, odd_rows()), none).where("n_hit > 0").count() == 0


def test_query_counts_items_without_id(spark, tmp_path):
    items, rows = sample()
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    nameless = [(None if k % 2 else i, t) for k, (i, t) in enumerate(items)]
    frame(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(nameless, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duckdb = pytest.importorskip("duckdb").connect()
    for name in ("documents", "benchmark"):
        duckdb.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duckdb.execute(decontaminate.ORACLE_SQL).fetchall()
    assert sorted(tuple(r) for r in decontaminate.op4_decontaminate(spark, str(tmp_path)).collect()) == sorted(want)
