import zlib

import corpus_pipeline
import pytest
from helpers import CLASHING, frame, odd_rows, sentence
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard, lines, mixing, quality, queries, substrings, toxicity, urls

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 50 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns)


def planted(spark, folder):
    """A corpus folder with nulls, empty texts, repeated rows, a long text, and columns of every clashing name; what must happen to it."""
    import random

    rng = random.Random(8)
    passage = sentence(rng, 40)
    rows = odd_rows() + [(100 + k, sentence(rng, 60)) for k in range(40)]
    rows += [(200, sentence(rng, 30) + " idiot moron scum " + sentence(rng, 30)), (201, passage), (202, rows[-1][1]), (203, rows[-1][1] + " x")]
    docs = frame(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, passage), ("b", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(200, 1, 1), (100, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, docs


def test_run_on_odd_rows_and_clashing_names(spark, tmp_path):
    rows, docs = planted(spark, tmp_path)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema], name
        got = after.collect()
        assert all(r[c] == "clash" for r in got for c in CLASHING), name
        assert {(r.doc_id, r.text) for r in got} <= set(rows), name
        kept[name] = [(r.doc_id, r.text) for r in got]
        docs = spark.createDataFrame(got, docs.schema)
    tokens = corpus_pipeline.tokenize(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in tokens)) == sorted((i is None, i or 0) for i, _ in kept["mixing"])
    blank = [r for r in rows if not (r[1] or "").strip()]
    assert len(kept["toxicity"]) == len(rows) - 1 and (200, rows[-4][1]) not in kept["toxicity"]
    # brute force: copies and near copies leave the smallest id; texts without words all stay
    left = kept["near_duplicates"]
    assert sorted(map(repr, (r for r in left if not (r[1] or "").strip()))) == sorted(map(repr, blank))
    assert [i for i, t in left if t == "a b c d e f g"] == [6] and {201} <= {i for i, _ in left} and not {202, 203} & {i for i, _ in left}
    assert [i for i, t in left if (t or "").startswith("lorem")] == [8]
    assert {i for i, _ in left} - {i for i, _ in kept["decontamination"]} == {201}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in found) == sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in tokens)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


KEEPING = {
    "op3": (lambda d: urls.filter_urls(d, url_col="text"), "host path rule verdict score"),
    "op4": (lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([("i", "one two three")], "item_id string, text string")), "n_words n_hit hits item_ids contaminated"),
    "op4 in blocks": (lambda d: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([("i", "one two three"), ("j", "a b c"), ("k", "x")], "item_id string, text string"), max_windows=1), "n_words n_hit hits item_ids contaminated"),
    "op5": (quality.assess, "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed cleaned lost_chars kept"),
    "op6": (lambda d: toxicity.score(d, *toxicity.fit(d.select("doc_id", "text"), d.sparkSession.createDataFrame([(4, 1)], "doc_id long, toxic int"))[:2]), "score predicted"),
    "op7": (lines.dedup_lines, "n_lines n_removed deduped"),
    "op8": (substrings.dedup_substrings, "n_bytes n_removed n_spans kept"),
    "op9": (mixing.mix_sources, "size source_size target copies taken"),
    "representatives": (jaccard.keep_representatives, ""),
}


@pytest.mark.parametrize("name", list(KEEPING))
def test_operators_keep_columns_of_any_name(spark, name):
    run, added = KEEPING[name]
    docs = frame(spark, odd_rows())
    out = run(docs)
    got = out.collect()
    assert len(set(out.columns)) == len(out.columns)
    kept = [c for c in docs.columns if c not in added.split()]
    assert out.columns == kept + added.split()
    for c in CLASHING:
        assert c in added.split() or all(r[c] == "clash" for r in got)
    if name != "representatives":
        assert sorted((repr(r.doc_id), repr(r.text)) for r in got) == sorted((repr(i), repr(t)) for i, t in odd_rows())


def test_every_operator_has_a_query():
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_op6_query_against_brute_force(spark, tmp_path):
    """Held-out marks by crc32, scores equal for equal texts, and the share of right answers on rows never trained on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = toxicity.op6_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == docs.count() and len({r.doc_id for r in got}) == len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_long_texts_reach_every_operator(spark):
    long = ("word " * 9 + "end.\n") * 40_000
    docs = frame(spark, [(1, long), (2, long), (3, long[:-7] + "tail")], extra=False)
    assert [r.n_words for r in quality.assess(docs.where("doc_id = 1")).collect()] == [400_000]
    assert {r.copies for r in mixing.mix_sources(docs).collect()} <= {0, 1, 2, 3}
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[1].n_lines == 40_000 and got[2].deduped == "" and docs.where(F.length("text") > 1_000_000).count() == 3
