import functools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.operators import embed as E
from docloom.operators import layout as L
from docloom.operators import search as S
from docloom.operators.layout import heading_segments
from docloom.operators.normalize import flat_units, load_normalized_dataset, normalize, normalized_totals
from docloom.plans.pipelines import as_dicts, load_all, load_single, main, process_all, run_embedding_pipeline, watched
from docloom.sources.sinks import as_json, export_normalized, export_parsed


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "hr").mkdir()
    (root / "hr" / "leave_policy.md").write_text("# Leave\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nAsk your manager.")
    (root / "hr" / "list.csv").write_text("n,v\nx,1\n")
    (root / "readme.txt").write_text("Deploy with care.\n\n\n\n\n\nEnd.  \n")
    return root


def listed(paths):
    return sorted(r.path for r in paths.collect())


@pytest.mark.parametrize("one_file", [True, False])
def test_exports(spark, tree, tmp_path, one_file):
    parsed = load_all(spark, str(tree))
    paths = listed(export_parsed(parsed, str(tmp_path / "p"), one_file=one_file))
    assert [p.rpartition("/p/")[2] for p in paths] == ["hr/leave_policy_parsed.txt", "hr/list_parsed.txt", "readme_parsed.txt"]
    text = (tmp_path / "p" / "readme_parsed.txt").read_text()
    head = text.split("\n")
    assert head[0] == "=" * 80 == head[8] and head[1] == "DOCUMENT TITLE: readme.txt" and head[6] == "TOTAL UNITS   : 1 structural unit(s)" and "[DOCUMENT 1: readme] (" in text
    assert text.endswith("--- EXTRACTED CONTENT ---\n\nDeploy with care.\n\n\n\n\n\nEnd.  \n")
    docs = process_all(spark, str(tree), stage=str(tmp_path / "stage"))
    export_normalized(docs, str(tmp_path / "n"), one_file=one_file)
    text = (tmp_path / "n" / "hr" / "leave_policy_normalized.txt").read_text()
    assert "DOCUMENT TYPE   : policy" in text and "  Type: DOCUMENT | Title: leave_policy [TABLE FORMAT]" in text
    assert "  Table Info: {'rows': 3, 'columns': 2, 'has_markdown_format': True}" in text and "=== [DOCUMENT 1: leave_policy] ===" in text
    assert all(set(json.loads(r.json)) == set(docs.columns) for r in as_json(docs).collect())
    if one_file:
        told = json.loads((tmp_path / "p" / "dataset_summary.json").read_text())
        assert list(told) == ["stats", "documents"] and told["stats"]["total_documents"] == 3 and told["stats"]["file_formats"] == {".md": 1, ".csv": 1, ".txt": 1}
        first = min(told["documents"], key=lambda d: d["file_name"])
        assert list(first) == ["file_path", "file_name", "file_type", "category", "content", "elements", "metadata", "error"] and "author" not in first["metadata"] and first["error"] is None
        told = json.loads((tmp_path / "n" / "normalized_dataset_summary.json").read_text())
        assert list(told) == ["total_documents", "total_structural_units", "total_characters", "total_words", "total_tables", "documents"] and told["total_documents"] == 3
        assert list(told["documents"][0]["units"][0])[:6] == ["unit_id", "unit_type", "unit_index", "title", "content", "page_number"]
        again = load_normalized_dataset(spark, str(tmp_path / "n" / "normalized_dataset_summary.json"))
    else:
        totals = json.loads("".join(f.read_text() for f in (tmp_path / "n" / "normalized_dataset_summary" / "totals").glob("*.json")))
        assert totals["total_documents"] == 3
        again = load_normalized_dataset(spark, str(tmp_path / "n" / "normalized_dataset_summary" / "documents"), one_file=False)
    assert sorted(r.unit_id for r in again.collect()) == sorted(r.unit_id for r in flat_units(docs).collect())


def test_json_file_of_no_rows(spark, tmp_path):
    from docloom.sources.sinks import write_json_file

    assert write_json_file(str(tmp_path / "deep" / "x.json"), {"a": {"b": 1}}, "rows", spark.range(0)) == 0
    assert json.loads((tmp_path / "deep" / "x.json").read_text()) == {"a": {"b": 1}, "rows": []}


def test_two_documents_of_one_path_stay_apart(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "same.md").write_text(f"text {k}")
    parsed = load_single(spark, str(tmp_path / "1" / "same.md")).union(load_single(spark, str(tmp_path / "2" / "same.md")))
    assert sorted([u.content for u in r.units] for r in normalize(parsed).collect()) == [["text 1"], ["text 2"]]


def test_normalisation_has_no_shuffle_and_one_scan(spark, tree):
    plan = normalize(load_all(spark, str(tree)))._jdf.queryExecution().executedPlan().toString()
    # file names are dealt to the tasks that read them; texts are not shuffled, and every file is read once
    (dealt,) = [line for line in plan.splitlines() if "Exchange" in line]
    assert "REPARTITION_BY_NUM" in dealt and plan.index("Exchange") > plan.index("MapInArrow") and plan.count("MapInArrow") == 1 and "from_json" not in plan
    totals = normalized_totals(normalize(load_all(spark, str(tree))))._jdf.queryExecution().sparkPlan().toString()
    assert totals.count("MapInArrow") == 1


def test_single_file_and_dicts(spark, tree):
    (row,) = as_dicts(load_single(spark, str(tree / "hr" / "leave_policy.md")))
    assert (row["relative_path"], row["category"], row["metadata"]["file_size_bytes"], row["error"]) == ("leave_policy.md", "general", 0, None)
    assert row["elements"][0]["content"].startswith("# Leave")
    (gone,) = as_dicts(load_single(spark, str(tree / "absent.PDF")))
    assert gone["error"].startswith("File not found: ") and gone["file_type"] == ".pdf" and gone["elements"] == []


def test_summary_round_trip(spark, tmp_path):
    told = {"documents": [{"file_name": "f", "category": "c", "units": [{"unit_id": "u1", "content": "x", "word_count": 1}, {"unit_id": "u2"}]}, {"file_name": "g", "units": []}]}
    (tmp_path / "s.json").write_text(json.dumps(told, indent=2))
    rows = load_normalized_dataset(spark, str(tmp_path / "s.json")).orderBy("unit_id").collect()
    assert [(r.unit_id, r.file_name, r.content, r.title) for r in rows] == [("u1", "f", "x", None), ("u2", "f", None, None)]


def test_embedding_pipeline(spark, tree, tmp_path):
    units = flat_units(process_all(spark, str(tree)))
    found = run_embedding_pipeline(spark, units, str(tmp_path / "e"), "nomic", queries=("Deploy with care",), backend=E.hash_backend(768))
    hits = found["Deploy with care", "cosine"].collect()
    assert hits[0].file_name == "readme.txt" and [h.rank for h in hits] == [1, 2, 3]
    manifest = spark.read.json(str(tmp_path / "e" / "manifest")).first()
    assert manifest.total_units == units.count() and manifest.embedding_dim == 768
    told = json.loads((tmp_path / "e" / "embeddings.json").read_text())
    assert list(told) == ["model_name", "embedding_dim", "total_units", "generation_time_seconds", "units"]
    assert len(told["units"]) == manifest.total_units and len(told["units"][0]["embedding"]) == 768 and "breadcrumbs" in told["units"][0]


def test_generation_time_is_that_of_the_vectors(spark, tree, tmp_path):
    def slow():
        import time

        time.sleep(1.0)
        return lambda texts: np.ones((len(texts), 2), np.float32)

    run_embedding_pipeline(spark, flat_units(process_all(spark, str(tree))), str(tmp_path / "e"), "bge", queries=(), backend=lambda: slow())
    assert spark.read.json(str(tmp_path / "e" / "manifest")).first().generation_time_seconds >= 1.0


def stub_loader(name, device):
    """A tokenizer with one id per word, and a model whose token vectors show ids, mask and device."""
    import numpy as np

    def tokenizer(texts, padding, return_tensors, truncation=False, max_length=None):
        ids = [[len(w) for w in t.split()][: max_length if truncation else None] for t in texts]
        width = max(map(len, ids))
        return dict(input_ids=np.array([i + [0] * (width - len(i)) for i in ids]), attention_mask=np.array([[1] * len(i) + [0] * (width - len(i)) for i in ids]))

    def model(input_ids, attention_mask):
        hidden = np.stack([input_ids, attention_mask, np.full_like(input_ids, len(device))], 2).astype(np.float32)
        return (hidden,)

    return tokenizer, model


def test_transformer_backend_pools_and_cuts():
    text = "four words are here " * 200
    cls = E.transformer_backend(E.MODELS["bge"], device="cpu", load=stub_loader)()([text, "ab c"])
    assert cls.tolist() == [[4, 1, 3], [2, 1, 3]]
    mean = E.transformer_backend(E.MODELS["nomic"], device="gpu!", load=stub_loader)()([text, "ab cdef"])
    assert mean.tolist() == [[(4 + 5 + 3 + 4) / 4, 1, 4], [3, 1, 4]]  # of 512 tokens, and of two without the padding

    class Sentences:
        def encode(self, texts, batch_size, normalize_embeddings, convert_to_numpy, show_progress_bar):
            assert normalize_embeddings and convert_to_numpy
            return np.array([[len(t), 1.0] for t in texts])

    assert E.transformer_backend(E.MODELS["e5"], load=lambda name, device: Sentences())()(["abc"]).tolist() == [[3, 1]]
    with pytest.raises(ValueError):
        E.pool(np.zeros((1, 1, 1)), np.ones((1, 1)), "max")


def test_embed_through_the_backend(spark, monkeypatch):
    monkeypatch.setattr(stub_loader, "__module__", "__main__")  # workers cannot import this file, so it goes by value
    rows = spark.createDataFrame([("ab cdef",), (None,)], "content string")
    got = E.embed(rows, E.MODELS["nomic"], backend=E.transformer_backend(E.MODELS["nomic"], device="cpu", load=stub_loader)).collect()
    assert all(np.linalg.norm(r.embedding) == pytest.approx(1) for r in got)
    # prefix and text: search_document: ab cdef -> sizes 16, 2, 4
    assert got[0].embedding == pytest.approx(np.array([22 / 3, 1, 3]) / np.linalg.norm([22 / 3, 1, 3]))
    assert E.pick_device("cuda:1") == "cuda:1" and E.pick_device() in ("cpu", "cuda")


def test_watched_counts_as_it_runs(spark):
    df, told = watched(spark.createDataFrame([("abc", None), ("de", "broken")], "content string, error string"), "test")
    df.collect()
    found = told()
    assert (found["rows"], found["characters"], found["errors"]) == (2, 5, 1) and found["seconds"] >= 0


def test_command_line(spark, tree, tmp_path, capsys):
    main(["load", str(tree), str(tmp_path / "p")])
    main(["clean", str(tree), str(tmp_path / "n")])
    main(["embed", str(tree), str(tmp_path / "e"), "--model", "nomic", "--stand-in", "--query", "Deploy with care"])
    said = capsys.readouterr().out
    assert "total_documents" in said and "Deploy with care cosine" in said
    assert (tmp_path / "p" / "dataset_summary.json").exists() and (tmp_path / "n" / "normalized_dataset_summary.json").exists() and (tmp_path / "e" / "embeddings.json").exists()


def test_top_k_rules(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((40, 8)).astype(np.float32)
    m[7] = m[3]
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "unit_id long, embedding array<float>")
    q = m[3].tolist()
    scores = m.astype(float) @ np.array(q, float)
    want = sorted(range(40), key=lambda k: (-scores[k], -k))
    got = S.top_k(docs, q, k=5).orderBy("rank").collect()
    assert [r.unit_id for r in got] == want[:5]
    assert [r.unit_id for r in got] == want[:5]
    assert S.top_k(docs, q, k=0).count() == 0 and S.top_k(docs, q, k=100).count() == 40
    euclid = S.top_k(docs, q, k=1, metric="euclidean").first()
    assert euclid.score == 1.0 and euclid.unit_id == 7
    with pytest.raises(ValueError):
        S.top_k(docs, q, metric="manhattan")
    with pytest.raises(ValueError):
        S.top_k(docs, q, k=-1)


def test_top_k_many_equals_single_searches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, rng.standard_normal(4).astype(np.float32).tolist()) for k in range(60)], "unit_id long, embedding array<float>")
    queries = docs.where("unit_id < 9").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    whole = sorted(map(tuple, S.top_k_many(queries, docs, k=3).collect()))
    for size in ({"SCORES_AT_ONCE": 27}, {"MAX_BROADCAST": 0, "BLOCK_BYTES": 64}):
        with monkeypatch.context() as m:
            for name, value in size.items():
                m.setattr(S, name, value)
            assert sorted(map(tuple, S.top_k_many(queries, docs.repartition(3), k=3).collect())) == whole
    assert len(whole) == 27 and S.top_k_many(queries, docs, k=0).isEmpty() and S.top_k_many(queries.limit(0), docs).isEmpty() and S.top_k_many(queries, docs.limit(0)).isEmpty()
    for q in queries.collect():
        assert [r.unit_id for r in S.top_k(docs, q.query_embedding, k=3).orderBy("rank").collect()] == [w[2] for w in whole if w[0] == q.query_id]


@pytest.mark.parametrize("far", [False, True])
def test_ten_thousand_queries(spark, monkeypatch, far):
    """One scan of the documents, and no more rows than k for each query and task are shuffled; equal scores go to the larger key."""
    if far:
        monkeypatch.setattr(S, "MAX_BROADCAST", 0)
        monkeypatch.setattr(S, "BLOCK_BYTES", 1 << 16)
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (400, 4)).astype(float)
    q = rng.integers(-3, 4, (10_000, 4)).astype(float)
    docs = spark.createDataFrame([(f"u{k:03}", v.tolist()) for k, v in enumerate(m)] + [("none", None)], "unit_id string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, query_embedding array<double>")
    found = S.top_k_many(queries, docs, k=2, metric="dot")
    got = found.toPandas().sort_values(["query_id", "rank"])
    scores = q @ m.T
    order = np.lexsort((-np.arange(400)[None].repeat(10_000, 0), -scores), axis=1)[:, :2]
    assert got["unit_id"].tolist() == [f"u{k:03}" for k in order.reshape(-1)] and got["rank"].tolist() == [1, 2] * 10_000
    pairs = S._meet(queries, docs, "unit_id", "embedding", "query_id", "query_embedding", "dot", functools.partial(S._Best, k=2))
    assert pairs.groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert far or "Join" not in plan


def test_similarity_matrix_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m, q = rng.standard_normal((70, 3)), rng.standard_normal((90, 3))
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "unit_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, query_embedding array<double>")
    for bound in (1 << 20, 0):
        monkeypatch.setattr(S, "MAX_BROADCAST", bound)
        monkeypatch.setattr(S, "BLOCK_BYTES", 512)
        got = {(r.query_id, r.unit_id): r.score for r in S.similarity_matrix(queries, docs, metric="dot").collect()}
        assert len(got) == 6300 and all(abs(s - q[a] @ m[b]) < 1e-12 for (a, b), s in got.items())


def brute_overlap(blocks, tables):
    return {(p, b): min((t for q, t, *u in tables if p == q and u[0] < z[2] and u[2] > z[0] and u[1] < z[3] and u[3] > z[1]), default=None) for p, b, *z in blocks}


def test_first_overlap_by_cells(spark):
    """Boxes of all sizes, some of no size or beyond all tables, over several pages; one page without tables."""
    rng = np.random.default_rng(5)

    def boxes(n, pages):
        for k in range(n):
            x, y = rng.integers(0, 100, 2)
            w, h = rng.integers(0, (5, 30, 120)[k % 3], 2)
            yield int(rng.integers(0, pages)), k, float(x), float(y), float(x + w), float(y + h)

    blocks, tables = list(boxes(300, 5)), list(boxes(40, 3))
    ddl = "page int, {} int, x0 double, y0 double, x1 double, y1 double"
    got = L.first_overlap(spark.createDataFrame(blocks, ddl.format("block")), spark.createDataFrame(tables, ddl.format("table_idx"))).collect()
    assert {(r.page, r.block): r.table_idx for r in got} == brute_overlap(blocks, tables) and len(got) == 300


def test_one_page_of_very_many_boxes(spark):
    """10^5 blocks and 10^4 tables of one page: the join's rows follow the boxes, not their pairs."""
    n, t = 100_000, 10_000
    blocks = spark.range(n).selectExpr("1 AS page", "id AS block", "id % 1000 * 1.0 AS x0", "floor(id / 1000) * 10.0 AS y0", "id % 1000 + 0.9 AS x1", "floor(id / 1000) * 10.0 + 5 AS y1")
    tables = spark.range(t).selectExpr("1 AS page", "id AS table_idx", "id % 100 * 10.0 AS x0", "floor(id / 100) * 10.0 AS y0", "id % 100 * 10.0 + 8 AS x1", "floor(id / 100) * 10.0 + 8 AS y1")
    found = L.first_overlap(blocks, tables)
    assert found.count() == n and found.where("table_idx = floor(block / 1000) * 100 + floor(block % 1000 / 10)").count() == 8 * n // 10 == found.where("table_idx IS NOT NULL").count()
    rows = {}

    def walk(node):
        for metric, value in ((m._1(), m._2().value()) for m in _scala(node.metrics())):
            rows.setdefault(node.nodeName(), []).append(value) if metric == "numOutputRows" else None
        for child in _scala(node.children()):
            walk(child)
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            walk(node.plan())

    def _scala(seq):
        iterator = seq.iterator()
        while iterator.hasNext():
            yield iterator.next()

    found.write.format("noop").mode("overwrite").save()
    walk(found._jdf.queryExecution().executedPlan())
    assert max(v for values in rows.values() for v in values) <= 6 * n


def test_pooling_and_norm(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<float>>, m array<int>")
    got = row.select(V.mean_pool(F.col("v"), F.col("m")).alias("mean"), V.cls_pool(F.col("v")).alias("cls"), V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("unit"), V.l2_normalize(F.array(F.lit(0.0))).alias("zero")).first()
    assert got["mean"] == [2.0, 4.0] and got.cls == [1.0, 2.0] and got.unit == pytest.approx([0.6, 0.8]) and got.zero == [0.0]


def test_prefixes(spark):
    texts = ["  hi ", "query: hi", "passage: hi", None]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    e5 = E.MODELS["e5"]
    assert [r.p for r in rows.select(e5.prefixed(F.coalesce("content", F.lit("")), True).alias("p")).collect()] == ["query: hi", "query: hi", "passage: hi", "query: "]
    bge = E.MODELS["bge"]
    assert [r.p for r in rows.select(bge.prefixed(F.coalesce("content", F.lit("")), False).alias("p")).collect()] == ["hi", "query: hi", "passage: hi", ""]
    once = E.embed(rows, e5, backend=E.hash_backend(8)).collect()
    assert len(once) == 4 and all(len(r.embedding) == 8 for r in once)


def test_heading_segments(spark):
    lines = ["intro", "#A", "#B", "x", "y", "#C"]
    rows = spark.createDataFrame([(1, lines), (2, []), (3, None), (4, ["#only"]), (5, ["a", "b"])], "doc_id long, lines array<string>")
    found = heading_segments(rows, F.col("lines"), lambda line: line.startswith("#"))
    got = [(r.doc_id, r["index"], r.title, r.content) for r in found.orderBy("doc_id", "index").collect()]
    assert got == [(1, 1, "Overview", "intro"), (1, 2, "#B", "x\ny"), (5, 1, "Overview", "a\nb")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, tmp_path):
    from docloom.streaming import streams

    spark.createDataFrame([(1, " a  b \r\n"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    query = streams.clean_stream(streams.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string")).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.doc_id, r.clean, r.word_count) for r in spark.table("cleaned").collect()) == [(1, "a  b", 2), (2, "", 0)]


def test_rounding_keeps_the_sign_of_zero(spark):
    """As SQL's round does: -0.000001 at five places is -0.0, halves go away from zero."""
    values = [-1e-6, 1e-6, -0.0, 0.0, -0.015625, 0.015625, -1.234567, float("nan"), float("-inf"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(V.rounded(F.col("x"), 5)).collect()]
    assert list(map(repr, got)) == ["-0.0", "0.0", "-0.0", "0.0", "-0.01563", "0.01563", "-1.23457", "nan", "-inf", "None"]


@pytest.mark.parametrize("name, column", [("cls_pooling", "pooled"), ("l2_normalize", "unit"), ("embeddings_file", "embedding"), ("similarity_matrix", "score")])
def test_small_negative_components_round_to_negative_zero(spark, tmp_path, name, column):
    from docloom.plans import queries

    spark.createDataFrame([(0, 0, [-1e-7, 1.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    if name == "similarity_matrix":
        spark.createDataFrame([(1, 0, [1.0, 0.0])], "vec_id long, label int, embedding array<float>").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    got = [r[0] for r in queries.queries()[name](spark, str(tmp_path)).select(column).collect()]
    assert "-0.0" in repr(got)


def test_means_are_doubles(spark):
    """A mean that is rounded later must not be rounded to a float first."""
    values = [1.0, 2.0, 2.0]
    tokens = spark.createDataFrame([([[v] for v in values], [1, 1, 1])], "v array<array<double>>, m array<int>")
    mean = tokens.select(V.mean_pool(F.col("v"), F.col("m"))).first()[0][0]
    assert mean == sum(values) / 3 != float(np.float32(mean))


def test_process_tree_takes_notes_as_text(spark, tmp_path):
    """Texts of few ASCII letters are no binary files."""
    from docloom.plans import queries

    spark.createDataFrame([(3, "é ü ö " * 20, "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.content for r in queries.queries()["process_tree"](spark, str(tmp_path)).collect()] == [("é ü ö " * 20).strip()]


@pytest.mark.parametrize("scale", [1.0, 0.37])
def test_first_overlap_where_tables_cover_each_other(spark, scale):
    """Many tables over each other, of whole and of broken coordinates, also at the page's edges, and boxes without size."""
    rng = np.random.default_rng(11)

    def boxes(n, least, most):
        for k in range(n):
            x, y, w, h = *rng.integers(0, 60, 2), *rng.integers(least, most, 2)
            yield int(rng.integers(0, 2)), k, *(float(v) * scale for v in (x, y, x + w, y + h))

    blocks, tables = list(boxes(600, 0, 9)), list(boxes(150, 0, 35))
    ddl = "page int, {} int, x0 double, y0 double, x1 double, y1 double"
    got = L.first_overlap(spark.createDataFrame(blocks, ddl.format("block")), spark.createDataFrame(tables, ddl.format("table_idx"))).collect()
    assert {(r.page, r.block): r.table_idx for r in got} == brute_overlap(blocks, tables) and len(got) == 600


def test_tables_over_each_other_meet_few_blocks(spark):
    """All 2,000 tables of a page cover its middle; a cell keeps the first of them, and few at the left and right edges."""
    tables = spark.range(2000).selectExpr("1 AS page", "id AS table_idx", "id * 7919 % 2000 / 100 AS x0", "0.0 AS y0", "80 + id * 31 % 2000 / 100 AS x1", "100.0 AS y1")
    blocks = spark.range(20_000).selectExpr("1 AS page", "id AS block", "id % 100 AS x0", "floor(id / 200) AS y0", "id % 100 + 1 AS x1", "floor(id / 200) + 1 AS y1")
    found = L.first_overlap(blocks, tables)
    plan, pairs = found._jdf.queryExecution().optimizedPlan(), []

    def joins(node):
        if node.nodeName() == "Join" and "_i" in node.toString().split("\n")[0]:
            pairs.append(node)
        for k in range(node.children().length()):
            joins(node.children().apply(k))

    joins(plan)
    frame = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, pairs[0])
    assert len(pairs) == 1 and frame.count() < 20 * 20_000


@pytest.mark.parametrize("name", ["pdf_pages", "sample_documents", "sample_elements", "sample_sheets", "sample_units"])
def test_files_are_made_and_parsed_once(spark, name):
    """Filters stay above the parser, and files are dealt to all cores however few bytes they are made of."""
    from docloom.plans import queries

    made = queries.queries()[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(") == plan.count("ArrowEvalPython [made(") == 1
    assert made.rdd.getNumPartitions() >= 4
