"""The driver's queries for the reference operators, and their DuckDB equivalents.

The test tables hold few of the cases that matter, so several queries derive
their input from them by the same expressions in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import embed as E
from docloom.operators import layout as L
from docloom.operators import normalize as N
from docloom.operators import search as S
from docloom.plans import file_queries

_Q, _SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _noisy(docs: DataFrame) -> DataFrame:
    """Documents with soft hyphens, no-break spaces, tabs, carriage returns, control characters and blank runs."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(". "), F.lit(". \t\r\n\n\n\n\n  "))
    head = F.when(F.col("doc_id") % 5 == 0, "­\x07 ").when(F.col("doc_id") % 5 == 1, " \r").otherwise("")
    return docs.withColumn("noisy", F.concat(head, text))


_NOISY_SQL = """(CASE WHEN doc_id % 5 = 0 THEN chr(173) || chr(7) || ' ' WHEN doc_id % 5 = 1 THEN chr(8195) || chr(13) ELSE '' END
  || replace(coalesce(text, ''), '. ', '.' || chr(160) || chr(9) || chr(13) || repeat(chr(10), 5) || '  '))"""


@_query("clean_text", f"SELECT doc_id, {X.clean_text_sql('t')} AS clean FROM (SELECT doc_id, {_NOISY_SQL} AS t FROM documents)")
def clean_text(spark, sf_dir):
    return _noisy(_table(spark, sf_dir, "documents")).select("doc_id", X.clean_text(F.col("noisy")).alias("clean"))


@_query("text_counts", f"SELECT doc_id, {X.word_count_sql('t')} AS words, length(t)::BIGINT AS chars, {X.line_count_sql('t')} AS lines FROM (SELECT doc_id, {_NOISY_SQL} AS t FROM documents)")
def text_counts(spark, sf_dir):
    c = F.col("noisy")
    return _noisy(_table(spark, sf_dir, "documents")).select("doc_id", X.word_count(c).alias("words"), X.char_count(c).alias("chars"), X.line_count(c).alias("lines"))


@_query("reading_time", f"SELECT o_orderkey, {X.reading_minutes_sql('w')} AS minutes FROM (SELECT o_orderkey, o_orderkey % 20000 AS w FROM orders)")
def reading_time(spark, sf_dir):
    return _table(spark, sf_dir, "orders").withColumn("w", F.col("o_orderkey") % 20000).select("o_orderkey", X.reading_minutes(F.col("w")).alias("minutes"))


@_query("printable_ratio", f"SELECT doc_id, round({X.printable_ratio_sql('t')}, 9) AS ratio FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[a-m]', 'é', 'g') AS t FROM documents)")
def printable_ratio(spark, sf_dir):
    odd = F.regexp_replace(F.coalesce("text", F.lit("")), "[a-m]", "é")
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(X.printable_ratio(odd), 9).alias("ratio"))


@_query(
    "ascii_strings",
    r"""SELECT doc_id, '[Binary Document Extracted Strings]' || chr(10) || chr(10) || array_to_string(regexp_extract_all(t, '[\x20-\x7E]{4,}'), chr(10)) AS strings
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[g-m]', 'é', 'g') AS t FROM documents)""",
)
def ascii_strings(spark, sf_dir):
    odd = F.regexp_replace(F.coalesce("text", F.lit("")), "[g-m]", "é")
    return _table(spark, sf_dir, "documents").select("doc_id", X.ascii_strings(F.encode(odd, "UTF-8")).alias("strings"))


_WORDS = ("handbook", "Remote_Policy", "guide", "playbook", "catalog", "rules", "standards", "report", "notes")
_ENDS = (".md", ".pdf", ".xlsx", ".tsv", ".csv", ".pptx", ".txt")


def _pick(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def _pick_sql(values, n):
    return f"([{', '.join(repr(v) for v in values)}])[({n} % {len(values)} + 1)::INT]"


@_query("document_type", f"SELECT doc_id, file_name, {X.document_type_sql('file_name', 'kind')} AS document_type FROM (SELECT doc_id, {_pick_sql(_WORDS, 'doc_id')} || '_' || doc_id || {_pick_sql(_ENDS, 'doc_id')} AS file_name, {_pick_sql(_ENDS, 'doc_id')} AS kind FROM documents)")
def document_type(spark, sf_dir):
    i = F.col("doc_id")
    named = _table(spark, sf_dir, "documents").select("doc_id", F.concat(_pick(_WORDS, i), F.lit("_"), i, _pick(_ENDS, i)).alias("file_name"), _pick(_ENDS, i).alias("kind"))
    return named.select("doc_id", "file_name", X.document_type(F.col("file_name"), F.col("kind")).alias("document_type"))


@_query(
    "path_parts",
    f"""SELECT page_id, p AS relative_path, n AS file_name, {X.suffix_sql('n')} AS suffix, {X.stem_sql('n')} AS stem,
        CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE 'root' END AS category
        FROM (SELECT page_id, p, regexp_extract(p, '[^/]*$') AS n FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') || CASE WHEN page_id % 3 = 0 THEN '.TAR.gz' ELSE '' END AS p FROM pages))""",
)
def path_parts(spark, sf_dir):
    from docloom.sources.files import as_files

    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".TAR.gz").otherwise(""))
    files = as_files(_table(spark, sf_dir, "pages").select(path.alias("relative_path"), F.col("page_id").cast("string").cast("binary").alias("content")))
    name = F.col("file_name")
    return files.select(F.col("content").cast("string").cast("long").alias("page_id"), "relative_path", "file_name", X.suffix(name).alias("suffix"), X.stem(name).alias("stem"), "category")


_TABLES_SQL = """WITH t AS (
  SELECT 'region_' || n_regionkey AS k, 'table' AS kind, '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('  | ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS c FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 'doc_' || doc_id, 'document', coalesce(text, '') FROM documents)
"""
_LINES_SQL = f"list_filter(list_transform(string_split(c, chr(10)), lambda l: {X.strip_sql('l')}), lambda l: starts_with(l, '|'))"


@_query(
    "table_info",
    _TABLES_SQL + f"""SELECT k, kind = 'table' OR (contains(c, '|') AND contains(c, chr(10))) AS is_table, len(l)::INT AS n_rows,
        coalesce(list_max(list_transform(l, lambda x: length(x) - length(replace(x, '|', '')) - 1)), 0)::INT AS n_columns, contains(c, '|') AS has_markdown_format
        FROM (SELECT *, {_LINES_SQL} AS l FROM t)""",
)
def table_info(spark, sf_dir):
    row = F.concat(F.lit("  | "), "n_nationkey", F.lit(" | "), "n_name", F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"])
    tables = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("| key | name |\n|---|---|\n"), F.array_join(rows, "\n")).alias("c"))
    tables = tables.select(F.concat(F.lit("region_"), "n_regionkey").alias("k"), F.lit("table").alias("kind"), "c")
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("k"), F.lit("document").alias("kind"), F.coalesce("text", F.lit("")).alias("c"))
    both = tables.union(docs).withColumn("i", X.table_info(F.col("c"), F.lit(0), F.lit(0)))
    return both.select("k", X.is_table(F.col("kind"), F.col("c")).alias("is_table"), F.col("i.rows").alias("n_rows"), F.col("i.columns").alias("n_columns"), F.col("i.has_markdown_format").alias("has_markdown_format"))


def _conversations(spark, sf_dir) -> DataFrame:
    """Each conversation as a parsed document: turns are elements, every third title is missing, every seventh turn is blank."""
    turns = _table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "page").when(F.col("role") == "assistant", "Slide").otherwise("section")
    title = F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("T"), "turn"))
    content = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, " \n ").otherwise(F.coalesce("text", F.lit("")))
    element = F.struct("turn", kind.alias("element_type"), title.alias("title"), content.alias("content"))
    metadata = N.ELEMENT_METADATA
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(element)).alias("e"))
    elements = F.transform("e", lambda x, i: F.struct(x["element_type"].alias("element_type"), (i + 1).alias("index"), x["title"].alias("title"), x["content"].alias("content"), F.lit(None).cast(metadata).alias("metadata")))
    name = F.concat(F.lit("policy_"), "conv_id", F.lit(".md"))
    return packed.select(
        F.concat(F.lit("/c/"), name).alias("file_path"), name.alias("file_name"), name.alias("relative_path"), F.lit(".md").alias("file_type"), F.lit("chat").alias("category"),
        F.array_join(F.transform("e", lambda x: x["content"]), "\n\n").alias("content"), elements.alias("elements"), F.lit(None).cast("string").alias("error"),
    )


_UNITS_SQL = f"""
WITH e AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
         CASE role WHEN 'user' THEN 'page' WHEN 'assistant' THEN 'slide' ELSE 'section' END AS kind,
         CASE WHEN turn % 3 = 0 THEN NULL ELSE 'T' || turn END AS title,
         CASE WHEN (conv_id + turn) % 7 = 0 THEN ' ' || chr(10) || ' ' ELSE coalesce(text, '') END AS raw FROM conversations
), c AS (SELECT *, {X.clean_text_sql('raw')} AS content, 'policy_' || conv_id || '.md' AS f FROM e
), u AS (SELECT *, coalesce(title, upper(substr(kind, 1, 1)) || substr(kind, 2) || ' ' || i) AS named FROM c WHERE content <> '')
"""


@_query(
    "units",
    _UNITS_SQL + f"""SELECT f || '_' || kind || '_' || i AS unit_id, kind AS unit_type, i::INT AS unit_index, named AS title, content, 'chat > ' || f || ' > ' || named AS breadcrumbs,
      CASE WHEN kind = 'page' THEN i::INT END AS page_number, CASE WHEN kind = 'slide' THEN i::INT END AS slide_number, CASE WHEN kind = 'section' THEN title END AS section_name,
      contains(content, '|') AND contains(content, chr(10)) AS is_table, length(content)::BIGINT AS char_count, {X.word_count_sql('content')} AS word_count, 'policy' AS document_type FROM u""",
)
def units(spark, sf_dir):
    u = N.units_of(_conversations(spark, sf_dir))
    return u.select("unit_id", "unit_type", "unit_index", "title", "content", "breadcrumbs", "page_number", "slide_number", "section_name", "is_table", "char_count", "word_count", "document_type")


@_query("flatten_units", _UNITS_SQL + f"SELECT f || '_' || kind || '_' || i AS unit_id, f AS file_name, 'chat' AS category, 'chat > ' || f || ' > ' || named AS breadcrumbs, named AS title, kind AS unit_type, content, {X.word_count_sql('content')} AS word_count, length(content)::BIGINT AS char_count, f AS doc_key FROM u")
def flatten_units(spark, sf_dir):
    return N.flat_units(N.normalize(_conversations(spark, sf_dir)))


@_query(
    "normalized_metadata",
    _UNITS_SQL + f""", d AS (SELECT conv_id, {X.clean_text_sql("string_agg(raw, chr(10) || chr(10) ORDER BY turn)")} AS content FROM e GROUP BY conv_id
    ), n AS (SELECT conv_id, count(*) AS units, count(*) FILTER (WHERE contains(content, '|') AND contains(content, chr(10))) AS tables FROM u GROUP BY conv_id
    ), w AS (SELECT conv_id, content, {X.word_count_sql('content')} AS words FROM d)
    SELECT 'policy_' || conv_id || '.md' AS file_name, coalesce(units, 0)::INT AS total_units, words AS total_words, length(content)::BIGINT AS total_chars, coalesce(tables, 0)::INT AS table_count,
      {X.reading_minutes_sql('words')} AS estimated_reading_time_minutes, coalesce(tables, 0) > 0 AS has_tables FROM w LEFT JOIN n USING (conv_id)""",
)
def normalized_metadata(spark, sf_dir):
    m = N.normalize(_conversations(spark, sf_dir)).select("metadata.*")
    return m.select("file_name", "total_units", "total_words", "total_chars", "table_count", "estimated_reading_time_minutes", "has_tables")


@_query(
    "normalized_totals",
    _UNITS_SQL + f""", d AS (SELECT conv_id, {X.clean_text_sql("string_agg(raw, chr(10) || chr(10) ORDER BY turn)")} AS content FROM e GROUP BY conv_id)
    SELECT count(*) AS total_documents, (SELECT count(*) FROM u)::BIGINT AS total_structural_units, sum(length(content))::BIGINT AS total_characters, sum({X.word_count_sql('content')})::BIGINT AS total_words,
      (SELECT count(*) FROM u WHERE contains(content, '|') AND contains(content, chr(10)))::BIGINT AS total_tables FROM d""",
)
def normalized_totals(spark, sf_dir):
    return N.normalized_totals(N.normalize(_conversations(spark, sf_dir)))


_SEGMENTS_SQL = """
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, a FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), m AS (SELECT doc_id, pos, a[pos] AS line, length(a[pos]) < 40 AS h FROM l WHERE trim(a[pos]) <> ''
), g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM m
), s AS (SELECT doc_id, g, max(line) FILTER (WHERE h) AS title, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT h) AS content FROM g GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INT AS "index", coalesce(title, 'Overview') AS title, content FROM s WHERE content IS NOT NULL
"""


@_query("heading_segments", _SEGMENTS_SQL)
def heading_segments(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.trim(line) != "")
    return L.heading_segments(docs, lines, lambda line: F.length(line) < 40)


def _as_parsed(docs: DataFrame) -> DataFrame:
    """Documents as parsed ones: category from language and source, every eleventh with an error and no elements."""
    bad = F.col("doc_id") % 11 == 0
    element = F.struct(F.lit("document").alias("element_type"), "text")
    return docs.select(
        F.concat_ws("/", "lang", "source").alias("category"), F.concat(F.lit("."), "lang").alias("file_type"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(bad, F.array().cast("array<struct<element_type: string, text: string>>")).otherwise(F.array(element)).alias("elements"), F.when(bad, "broken").alias("error"),
    )


@_query(
    "summary_stats",
    """SELECT count(*) AS total_documents, count(*) FILTER (WHERE doc_id % 11 <> 0)::BIGINT AS total_structural_elements, sum(length(coalesce(text, '')))::BIGINT AS total_characters,
       count(*) FILTER (WHERE doc_id % 11 = 0) AS error_count FROM documents""",
)
def summary_stats(spark, sf_dir):
    return N.summary_stats(_as_parsed(_table(spark, sf_dir, "documents"))).drop("categories", "file_formats")


@_query("count_by_category", "SELECT lang || '/' || source AS category, count(*) AS n FROM documents GROUP BY ALL")
def count_by_category(spark, sf_dir):
    found = N.summary_stats(_as_parsed(_table(spark, sf_dir, "documents")))
    return found.select(F.explode("categories").alias("category", "n"))


@_query("count_by_type", "SELECT '.' || lang AS file_type, count(*) AS n FROM documents GROUP BY ALL")
def count_by_type(spark, sf_dir):
    found = N.summary_stats(_as_parsed(_table(spark, sf_dir, "documents")))
    return found.select(F.explode("file_formats").alias("file_type", "n"))


def _prefix_query(key: str, is_query: bool):
    model, role = E.MODELS[key], "query" if is_query else "document"
    heads = ("", "  " + (model.query_prefix or "x "), "\n" + (model.document_prefix or "y "))
    parts = ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in heads)

    @_query(f"prefix_{key}_{role}", f"SELECT doc_id, {model.prefixed_sql('t', is_query)} AS prefixed FROM (SELECT doc_id, ([{parts}])[(doc_id % 3 + 1)::INT] || coalesce(text, '') AS t FROM documents)")
    def run(spark, sf_dir):
        text = F.concat(_pick(heads, F.col("doc_id")), F.coalesce("text", F.lit("")))
        return _table(spark, sf_dir, "documents").select("doc_id", model.prefixed(text, is_query).alias("prefixed"))


for _key in E.MODELS:
    for _is_query in (True, False):
        _prefix_query(_key, _is_query)


@_query(
    "l2_normalize",
    """SELECT vec_id, list_transform(s, lambda x: round((x / greatest(sqrt(list_inner_product(s, s)), 1e-12))::FLOAT::DOUBLE, 5)) AS unit
       FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label)) AS s FROM embeddings)""",
)
def l2_normalize(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    unit = F.transform(V.l2_normalize(v), lambda x: V.rounded(x, 5))
    return _table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("unit"))


def _first_vector(spark, sf_dir):
    row = _table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return row.embedding if row else []


_SCORES = {"cosine": "list_inner_product(e, q)", "dot": "list_inner_product(e, q)", "euclidean": "1 / (1 + list_distance(e, q))"}


def _top_query(metric: str, k: int):
    @_query(
        f"topk_{metric}",
        f"""SELECT vec_id, label, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id DESC)::INT AS rank FROM (
            SELECT vec_id, label, {_SCORES[metric]} AS s FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings))
            QUALIFY rank <= {k}""",
    )
    def run(spark, sf_dir):
        hits = S.top_k(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), k=k, metric=metric, key="vec_id")
        return hits.select("vec_id", "label", V.rounded(F.col("score"), 6).alias("score"), "rank")


for _metric, _k in (("cosine", 5), ("dot", 5), ("euclidean", 3)):
    _top_query(_metric, _k)


def _query_vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


_PAIRS_SQL = "SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"


@_query("topk_multi_query", f"SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id DESC)::INT AS rank FROM ({_PAIRS_SQL}) QUALIFY rank <= 5")
def topk_multi_query(spark, sf_dir):
    hits = S.top_k_many(_query_vectors(spark, sf_dir), _table(spark, sf_dir, "embeddings"), k=5, key="vec_id")
    return hits.select("query_id", "vec_id", V.rounded(F.col("score"), 6).alias("score"), "rank")


@_query("similarity_matrix", f"SELECT query_id, vec_id, round(s, 6) AS score FROM ({_PAIRS_SQL})")
def similarity_matrix(spark, sf_dir):
    pairs = S.similarity_matrix(_query_vectors(spark, sf_dir), _table(spark, sf_dir, "embeddings"), key="vec_id")
    return pairs.select("query_id", "vec_id", V.rounded(F.col("score"), 6).alias("score"))


@_query("snippet", "SELECT doc_id, substr(replace(coalesce(text, ''), chr(10), ' '), 1, 120) || '...' AS snippet FROM documents")
def snippet(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.coalesce("text", F.lit(""))).alias("snippet"))


_BOXES_SQL = """
WITH b AS (SELECT p_size AS page, p_partkey AS block, p_partkey % 97 AS x0, p_partkey % 97 + 9 AS x1, p_partkey % 89 AS y0, p_partkey % 89 + 7 AS y1 FROM part
), t AS (SELECT (s_suppkey % 50 + 1)::INT AS page, s_suppkey AS table_idx, s_suppkey % 71 AS x0, s_suppkey % 71 + 30 AS x1, s_suppkey % 61 AS y0, s_suppkey % 61 + 25 AS y1 FROM supplier
), m AS (SELECT b.page, block, min(table_idx) AS table_idx FROM b LEFT JOIN t ON b.page = t.page AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0 GROUP BY ALL)
"""


def _boxes(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    blocks = _table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), p.alias("block"), (p % 97).alias("x0"), (p % 97 + 9).alias("x1"), (p % 89).alias("y0"), (p % 89 + 7).alias("y1"))
    tables = _table(spark, sf_dir, "supplier").select((s % 50 + 1).cast("int").alias("page"), s.alias("table_idx"), (s % 71).alias("x0"), (s % 71 + 30).alias("x1"), (s % 61).alias("y0"), (s % 61 + 25).alias("y1"))
    return blocks, tables


@_query("spatial_first_match", _BOXES_SQL + "SELECT page, block, table_idx FROM m")
def spatial_first_match(spark, sf_dir):
    return L.first_overlap(*_boxes(spark, sf_dir))


@_query("emitted_tables", _BOXES_SQL + "SELECT page, table_idx, min(block) AS block FROM m WHERE table_idx IS NOT NULL GROUP BY ALL")
def emitted_tables(spark, sf_dir):
    return L.emitted_tables(L.first_overlap(*_boxes(spark, sf_dir)))


@_query("unmatched_tables", _BOXES_SQL + "SELECT page, table_idx FROM t WHERE (page, table_idx) NOT IN (SELECT page, table_idx FROM m WHERE table_idx IS NOT NULL)")
def unmatched_tables(spark, sf_dir):
    blocks, tables = _boxes(spark, sf_dir)
    return L.unmatched_tables(tables, L.first_overlap(blocks, tables)).select("page", "table_idx")


#: So many vectors in a row stand for the tokens of a text.
_TOKENS = 32


@_query("mean_pooling", f"SELECT text_id, list_transform(range(1, 65), lambda i: round(list_sum(list_transform(v, lambda x: x[i::INT])) / greatest(len(v), 1e-9), 5)) AS pooled FROM (SELECT vec_id // {_TOKENS} AS text_id, list(embedding::DOUBLE[]) FILTER (WHERE vec_id % 3 <> 0) AS v FROM embeddings GROUP BY 1)")
def mean_pooling(spark, sf_dir):
    """Every 32 vectors stand for a text's tokens; every third one is padding, which the mask leaves out."""
    packed = _table(spark, sf_dir, "embeddings").groupBy(F.expr(f"vec_id div {_TOKENS}").alias("text_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    pooled = V.mean_pool(F.transform("v", lambda x: x["embedding"]), F.transform("v", lambda x: F.when(x["vec_id"] % 3 == 0, 0).otherwise(1)))
    return packed.select("text_id", F.transform(pooled, lambda x: V.rounded(x, 5)).alias("pooled"))


@_query("cls_pooling", f"SELECT vec_id // {_TOKENS} AS text_id, list_transform(arg_min(embedding, vec_id)::DOUBLE[], lambda x: round(x, 5)) AS pooled FROM embeddings GROUP BY 1")
def cls_pooling(spark, sf_dir):
    packed = _table(spark, sf_dir, "embeddings").groupBy(F.expr(f"vec_id div {_TOKENS}").alias("text_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    first = V.cls_pool(F.transform("v", lambda x: x["embedding"]))
    return packed.select("text_id", F.transform(first, lambda x: V.rounded(x, 5)).alias("pooled"))


@_query(
    "search_report",
    """SELECT row_number() OVER (ORDER BY s DESC, vec_id DESC)::INT AS rank, round(s, 4) AS score, 'u' || vec_id AS unit_id, 'f' || label AS file_name, 'c > f' || label AS breadcrumbs,
       substr('line ' || vec_id || ' ' || repeat('x', 200), 1, 120) || '...' AS snippet FROM (
       SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) QUALIFY rank <= 3""",
)
def search_report(spark, sf_dir):
    """Ranked hits as people see them."""
    units = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("u"), "vec_id").alias("unit_id"), F.concat(F.lit("f"), "label").alias("file_name"), F.concat(F.lit("c > f"), "label").alias("breadcrumbs"),
        F.concat(F.lit("line "), "vec_id", F.lit("\n"), F.repeat(F.lit("x"), 200)).alias("content"), "embedding",
    )
    return S.report(S.top_k(units, _first_vector(spark, sf_dir), k=3, key="vec_id"))


@_query("cell_normalize", f"SELECT c_custkey, replace({X.strip_sql('t')}, chr(10), ' ') AS cell FROM (SELECT c_custkey, chr(160) || c_name || chr(10) || c_mktsegment || chr(9) AS t FROM customer)")
def cell_normalize(spark, sf_dir):
    raw = F.concat(F.lit(" "), "c_name", F.lit("\n"), "c_mktsegment", F.lit("\t"))
    return _table(spark, sf_dir, "customer").select("c_custkey", X.normalize_cell(raw).alias("cell"))


_EMBED_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN starts_with(t, 'query: ') OR starts_with(t, 'passage: ') THEN t ELSE 'passage: ' || t END AS t FROM (SELECT doc_id, {X.strip_sql("coalesce(text, '')")} AS t FROM documents)
), w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(t), '[{X.WS}]+'), lambda x: x <> '')) AS w FROM d
), n AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL
), v AS (SELECT w, unnest(range(1, 33)) AS j, md5(w) AS h FROM (SELECT DISTINCT w FROM n)
), c AS (SELECT w, j, instr('0123456789abcdef', substr(h, j::INT, 1)) - 1 - 7.5::DOUBLE AS x FROM v
), s AS (SELECT doc_id, j, sum(n * x) AS s FROM n JOIN c USING (w) GROUP BY ALL)
SELECT d.doc_id, coalesce(embedding, list_transform(range(32), lambda i: 0.0)) AS embedding FROM d LEFT JOIN (SELECT doc_id, list(s::DOUBLE ORDER BY j) AS embedding FROM s GROUP BY doc_id) USING (doc_id)"""


@_query("hash_embed", _EMBED_SQL)
def hash_embed(spark, sf_dir):
    """The sums before the L2 step, which are exact in both engines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = E.EmbeddingModel("hash", 32, "query: ", "passage: ", "hash", None, ("query: ", "passage: "))
    found = E.embed(docs, model, text_col="text", normalize=False, batch_size=256)
    return found.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))


@_query("json_pretty", "SELECT event_id || '.json' AS relative_path, '{' || chr(10) || '  ' || replace(substr(props, 2, length(props) - 2), ', ', ',' || chr(10) || '  ') || chr(10) || '}' AS content, 'dict' AS data_type FROM events")
def json_pretty(spark, sf_dir):
    from docloom.sources.parsers import parse

    events = _table(spark, sf_dir, "events")
    name = F.concat("event_id", F.lit(".json"))
    files = events.select(
        name.alias("path"), name.alias("file_name"), name.alias("relative_path"), F.array().cast("array<string>").alias("subfolders"), F.lit("root").alias("category"),
        F.length("props").cast("long").alias("file_size_bytes"), F.lit(".json").alias("extension"), F.encode("props", "UTF-8").alias("content"),
    )
    return parse(files).select("relative_path", "content", "metadata.data_type")


@_query("parse_text", f"SELECT doc_id || '.md' AS relative_path, t AS content, {X.line_count_sql('t')}::INT AS line_count, length(t)::BIGINT AS char_count, '.md' AS file_type, 1 AS n_elements FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM documents)")
def parse_text(spark, sf_dir):
    from docloom.sources.parsers import parse

    name = F.concat("doc_id", F.lit(".md"))
    files = _table(spark, sf_dir, "documents").select(
        name.alias("path"), name.alias("file_name"), name.alias("relative_path"), F.array().cast("array<string>").alias("subfolders"), F.lit("root").alias("category"),
        F.length("text").cast("long").alias("file_size_bytes"), F.lit(".md").alias("extension"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("content"),
    )
    return parse(files).select("relative_path", "content", "metadata.line_count", "metadata.char_count", "file_type", F.size("elements").alias("n_elements"))


@_query(
    "default_units",
    f"""SELECT doc_id || '.md_unit_1' AS unit_id, 'document' AS unit_type, 1::INT AS unit_index, doc_id::VARCHAR AS title, clean AS content, lang || ' > ' || doc_id || '.md' AS breadcrumbs,
        length(clean)::BIGINT AS char_count, {X.word_count_sql('clean')} AS word_count, doc_id || '.md' AS parent_document, lang AS category
        FROM (SELECT doc_id, lang, {X.clean_text_sql('t')} AS clean FROM (SELECT doc_id, lang, {_NOISY_SQL} AS t FROM documents))""",
)
def default_units(spark, sf_dir):
    """Documents without elements have one unit, which keeps an empty content too."""
    docs = _noisy(_table(spark, sf_dir, "documents"))
    name = F.concat("doc_id", F.lit(".md"))
    parsed = docs.select(
        name.alias("file_path"), name.alias("file_name"), name.alias("relative_path"), F.lit(".md").alias("file_type"), F.col("lang").alias("category"), F.col("noisy").alias("content"),
        F.array().cast(f"array<{N.ELEMENT}>").alias("elements"), F.lit(None).cast("string").alias("error"),
    )
    u = N.normalize(parsed).select(F.explode("units").alias("u"))
    return u.select(*[f"u.{c}" for c in ("unit_id", "unit_type", "unit_index", "title", "content", "breadcrumbs", "char_count", "word_count", "parent_document", "category")])


_LATIN_SQL = r"regexp_replace(coalesce(text, ''), '[^\x00-\x{FF}]', '?', 'g')"


def _file_rows(docs: DataFrame, name, content) -> DataFrame:
    from docloom.sources.files import as_files

    return as_files(docs.select(name.alias("relative_path"), content.alias("content")))


@_query("decode_text", f"SELECT doc_id || '.txt' AS relative_path, regexp_replace(replace({_LATIN_SQL}, chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g') AS content, length({_LATIN_SQL})::BIGINT AS char_count FROM documents")
def decode_text(spark, sf_dir):
    """Bytes that are no UTF-8 are read as Latin-1; line ends become line feeds."""
    from docloom.sources.parsers import parse

    latin = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\xFF]", "?")
    content = F.encode(F.replace(latin, F.lit("\n"), F.lit("\r\n")), "ISO-8859-1")
    files = _file_rows(_table(spark, sf_dir, "documents"), F.concat("doc_id", F.lit(".txt")), content)
    return parse(files).select("relative_path", "content", "metadata.char_count")


@_query(
    "fallback_route",
    f"""SELECT doc_id || '.bin' AS relative_path, CASE WHEN {X.printable_ratio_sql('t')} < 0.6 THEN '[Binary Document Extracted Strings]' || chr(10) || chr(10) || array_to_string(regexp_extract_all(t, '[\x20-\x7E]{{4,}}'), chr(10)) ELSE t END AS content,
        'universal_fallback' AS parsed_via, '.bin' AS file_type FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(coalesce(text, ''), '[a-p]', 'é', 'g') ELSE coalesce(text, '') END AS t FROM documents)""",
)
def fallback_route(spark, sf_dir):
    """Unknown files: their text, or the readable runs of their bytes if too little of them is readable."""
    from docloom.sources.parsers import parse

    text = F.coalesce("text", F.lit(""))
    odd = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(text, "[a-p]", "é")).otherwise(text)
    files = _file_rows(_table(spark, sf_dir, "documents"), F.concat("doc_id", F.lit(".bin")), F.encode(odd, "UTF-8"))
    return parse(files).select("relative_path", "content", "metadata.parsed_via", "file_type")


@_query("report_paths", r"SELECT DISTINCT regexp_replace(p, '([^/])\.[^./]+$', '\1') || '_parsed.txt' AS path FROM (SELECT lang || '/' || doc_id || (CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.md' ELSE '.tar.gz' END) AS p FROM documents)")
def report_paths(spark, sf_dir):
    """Where the reports of a tree go: its folders, and stems with a new ending."""
    from docloom.ship import shared_folder
    from docloom.sources.sinks import write_texts

    ending = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".tar.gz")
    root = shared_folder(spark, "reports")
    written = write_texts(_table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "doc_id", ending).alias("relative_path"), F.lit("x").alias("text")), root, "_parsed")
    return written.select(F.substring_index("path", root.rpartition("/")[2] + "/", -1).alias("path"))


@_query(
    "load_normalized",
    _UNITS_SQL + f"SELECT f || '_' || kind || '_' || i AS unit_id, f AS file_name, 'chat' AS category, 'chat > ' || f || ' > ' || named AS breadcrumbs, named AS title, kind AS unit_type, content, {X.word_count_sql('content')} AS word_count, length(content)::BIGINT AS char_count FROM u",
)
def load_normalized(spark, sf_dir):
    """Normalised documents written to one JSON file, and read back as flat units."""
    from docloom.ship import shared_folder
    from docloom.sources.sinks import export_normalized

    root = shared_folder(spark, "normalized")
    export_normalized(N.normalize(_conversations(spark, sf_dir)), root)
    return N.load_normalized_dataset(spark, f"{root}/normalized_dataset_summary.json")


@_query("summary_file", "SELECT count(*) AS total_documents, count(*) AS total_structural_elements, sum(length(n_name) + 2)::BIGINT AS total_characters, 0::BIGINT AS error_count, count(*) AS n_documents FROM nation")
def summary_file(spark, sf_dir):
    """The dataset summary, written to one JSON file and read back."""
    from docloom.ship import shared_folder
    from docloom.sources.parsers import parse
    from docloom.sources.sinks import export_parsed

    root = shared_folder(spark, "summary")
    nations = _table(spark, sf_dir, "nation")
    files = _file_rows(nations, F.concat("n_regionkey", F.lit("/"), "n_name", F.lit(".txt")), F.encode(F.concat(F.lit("# "), "n_name"), "UTF-8"))
    export_parsed(parse(files), root)
    told = spark.read.json(f"{root}/dataset_summary.json", multiLine=True)
    return told.select(*[f"stats.{c}" for c in ("total_documents", "total_structural_elements", "total_characters", "error_count")], F.size("documents").cast("long").alias("n_documents"))


@_query("thousands", "SELECT o_orderkey, format('{:,}', o_orderkey * 1237) AS shown FROM orders")
def thousands(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.thousands(F.col("o_orderkey") * 1237).alias("shown"))


_REPORT_SQL = _UNITS_SQL + f"""
, d AS (SELECT conv_id, 'policy_' || conv_id || '.md' AS f, {X.clean_text_sql("string_agg(raw, chr(10) || chr(10) ORDER BY turn)")} AS content FROM e GROUP BY conv_id
), t AS (SELECT *, kind = 'table' OR (contains(content, '|') AND contains(content, chr(10))) AS tab, list_filter(list_transform(string_split(content, chr(10)), lambda l: {X.strip_sql('l')}), lambda l: starts_with(l, '|')) AS l FROM u
), p AS (SELECT conv_id, i, concat_ws(chr(10),
    '• ID: ' || f || '_' || kind || '_' || i, '  Type: ' || upper(kind) || ' | Title: ' || named || ' ' || CASE WHEN tab THEN '[TABLE FORMAT]' ELSE '' END, '  Breadcrumbs: chat > ' || f || ' > ' || named,
    CASE WHEN kind = 'page' THEN '  Page: ' || i END, CASE WHEN kind = 'slide' THEN '  Slide: ' || i END, CASE WHEN kind = 'section' AND title <> '' THEN '  Section: ' || title END,
    CASE WHEN tab THEN '  Table Info: {{''rows'': ' || len(l) || ', ''columns'': ' || coalesce(list_max(list_transform(l, lambda x: length(x) - length(replace(x, '|', '')) - 1)), 0) || ', ''has_markdown_format'': ' || CASE WHEN contains(content, '|') THEN 'True' ELSE 'False' END || '}}' END,
    '  Length: ' || format('{{:,}}', length(content)) || ' chars (' || {X.word_count_sql('content')} || ' words)') || chr(10) AS listed,
    '=== [' || upper(kind) || ' ' || i || ': ' || named || '] ===' || chr(10) || 'Breadcrumbs: chat > ' || f || ' > ' || named || chr(10) || content || chr(10) AS full_text, tab FROM t
), g AS (SELECT conv_id, string_agg(listed, chr(10) ORDER BY i) AS listed, string_agg(full_text, chr(10) ORDER BY i) AS full_text, count(*) AS n, count(*) FILTER (WHERE tab) AS tables FROM p GROUP BY conv_id)
SELECT f AS relative_path, concat_ws(chr(10), repeat('=', 85), 'DOCUMENT        : ' || f, 'RELATIVE PATH   : ' || f, 'CATEGORY        : chat', 'DOCUMENT TYPE   : policy', 'FILE TYPE       : .md',
  'TOTAL UNITS     : ' || coalesce(n, 0) || ' unit(s)', 'TOTAL WORDS     : ' || format('{{:,}}', {X.word_count_sql('content')}), 'TOTAL CHARACTERS: ' || format('{{:,}}', length(content)), 'TABLE COUNT     : ' || coalesce(tables, 0),
  repeat('=', 85), chr(10), '--- STRUCTURAL UNITS & BREADCRUMBS ---', listed, repeat('=', 85), '--- NORMALIZED CONTENT ---' || chr(10), full_text) AS text FROM d LEFT JOIN g USING (conv_id)
"""


@_query("report_texts", _REPORT_SQL)
def report_texts(spark, sf_dir):
    from docloom.sources.sinks import normalized_text

    return normalized_text(N.normalize(_conversations(spark, sf_dir)))


def queries() -> dict:
    return _Q | file_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | file_queries.oracle_sql()
