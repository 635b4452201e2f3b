"""Parsed documents to normalised documents, flat units, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.sources.jsonarray import read_records

#: Name and type of what a parser may tell about an element, and about a document.
ELEMENT_METADATA_FIELDS = {"page_number": "int", "table_count": "int", "has_tables": "boolean", "has_notes": "boolean", "rows": "int", "columns": "int", "line_count": "int"}
METADATA_FIELDS = {
    "relative_path": "string", "subfolders": "array<string>", "file_size_bytes": "bigint", "total_pages": "int", "author": "string", "title": "string", "creation_date": "string",
    "paragraph_count": "int", "table_count": "int", "section_count": "int", "total_slides": "int", "total_sheets": "int", "sheet_names": "array<string>", "rows": "int", "columns": "int",
    "data_type": "string", "line_count": "int", "char_count": "bigint", "parsed_via": "string",
}


def _ddl(fields: dict[str, str]) -> str:
    return f"struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>"


ELEMENT_METADATA = _ddl(ELEMENT_METADATA_FIELDS)
ELEMENT = f"struct<element_type: string, index: int, title: string, content: string, metadata: {ELEMENT_METADATA}>"
PARSED_METADATA = _ddl(METADATA_FIELDS)
_TABLE_INFO = "struct<rows: int, columns: int, has_markdown_format: boolean>"


def told(fields: dict[str, str], **known: Column) -> Column:
    """A struct of all ``fields``, null but for the known ones."""
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def unit_array(document_type: Column) -> Column:
    """The normalised units of a parsed document (file_name, category, relative_path, content, elements), in order.

    The index of an element is its position, gaps stay where an element is
    empty after cleaning. A document without elements has one default unit.
    """
    name, category, path = F.col("file_name"), F.col("category"), F.col("relative_path")

    def unit(content: Column, index: Column, **of: Column) -> Column:
        fields = {"unit_id": "string", "unit_type": "string", "title": "string", "breadcrumbs": "string", "page_number": "int", "slide_number": "int", "sheet_name": "string", "section_name": "string"}
        return F.struct(
            index.cast("int").alias("unit_index"), of["unit_id"].alias("unit_id"), of["unit_type"].alias("unit_type"), of["title"].alias("title"), content.alias("content"),
            *[of.get(n, F.lit(None)).cast(t).alias(n) for n, t in list(fields.items())[3:]],
            of["is_table"].alias("is_table"), of.get("table_info", F.lit(None)).cast(_TABLE_INFO).alias("table_info"), X.char_count(content).alias("char_count"), X.word_count(content).alias("word_count"),
            of.get("metadata", F.lit(None)).cast(ELEMENT_METADATA).alias("metadata"), name.alias("parent_document"), category.alias("category"), document_type.alias("document_type"), path.alias("relative_path"),
        )

    def of_element(x: Column) -> Column:
        e, content, index = x["e"], x["content"], x["i"] + 1
        kind, title = F.lower(e["element_type"]), e["title"]
        named = F.when(F.coalesce(title, F.lit("")) == "", F.concat(X.capitalize(e["element_type"]), F.lit(" "), index)).otherwise(title)
        table = X.is_table(kind, content)
        return unit(
            content, index, unit_id=F.concat_ws("_", name, kind, index), unit_type=kind, title=named, breadcrumbs=F.concat_ws(" > ", category, name, named),
            page_number=F.coalesce(e["metadata"]["page_number"], F.when(kind == "page", index)), slide_number=F.when(kind == "slide", index),
            sheet_name=F.when(kind == "sheet", title), section_name=F.when(kind == "section", title), is_table=table,
            table_info=F.when(table, X.table_info(content, e["metadata"]["rows"], e["metadata"]["columns"])), metadata=e["metadata"],
        )

    def whole(content: Column) -> Column:
        return unit(content, F.lit(1), unit_id=F.concat(name, F.lit("_unit_1")), unit_type=F.lit("document"), title=X.stem(name), breadcrumbs=F.concat_ws(" > ", category, name), is_table=F.lit(False))

    cleaned = F.transform("elements", lambda e, i: F.struct(e.alias("e"), i.alias("i"), X.clean_text(e["content"]).alias("content")))
    filled = F.transform(F.filter(cleaned, lambda x: x["content"] != ""), of_element)
    return F.when(F.size("elements") > 0, filled).otherwise(F.transform(F.array(X.clean_text(F.col("content"))), whole))


def units_of(parsed: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per normalised unit of ``parsed``, with the columns named in ``keep``."""
    have = parsed.withColumn("document_type", X.document_type(F.col("file_name"), F.col("file_type")))
    base = ("file_name", "category", "relative_path", "document_type", *keep)
    each = have.select(*base, F.explode(unit_array(F.col("document_type"))).alias("u"))
    shown = (
        "unit_id", "unit_type", "unit_index", "title", "content", "breadcrumbs", "page_number", "slide_number", "sheet_name", "section_name",
        "is_table", "table_info", "char_count", "word_count", "metadata",
    )
    return each.select(*base, *[f"u.{c}" for c in shown])


def normalize(parsed: DataFrame) -> DataFrame:
    """One row per document with cleaned content, ``units`` (array of structs in order) and enriched ``metadata``.

    All of it happens within the row: no shuffle, and two documents of one path stay apart.
    """
    typed = parsed.withColumn("document_type", X.document_type(F.col("file_name"), F.col("file_type")))
    docs = typed.withColumn("units", unit_array(F.col("document_type"))).select(
        "file_path", "file_name", "relative_path", "file_type", "category", "document_type", X.clean_text(F.col("content")).alias("content"), "error",
        F.coalesce("units", F.array().cast(_units_type(typed))).alias("units"),
    )
    words, tables = X.word_count(F.col("content")), F.size(F.filter("units", lambda u: u["is_table"]))
    counted = docs.withColumn("_counts", X.let(F.struct(words.alias("words"), tables.alias("tables")), lambda c: c))
    n, t = F.col("_counts.words"), F.col("_counts.tables")
    return counted.withColumn(
        "metadata",
        F.struct(
            "file_name", "relative_path", "category", "file_type", "document_type", F.size("units").alias("total_units"), n.alias("total_words"),
            X.char_count(F.col("content")).alias("total_chars"), t.alias("table_count"), X.reading_minutes(n).alias("estimated_reading_time_minutes"), (t > 0).alias("has_tables"),
        ),
    ).drop("_counts")


def _units_type(typed: DataFrame):
    return typed.select(unit_array(F.col("document_type")).alias("u")).schema["u"].dataType


def flat_units(normalized: DataFrame) -> DataFrame:
    """The nine-column query table; documents without units vanish. ``doc_key`` tells equal unit ids of two folders apart."""
    return normalized.select(F.col("relative_path").alias("doc_key"), F.explode("units").alias("u")).select(
        "u.unit_id", F.col("u.parent_document").alias("file_name"), "u.category", "u.breadcrumbs", "u.title", "u.unit_type", "u.content", "u.word_count", "u.char_count", "doc_key"
    )


def load_normalized_dataset(spark, path: str, *, one_file: bool = True) -> DataFrame:
    """Flat units from a summary JSON file with a ``documents`` list, read in splits; missing keys become null.

    With ``one_file=False`` the path is a folder of documents, one JSON object a
    line, as the exports of this package write them.
    """
    unit = "struct<unit_id: string, unit_type: string, title: string, content: string, breadcrumbs: string, word_count: bigint, char_count: bigint>"
    fields = (("file_name", "string"), ("category", "string"), ("units", f"array<{unit}>"))
    if one_file:
        docs = read_records(spark, path, ", ".join(map(" ".join, fields)), name="documents").select(F.struct("*").alias("d"))
    else:
        docs = spark.read.schema(", ".join(map(" ".join, fields))).json(path).select(F.struct("*").alias("d"))
    flat = docs.select("d.file_name", "d.category", F.explode("d.units").alias("u"))
    return flat.select("u.unit_id", "file_name", "category", "u.breadcrumbs", "u.title", "u.unit_type", "u.content", "u.word_count", "u.char_count")


def summary_stats(parsed: DataFrame) -> DataFrame:
    """One row: documents, elements, characters, errors, and counts by category and by format as maps.

    One scan: grouping sets give the totals and both histograms, and the few
    rows they leave are folded into one.
    """
    measured = parsed.select("category", "file_type", F.greatest(F.size("elements"), F.lit(0)).cast("long").alias("_e"), X.char_count(F.col("content")).alias("_c"), "error")
    sets = measured.groupingSets([[F.col("category")], [F.col("file_type")], []], "category", "file_type").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("_e").alias("_e"), F.sum("_c").alias("_c"), F.count_if(F.col("error").isNotNull()).alias("_x")
    )
    total = lambda c: F.coalesce(F.max(F.when(F.col("_g") == 3, F.col(c))), F.lit(0)).cast("long")
    counts = lambda g, c: F.map_from_entries(F.collect_list(F.when((F.col("_g") == g) & F.col(c).isNotNull(), F.struct(c, "n"))))
    return sets.agg(
        total("n").alias("total_documents"), total("_e").alias("total_structural_elements"), total("_c").alias("total_characters"), total("_x").alias("error_count"),
        counts(1, "category").alias("categories"), counts(2, "file_type").alias("file_formats"),
    )


def normalized_totals(normalized: DataFrame) -> DataFrame:
    parts = {"total_structural_units": "total_units", "total_characters": "total_chars", "total_words": "total_words", "total_tables": "table_count"}
    return normalized.agg(F.count("*").alias("total_documents"), *[F.coalesce(F.sum(F.col(f"metadata.{c}")), F.lit(0)).cast("long").alias(n) for n, c in parts.items()])
