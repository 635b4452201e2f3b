"""A training-corpus pipeline: five stages, each one operator of ``docloom.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. Between stages the documents are
written as Parquet and read again, so a lost executor repeats one stage at most.

Documents may have columns of any name beside ``doc_id``, ``text`` and
``source``: every stage works on columns under names of its own and gives all
columns back as they were. Nulls, empty texts and repeated rows are handled as
each operator's docstring says (null and empty texts pass the first three
stages, and mixing takes nothing of them); empty tables pass through as empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard, mixing, tokens, toxicity
from docloom.llm.shared import Columns, Workspace

#: No stage of models, exact set similarity and token ids has an SQL form; see tests/llm for brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier calls toxic go."""
    own = Columns(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(own.at("doc_id")), "toxic")
    patterns, weights, _ = toxicity.fit(own.plain, labels, id_col=own.at("doc_id"), text_col=own.at("text"))
    return own.back(toxicity.score(own.plain, patterns, weights, text_col=own.at("text")).where("predicted = 0"))


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 on five-word shingles the one with the smallest id stays."""
    return jaccard.keep_representatives(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go."""
    own = Columns(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return own.back(decontaminate.drop_contaminated(decontaminate.find_contamination(own.plain, benchmark, text_col=own.at("text"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source near its target; documents repeat at most three times."""
    own = Columns(docs)
    return own.back(mixing.emit_copies(mixing.mix_sources(own.plain, id_col=own.at("doc_id"), text_col=own.at("text"), source_col=own.at("source"))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder; one row per document, read back from them."""
    root = Workspace(spark, "corpus").path("shards")
    shards = tokens.write_tokens(docs, root, tokenizer=tokens.production_tokenizer(), end_id=2)
    return tokens.read_tokens(spark, shards, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_per_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = work.table(out, name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
