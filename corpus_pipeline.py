"""The corpus pipeline: stages over `documents`, each written as a table and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from geoloom.llm.queries import PACKING_TOKENIZER, table, tokenizer_path
from geoloom.llm.store import settle

#: No SQL expresses the trained classifier, MinHash or the packing; tests/llm holds run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores 0.5 or more go.  It learns from the labelled rows of documents.  Null and empty texts stay; rows
    that repeat a document stay or go together; an empty table stays empty."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that match an earlier one go, and documents of which nothing is left.  n_chars follows the text.  Null texts, and texts
    without words, stay; rows that repeat doc_id and text are one document and get the same lines; of equal lines the one in the
    lowest doc_id (null first) stays; an empty table stays empty."""
    names = docs.columns
    out = line_dedup.dedup_documents(docs, drop_emptied=True)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.selectExpr(*[c if c != "n_chars" else f"cast(case when n_lines_removed > 0 then length(text) else n_chars end as {kind.simpleString()}) as n_chars" for c in names])
    return out.select(*names)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents, the one with the least doc_id stays (of rows that repeat it, one).  Null texts, texts without
    words and rows without doc_id stay; an empty table stays empty."""
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.  Null and empty texts stay; rows that repeat a document stay or go together; without
    items all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed in sequences.  The last of five stages in one session: a small table of words,
    which goes with its task.  Null and empty texts are one piece each; rows that repeat a document are packed each."""
    return packing.pack_documents(docs, tokenizer_path(PACKING_TOKENIZER), words=100_000, chunk=1 << 20, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
