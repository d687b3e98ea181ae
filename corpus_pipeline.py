"""A corpus in five stages, from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it. The first
four return the columns of ``documents``; every stage judges all that the one before kept.

1. toxicity: documents that a model learned from the labels scores 0.3 or more go.
2. line dedup: lines that an earlier document holds too go; documents stay, if need be with an empty text.
3. near copies: one document of each group of near copies stays, the one with the smallest id;
   rows without an id are documents too, and rows that share one are judged each by itself.
4. mixing: sources are brought to their target weights; a document comes as often as the mix takes it.
5. tokens: one row per document of the mix with its ids and the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirworks.llm import bpe, jaccard, line_dedup, mixing, toxicity
from weirworks.llm import queries as registered
from weirworks.session import prepare, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.3, unchanged; a null text counts as empty, and an empty one scores as one without a match.

    Ids may be null or shared: every row is judged by its own text, so repeated rows go or stay together. Only the learning looks
    at ids. Without toxic or clean labels among the documents every row has the share of toxic labels as its score, and
    without any labels half, so that no row passes. An empty table stays empty.
    """
    return toxicity.clean_documents(docs, registered.toxicity_model(spark, docs, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines of ten characters or more that a row with a smaller id holds too.

    Rows that share an id are one document, rows without an id one more that comes last. A null text stays null, an
    empty one is one empty line. An empty table stays empty.
    """
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows with nearly the same text the one with the smallest id (of equal ids one), unchanged.

    Texts without words, null ones too, are one group. Rows without an id are judged by their text like all others and come
    last. An empty table stays empty.
    """
    return jaccard.one_row_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most twice. A null source is a source of its own, the last.

    A row without words takes no room in the budget and stays once. Rows that share an id are drawn each by itself. An
    empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and decoded of every row, repeated rows repeatedly; a null or empty text has no ids and an empty
    decoded text. An empty table stays empty.
    """
    return bpe.encode(docs.select("doc_id", "source", "text"), registered.tokenizer_path(), decoded="decoded").drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", to_tokens),
]

# The learned scores of the first stage have no SQL form; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = registered.QUERIES | {"pipeline": run}
ORACLES = registered.ORACLES | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
