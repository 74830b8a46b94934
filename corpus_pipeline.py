"""A training-data pipeline over the table documents, from five operators of corpusmill.llm.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. Rows that share a doc_id are one document and stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, ngram_join, packing, substring, toxicity
from corpusmill.plans.storage import Scratch

TOXIC_FROM = 0.3


_READ = ("doc_id", "text", "source")


def _held(docs: DataFrame) -> DataFrame:
    """What the operators read, and all other columns as one struct, so that none of their names meets an operator's."""
    return docs.select(*_READ, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in _READ]).alias("row"))


def _columns(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, but for new ones."""
    own = lambda c: new[c] if c in new else F.col(c) if c in _READ else F.col("row").getField(c)
    return rows.select(*[own(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of TOXIC_FROM or more go; all columns of the others stay.

    Null and empty texts have no evidence and stay. Null ids stay, and are never learnt from. Of an id labelled twice
    the largest label counts. Without labels nothing goes. Empty table: empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    rows = toxicity.score(_held(docs), *toxicity.fit(docs, labels), carry=True)
    return _columns(rows.filter(F.col("score") < TOXIC_FROM), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity 0.8 or more) the smallest doc_id stays.

    Texts without words are no copies of each other and stay, and so do rows without id. Rows that share an id stay
    or go together. All columns stay. Empty table: empty result.
    """
    gone = ngram_join.join(docs).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that a smaller doc_id has go; a text that loses all its words goes as a whole.

    Texts that lose nothing stay as they are; in others the words left are joined by one space, and n_chars counts
    them anew. Null texts become empty ones. Null ids are larger than all. Rows that share an id take nothing from each
    other. Other columns stay as they are. Empty table: empty result.
    """
    rows = substring.dedup(_held(docs), whole=True).filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row").getField("n_chars").cast("long"))
    return _columns(rows, docs, text=F.col("kept"), n_chars=n_chars)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is drawn towards its source's target; documents are taken whole.

    Sources are those of ``op1``: a null source is one of its own, empty and null texts have size 0 and are drawn as
    any other document. All columns stay. Empty table: empty result.
    """
    return _columns(mixing.mix(_held(docs), whole=True), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 2048 tokens.

    A document drawn twice is packed twice. Null and empty texts are the end id alone; null ids stay null. Columns but
    doc_id and text are not read. Empty table: empty result.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL cannot express the model, the mix and the packing; tests hold each stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's result is a written table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
