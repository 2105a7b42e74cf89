"""A training corpus from web documents: language, quality, near duplicates, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, language, mixing, pieces, quality
from graphloom.llm.common import maybe_in, narrowed, stored, table, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts."""
    names = [unused(n, docs.columns) for n in ("lang_pred", "score", "accepted")]
    return language.predict(docs, language.train(docs), names=names).filter(F.col(names[2])).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1."""
    names = [unused(n, docs.columns) for n in ("score", "predicted")]
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), names=names).filter(F.col(names[1]) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at 80 %, the one of the least id; a null id is the greatest.

    Rows are grouped by a number of their own, so ids may be null or occur again. Rows of one id are told
    apart by a hash of all columns. Rows without a word are in no group and all stay. Only rows that may have to go, as a
    broadcast filter of fixed size tells, are joined to those that do; the others' texts are not shuffled.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = stored(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*columns).alias("doc"), F.xxhash64(*columns).alias("print")), "rows")
    groups = jaccard.near_groups(rows.select("id", "doc.text"), 5, 80, id_col="id").select("id", "component_id")
    tied = stored(groups.filter("id <> component_id"), "tied")
    members = tied.unionByName(tied.select(F.col("component_id").alias("id"), "component_id").distinct())
    order = rows.select("id", F.struct(F.col("doc.doc_id").isNull().alias("none"), "doc.doc_id", "print", "id").alias("rank"))
    ranked = stored(members.join(narrowed(order, "id", members), "id"), "ranked")
    kept = ranked.groupBy("component_id").agg(F.min("rank")["id"].alias("id"))
    gone = stored(ranked.select("id").join(kept, "id", "left_anti"), "gone")
    maybe = maybe_in(rows, "id", gone)
    left = maybe.filter("_maybe").join(gone, "id", "left_anti")
    return maybe.filter("NOT _maybe").unionByName(left).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, as often as it takes them, in the hashed order of its shards."""
    plan, _ = mixing.mixture(docs, mixing.WEIGHTS, carry=True)
    return mixing.in_shards(plan).select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded text; the text itself is not in the output."""
    return pieces.encode(docs, pieces.default_model(), outputs="ids")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Models, connected components and token ids are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
