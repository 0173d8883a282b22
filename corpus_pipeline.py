"""The corpus pipeline: quality, language, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwright.llm import langid, ngram_join, packing, quality
from sortwright.staging import stage

#: Mean probability of the best language below which a text has none.
LANGUAGE_SCORE = 0.3
#: Near copies: word shingles of this width, of which this per cent of the union is common.
COPY_WORDS = 5
COPY_PERCENT = 80
#: Ids up to which those of dropped documents are broadcast; beyond it they are shuffled.
BROADCAST_IDS = 1 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the ordinal classifier selects: likely of the top grade.

    A null or empty text is graded as a text without words, and goes where such texts
    are rated poor; rows that repeat are graded alike, nulls in other columns and extra
    columns stay as they are, an empty table gives an empty one. Without usable ratings
    all rows stay.
    """
    labels = quality.grades_from_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.train(docs, labels)
    graded = quality.grade(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", F.col("text")), model, "__row")
    return graded.where("selected").select("__row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language the network tells: they have letters and a clear best language.

    Null and empty texts, and those without a letter, go. Rows that repeat are told
    alike, nulls in other columns and extra columns stay as they are, an empty table
    gives an empty one. With no language learned no text can be told from another, so all stay.
    """
    net = langid.train(docs)
    if not net.languages:
        return docs
    found = langid.predict(docs.withColumn("__row", F.struct(*docs.columns)).select("__row", F.col("text")), net, "__row")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select("__row.*")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component of near copies, once.

    Documents without words and rows without an id are no one's copies and stay. Rows
    that repeat both id and text of a kept document go. Extra columns stay as they are;
    an empty table gives an empty one.
    """
    groups = stage(ngram_join.components(docs, percent=COPY_PERCENT, width=COPY_WORDS), "components")
    copies = stage(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    kept = docs.join(_small(copies), "doc_id", "left_anti").select(docs.columns)
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stage(again, "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows and null ids are packed like
    any others, other columns are left out, an empty table gives no pieces.
    """
    return packing.pack(docs)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("packing", packing_stage),
]

#: The first stages are models and hash searches: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
