"""The named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, fingerprints, html_text, langid, ngram_join, packing, quality, quotes, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode_texts(_table(spark, sf_dir, "documents"))
    return bpe.decode_ids(ids).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(_table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades_from_labels(_table(spark, sf_dir, "labels")))
    return quality.grade(docs, model).withColumn("kept", F.col("selected"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs, net)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_embeddings": op3_embeddings,
    "op4_quality": op4_quality,
    "op5_quotes": op5_quotes,
    "op6_token_counts": op6_token_counts,
    "op7_html": op7_html,
    "op8_langid": op8_langid,
    "op9_fingerprints": op9_fingerprints,
    "op10_ngram_join": op10_ngram_join,
}

#: Vectors that take part, pairs of them at 0.9 or more, and what each reaches.
_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
 reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
 lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON lowest.x = vec_id LEFT JOIN degree ON degree.x = vec_id"""

#: Sets of four-word shingles, pairs by their common shingles, and what each document reaches.
_SHINGLES = """WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
 flat AS (SELECT DISTINCT doc_id, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
 named AS (SELECT t, row_number() OVER () AS k FROM flat GROUP BY t HAVING count(*) > 1), shared AS (SELECT doc_id, k FROM flat JOIN named USING (t)),
 sizes AS (SELECT doc_id, count(t) AS n FROM documents LEFT JOIN flat USING (doc_id) GROUP BY doc_id),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shared a JOIN shared b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
 near AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
 link AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
 reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT doc_id, n AS n_shingles, min(y) AS component_id FROM sizes JOIN reach ON x = doc_id GROUP BY ALL"""

ORACLES: dict[str, str] = {"op3_embeddings": _VECTORS, "op10_ngram_join": _SHINGLES}
