"""The registered queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import hnsw, html_text, imatch, licenses, log_bilinear, max_sketch, minhash, mixing, packing, pii, quality, rans, tokens, trie
from barlab.llm.common import table
from barlab.session import new_path


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: by language, thousands and hundreds of doc_id; every tenth is a licence file, every hundredth one level up."""
    doc = F.col("doc_id")
    folder = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.concat(F.lit("d"), F.floor(doc / 1000)))
    inner = F.concat(folder, F.lit("/e"), F.floor(doc / 100))
    path = (
        F.when(doc % 100 == 0, F.concat(folder, F.lit("/LICENSE-"), doc))
        .when(doc % 10 == 0, F.concat(inner, F.lit("/LICENSE-"), doc))
        .otherwise(F.concat(inner, F.lit("/part"), doc, F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(as_files(table(spark, sf_dir, "documents")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "llm-rans")
    rans.write_files(table(spark, sf_dir, "documents"), folder, tokens.default_vocabulary())
    return rans.digests(spark, folder)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_hnsw_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_embeddings(table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op8_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_token_files, op3_html_extraction, op4_imatch_fingerprints, op5_personal_data, op6_hnsw_embeddings, op7_source_mixing, op8_minhash_duplicates, op9_pairwise_quality, op10_best_fit_packing, op11_max_sketch_search, op12_log_bilinear_scores, op13_conversation_trie)
}

#: SQL for those that SQL can express; the others are held against plain Python in tests/llm.
ORACLE_SQL: dict[str, str] = {"op11_max_sketch_search": max_sketch.SEARCH_SQL, "op13_conversation_trie": trie.TRIE_SQL}
