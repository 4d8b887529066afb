"""The queries op1 to op13 and the pipeline, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import bpe, decontamination, embeddings, fingerprints, language, lines, minhash, mixing, packing, periods, repair, toolcalls, toxicity
from siltworks.llm.common import crc_bucket, ship, table

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _REGISTRY[name] = run
        if oracle:
            _ORACLE[name] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


@query("op1_minhash_near_dedup", minhash.ORACLE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op2_source_mix", mixing.ORACLE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op3_embedding_near_dedup", embeddings.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


@query("op4_imatch_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


@query("op5_language_mixture")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit_languages(docs, crc_bucket(F.col("doc_id"), 4) != 2)
    found = language.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(table(spark, sf_dir, "documents"))


@query("op7_line_dedup", lines.ORACLE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op9_compression_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_table(docs, labels, crc_bucket(F.col("doc_id"), 3) != 1)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_tool_call_linking", toolcalls.ORACLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.chat_report(table(spark, sf_dir, "conversations"))


@query("op11_conversation_repair", repair.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(table(spark, sf_dir, "documents"))


@query("op13_winnowing_decontamination", decontamination.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
