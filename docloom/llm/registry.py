"""The operators' queries: ``opN_<name>`` applies operator N, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.outliers import judge

    return judge(table(spark, sf_dir, "documents"))


def op3_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.packing import digest

    return digest(table(spark, sf_dir, "documents"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.licenses import document_files, scan

    return scan(document_files(table(spark, sf_dir, "documents")))


def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 2)


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.frames import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"))


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontaminate import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.conversations import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.negatives import mine, prepared

    return mine(prepared(table(spark, sf_dir, "embeddings")))


def op13_kneser_ney_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.languages import identify

    return identify(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


NAMES = ("op1_skip_chain_pii", "op2_mcd_outliers", "op3_gru_scores", "op4_hilbert_packing", "op5_quality_trees", "op6_license_inheritance", "op7_minhash_components", "op8_token_frames", "op9_linked_secrets", "op10_cgk_decontamination", "op11_turn_repair", "op12_hard_negatives", "op13_kneser_ney_languages", "pipeline")


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    from docloom.llm.licenses import oracle

    return {"op6_license_inheritance": oracle()}
