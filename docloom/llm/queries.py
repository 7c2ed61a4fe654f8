"""The registered queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, codes, exact_dedup, fixity, html_extract, langid, lexical, line_dedup, media, mixing, near_dedup, quality, simhash
from docloom.llm.common import crc_mod, table


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the split pattern of the contract's tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The classifier fitted on the rows that aren't held out."""
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return langid.predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_line_dedup": op2_line_dedup,
        "op3_html": op3_html,
        "op4_near_dedup": op4_near_dedup,
        "op5_fixity": op5_fixity,
        "op6_language": op6_language,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_bpe": op8_bpe,
        "op9_mixing": op9_mixing,
        "op10_media": op10_media,
        "op11_lexical": op11_lexical,
        "op12_codes": op12_codes,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op5_fixity": fixity.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op9_mixing": mixing.ORACLE, "op11_lexical": lexical.ORACLE, "op12_codes": codes.ORACLE}
