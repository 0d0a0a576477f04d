"""The registered queries opN_<name> and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, fim, html_text, licenses, mixing, near_dup, periodic, pii, quality, secrets, substring, tokens


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op4_embedding_dedup(spark, sf_dir):
    return embed_dedup.link_vectors(_read(spark, sf_dir, "embeddings"), 0.95)


def op5_substring_dedup(spark, sf_dir):
    return substring.remove_repeated(_read(spark, sf_dir, "documents"), 50).drop("kept_text")


def op6_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_personal_data(spark, sf_dir):
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def op8_source_mix(spark, sf_dir):
    return mixing.mixed_words(_read(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _read(spark, sf_dir, "labels")))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.fill_in_middle(_read(spark, sf_dir, "documents")).drop("output")


def op12_html_text(spark, sf_dir):
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op13_periodic_runs(spark, sf_dir):
    return periodic.periodic_runs(_read(spark, sf_dir, "documents")).drop("collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_decontamination, op3_token_counts, op4_embedding_dedup, op5_substring_dedup, op6_near_dedup, op7_personal_data, op8_source_mix, op9_quality, op10_license_scan,
        op11_fill_in_middle, op12_html_text, op13_periodic_runs,
    )
}

ORACLE: dict[str, str] = {"op8_source_mix": mixing.ORACLE, "op10_license_scan": licenses.oracle(), "op11_fill_in_middle": fim.ORACLE}
