"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, linededup, packing, quality, secrets, sharding, simhash, threads, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        token_files.op1_token_files,
        secrets.op2_secrets,
        langid.op3_language,
        sharding.op4_sharding,
        threads.op5_quotation_links,
        linededup.op6_line_dedup,
        quality.op7_quality,
        packing.op8_packing,
        decontaminate.op9_decontamination,
        simhash.op10_simhash,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op5_quotation_links": threads.ORACLE, "op9_decontamination": decontaminate.ORACLE}
