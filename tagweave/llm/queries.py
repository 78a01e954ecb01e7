"""Queries opN_<name> over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, host_rules, language, mixing, packing, quality, sharding, simhash, spelling, suffixes, tokens, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.query,
    "op2_suffix_array": suffixes.query,
    "op3_host_rules": host_rules.query,
    "op4_language": language.query,
    "op5_decontamination": decontaminate.query,
    "op6_token_files": tokens.query,
    "op7_sharding": sharding.query,
    "op8_quality": quality.query,
    "op9_packing": packing.query,
    "op10_simhash": simhash.query,
    "op11_whitening": whitening.query,
    "op12_mixing": mixing.query,
    "op13_spelling": spelling.query,
}

#: Models, fingerprints, token ids and balanced maps aren't within SQL: tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_suffix_array": suffixes.ORACLE,
    "op3_host_rules": host_rules.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op12_mixing": mixing.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
