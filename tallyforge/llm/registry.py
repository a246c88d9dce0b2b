"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from tallyforge.llm import bpe, chat, decontaminate, fingerprint, quality, secrets_scan, sharding, simhash, token_count, url_filter


def queries() -> dict:
    """Query name to ``f(spark, sf_dir) -> DataFrame``."""
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_sharding": sharding.op2_sharding,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_secrets": secrets_scan.op4_secrets,
        "op5_bpe": bpe.op5_bpe,
        "op6_quality": quality.op6_quality,
        "op7_fingerprint": fingerprint.op7_fingerprint,
        "op8_token_count": token_count.op8_token_count,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_chat": chat.op10_chat,
    }


def oracle_sql() -> dict:
    """Query name to DuckDB SQL; operators that SQL cannot express have none."""
    return {
        "op2_sharding": sharding.OP2_SQL,
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
        "op10_chat": chat.OP10_SQL,
    }
