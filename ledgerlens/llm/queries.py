"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlens.llm import alignment, decontamination, exact_dedup, license_scan, mixing, ngram_join, pii, secret_scan, sharded_lloyd, token_counts, token_files, toxicity, warc_store


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_mixing": mixing.op7_mixing,
        "op8_pii": pii.op8_pii,
        "op9_warc": warc_store.op9_warc,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_token_ids": token_files.op11_token_ids,
        "op12_alignment": alignment.op12_alignment,
        "op13_sharded_lloyd": sharded_lloyd.op13_sharded_lloyd,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan.ORACLE_SQL,
        "op2_license_scan": license_scan.ORACLE_SQL,
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op6_ngram_join": ngram_join.ORACLE_SQL,
        "op7_mixing": mixing.ORACLE_SQL,
        "op9_warc": warc_store.ORACLE_SQL,
        "op13_sharded_lloyd": sharded_lloyd.ORACLE_SQL,
    }
