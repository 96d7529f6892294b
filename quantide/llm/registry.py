"""The queries of this package and their SQL."""

from __future__ import annotations

from quantide.llm import bpe, centroids, divergence, html_text, licenses, mixing, near_dedup, packing, quality, secrets, token_counts, topk, warc


def queries() -> dict:
    return {
        "op1_warc_transactions": warc.op1_warc_transactions,
        "op2_poisson_mix": mixing.op2_poisson_mix,
        "op3_main_text": html_text.op3_main_text,
        "op4_near_duplicates": near_dedup.op4_near_duplicates,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_exact_top_k": topk.op6_exact_top_k,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_centroid_clustering": centroids.op12_centroid_clustering,
        "op13_best_fit_packing": packing.op13_best_fit_packing,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc_transactions": warc.ORACLE,
        "op2_poisson_mix": mixing.ORACLE,
        "op6_exact_top_k": topk.ORACLE,
        "op10_quality_rules": quality.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_centroid_clustering": centroids.ORACLE,
    }
