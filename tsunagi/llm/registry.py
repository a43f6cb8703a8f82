"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, exact_dedup, html_text, langid, line_dedup, near_dedup, rollups, secrets, substring_dedup, token_files, whitening


def queries() -> dict:
    found = [
        decontaminate.op1_decontaminate,
        line_dedup.op2_line_dedup,
        bpe.op3_bpe_codec,
        substring_dedup.op4_substring_dedup,
        exact_dedup.op5_exact_dedup,
        secrets.op6_secret_scan,
        rollups.op7_token_counts,
        html_text.op8_html_extraction,
        langid.op9_language_id,
        near_dedup.op10_near_dedup,
        alignment.op11_token_alignment,
        token_files.op12_token_files,
        whitening.op13_embedding_whitening,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op4_substring_dedup": substring_dedup.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op6_secret_scan": secrets.SQL,
        "op7_token_counts": rollups.SQL,
    }
