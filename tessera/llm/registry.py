"""Queries of this package, and SQL where it can express them."""

from __future__ import annotations

from tessera.llm import decontaminate, hnsw, html_text, licenses, line_dedup, packing, quality, simhash, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_embedding_dedup": hnsw.op1_embedding_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_quality": quality.op6_quality,
        "op7_packing": packing.op7_packing,
        "op8_html_text": html_text.op8_html_text,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict:
    return {"op3_url_filter": url_filter.OP3_SQL, "op5_line_dedup": line_dedup.OP5_SQL}
