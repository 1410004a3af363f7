"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from barline.llm import chat, decontamination, language_model, licenses, near_duplicates, packing, pii, quality, substrings, token_counts


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_decontamination": decontamination.query,
        "op2_near_duplicates": near_duplicates.query,
        "op3_licenses": licenses.query,
        "op4_packing": packing.query,
        "op5_substrings": substrings.query,
        "op6_chat": chat.query,
        "op7_language_model": language_model.query,
        "op8_quality": quality.query,
        "op9_token_counts": token_counts.query,
        "op10_pii": pii.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.SQL, "op2_near_duplicates": near_duplicates.SQL, "op6_chat": chat.SQL}
