"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def _modules() -> list:
    from sightline.llm import (
        bpe_codec, conversation_trie, html_text, near_duplicates, packing, phrases, quality_model, quality_rules, simhash, substring_dedup, token_files, topk, url_filter,
    )

    return [
        packing, token_files, quality_rules, html_text, url_filter, bpe_codec, topk, near_duplicates, substring_dedup, quality_model,
        conversation_trie, simhash, phrases,
    ]


def queries() -> dict:
    import corpus_pipeline

    return {m.NAME: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if getattr(m, "ORACLE_SQL", None)}
