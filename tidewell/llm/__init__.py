"""Operators for training-data corpora. Nothing outside this folder imports it but the entry module's guard."""

from importlib import import_module

_MODULES = ("token_counts", "near_dedup", "decontamination", "packing", "secret_scans", "language_id", "quality_rules", "substring_dedup", "line_dedup", "sharding", "conversation_repair", "lexical_search", "vector_search")


def _gather(name: str) -> dict:
    return {k: v for m in _MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
