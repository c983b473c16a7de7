"""Operators on texts and vectors for training data: problems 1 to 8.

Nothing outside this package imports it.  ``queries`` and ``oracle_sql`` give
its entries for ``__spark_entry__``.
"""

from __future__ import annotations

from lectern.llm import leakage, lookalike, mojibake, neighbours, residue, sentences, shared_spans, tokenizing

MODULES = (lookalike, sentences, mojibake, shared_spans, neighbours, tokenizing, leakage, residue)


def _gathered(attribute: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(module, attribute)
    return found


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Name -> the SQL that must give the same rows."""
    return _gathered("ORACLE")
