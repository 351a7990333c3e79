"""All queries of the subpackage, and their SQL where there is one."""

from __future__ import annotations

import importlib

MODULES = ("q01_tokens", "q02_decontaminate", "q03_mixing", "q04_quality", "q05_pii", "q06_neardup", "q07_language", "q08_secrets", "q09_neighbours", "q10_chat", "q11_fingerprints", "q12_repair", "q13_ranking")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
