"""All registered queries, gathered from the check modules."""

from __future__ import annotations

import importlib

MODULES = ("panel_checks", "rule_checks", "rule_targets", "ledger_checks", "audit_checks", "stats_checks", "cov_checks", "text_checks")


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(importlib.import_module(f"checks.{m}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _gather("Q")


def oracle_sql() -> dict:
    return _gather("O")
