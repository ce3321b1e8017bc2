"""Query registry."""

from __future__ import annotations

from riskweave.plans import advisories, governance, languages, matching, parsing

PARTS = (parsing, matching, governance, advisories, languages)


def queries() -> dict:
    out: dict = {}
    for p in PARTS:
        out |= p.R.queries
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for p in PARTS:
        out |= p.R.oracle
    return out
