"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from prosewell.plans import base, ledgers, lexical, lint, manuscripts, projects, prose, structure

#: Loading a module registers its queries.
_MODULES = (prose, lint, lexical, manuscripts, projects, structure, ledgers)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
