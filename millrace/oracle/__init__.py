"""Expected answers as DuckDB SQL, one statement per checked query."""

from __future__ import annotations

from . import analysis, generated, given_rows, nexmark, streams, tpch, user_functions

FAMILIES = (generated, given_rows, tpch, nexmark, user_functions, analysis, streams)


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(family.statements())
    return found
