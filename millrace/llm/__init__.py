"""Training-data operators, and the queries that apply them to the given tables."""

from __future__ import annotations


def queries():
    # Imported when asked for: a task that needs one operator does not load the others.
    from . import catalogue

    return catalogue.queries()


def statements():
    from . import catalogue

    return catalogue.statements()
