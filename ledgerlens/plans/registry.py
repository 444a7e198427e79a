"""Single place that assembles the query registry and its SQL oracle."""

from __future__ import annotations


def all_queries():
    from ledgerlens.plans import catalog

    return dict(catalog.QUERIES)


def all_oracle_sql():
    from ledgerlens.plans import oracle

    q = oracle.oracle_sql()
    names = all_queries()
    return {k: v for k, v in q.items() if k in names}
