"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from ..functions.scalars import AS241
from .views import oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, whole: tuple[str, str] | None = None):
    """Register a query; ``sql`` may use the views. ``whole`` names the view that the query is written on and the one that it reads, which no
    filter or fold has cut. The name with _all stands for the same query; it is kept from the time when the other one read less."""

    def add(f):
        if whole:
            for n in (name, f"{name}_all"):
                query(n, sql and sql.replace(*whole))(lambda spark, d: f(spark, d, whole[1]))
            return f
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def quantile_sql(u: str) -> str:
    """The normal quantile of ``u`` by algorithm AS 241, as DuckDB SQL."""

    def horner(x: str, of: str) -> str:
        out = f"{AS241[of][-1]:.17e}"
        for c in reversed(AS241[of][:-1]):
            out = f"({out} * ({x}) + {c:.17e})"
        return out

    q, tail = f"({u} - 0.5)", f"sqrt(-ln(CASE WHEN {u} < 0.5 THEN {u} ELSE 1 - {u} END))"
    middle = f"{q} * {horner(f'0.180625 - {q} * {q}', 'a')} / {horner(f'0.180625 - {q} * {q}', 'b')}"
    far = lambda of, below, by: f"{horner(f'{tail} - {by}', of)} / {horner(f'{tail} - {by}', below)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {middle} ELSE sign({q}) * CASE WHEN {tail} <= 5 THEN {far('c', 'd', 1.6)} ELSE {far('e', 'f', 5.0)} END END"
