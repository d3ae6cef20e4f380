"""Independent DuckDB statements for the registered queries, composed from named common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str, recursive: bool = False) -> None:
    CTES[name] = sql


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def r(expr: str, digits: int) -> str:
    """Round with ties going up and without negative zero."""
    return f"(round(({expr}) + 1e-9, {digits}) + cast(0 as double))"


def build(sql: str) -> str:
    """Prefix *sql* with the common table expressions it needs, in order of definition."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in re.findall(r"\bq_[a-z0-9_]+\b", text):
            if name in CTES and name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return sql
    parts = [f"{n}{'' if n == 'q_ema' else ' '} as {'' if n == 'q_ema' else 'materialized '}({CTES[n]})" for n in CTES if n in needed]
    body = f"select * from ({sql})" if sql.lstrip().startswith("with") else sql
    return "with recursive " + ",\n".join(parts) + "\n" + body


def all_sql() -> dict[str, str]:
    from barlight.plans.oracles import base, fitted, learn, market, outcome, score, source, walk  # noqa: F401

    return {k: build(v) for k, v in ORACLES.items()}
