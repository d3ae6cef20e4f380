"""Expressions that score rows from the stored parameter tables."""

from __future__ import annotations

from barlight.operators.stored import STEP_DIGITS
from barlight.plans.oracles import cte
from barlight.plans.parameters import tables

T = tables()
SHORT = T["short_term"]


def inputs(table: dict) -> list[str]:
    """Standardised features, then family indicators."""
    scaled = [f"((coalesce({f}, {m}::double) - {mean}::double) / {std}::double)" for f, m, mean, std in zip(table["features"], table["median"], table["mean"], table["std"])]
    return [*scaled, *(f"(pattern_family = '{f}')::int::double" for f in table["families"])]


def tree(nodes: dict[int, list], at: int) -> str:
    _, _, feature, threshold, left, right, value = nodes[at]
    if feature < 0:
        return f"{value}::double"
    return f"case when x[{int(feature) + 1}] <= {threshold}::double then {tree(nodes, int(left))} else {tree(nodes, int(right))} end"


def raw(table: dict) -> str:
    """Raw probability from the list x of a row."""
    if table["kind"] in ("logistic", "margin"):
        z = " + ".join(f"x[{i}] * {b}::double" for i, b in enumerate(table["coefficients"], start=1))
        return f"(1 / (1 + exp(-least(greatest({table['intercept']}::double + {z}, -35), 35))))"
    nodes = {int(n[1]): n for n in table["nodes"]}
    roots = nodes.keys() - {int(i) for n in table["nodes"] for i in n[4:6]}
    total = "(" + " + ".join(tree(nodes, i) for i in sorted(roots)) + ")"
    return total if table["kind"] == "random_forest" else f"(1 / (1 + exp(-2 * {total})))"


def stepped(p: str, table: dict) -> str:
    return "(case " + " ".join(f"when {p} <= {upper} then {value}" for upper, value in table["steps"][:-1]) + f" else {table['steps'][-1][1]} end)::double"


def calibrated(source: str, models: dict[str, dict], keep: str) -> str:
    """*keep* and one probability per model, from rows of *source*; all models read the same inputs."""
    lists = {name: ", ".join(inputs(t)) for name, t in models.items()}
    assert len(set(lists.values())) == 1
    first = f"select {keep}, [{next(iter(lists.values()))}] as x from {source}"
    second = f"select *, {', '.join(f'round({raw(t)}, {STEP_DIGITS}) as raw_{n}' for n, t in models.items())} from ({first})"
    return f"select * exclude (x), {', '.join(f'{stepped(f'raw_{n}', t)} as p_{n}' for n, t in models.items())} from ({second})"


cte("q_four", calibrated("q_sig", SHORT, "ticker, signal_date, pattern"))
