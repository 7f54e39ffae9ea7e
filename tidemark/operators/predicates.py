"""The predicate language: a small JSON tree over a window's symbols, compiled to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import curves

ATOMS = {"has_subseq", "count_symbol", "peak_count", "symbol_at"}
COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


def check_predicate(node: dict, depth: int = 0) -> None:
    """Raise ValueError for anything outside the language: unknown names, depth over 2, counts over 10."""
    if not isinstance(node, dict) or "op" not in node:
        raise ValueError("a predicate is an object with op")
    op = node["op"]
    if op in ("AND", "OR", "NOT"):
        args = node.get("args")
        if depth >= 2 or not isinstance(args, list) or not args or op == "NOT" and len(args) != 1:
            raise ValueError(f"{op} needs arguments and a depth of at most 2")
        for a in args:
            check_predicate(a, depth + 1)
    elif op not in ATOMS:
        raise ValueError(f"unknown predicate {op}")
    elif op == "has_subseq" and not (node.get("seq") and all(s in curves.SYMBOLS for s in node["seq"])):
        raise ValueError("has_subseq needs symbols")
    elif op in ("count_symbol", "peak_count") and (node.get("cmp") not in COMPARE or not 0 <= int(node.get("k", -1)) <= 10):
        raise ValueError(f"{op} needs cmp and k")
    elif op in ("count_symbol", "symbol_at") and node.get("symbol") not in curves.SYMBOLS:
        raise ValueError(f"{op} needs a symbol")
    elif op == "symbol_at" and node.get("segment") not in ("early", "mid", "late"):
        raise ValueError("symbol_at needs a segment")


def _atom(node: dict, symbols: Column, values: Column) -> Column:
    op = node["op"]
    if op == "has_subseq":
        return curves.has_run(symbols, node["seq"])
    if op == "count_symbol":
        return COMPARE[node["cmp"]](F.size(F.filter(symbols, lambda s: s == node["symbol"])), node["k"])
    if op == "peak_count":
        return COMPARE[node["cmp"]](F.size(curves.extrema(values)), node["k"])
    n = F.size(symbols)
    third, two = F.bround(n / 3).cast("int"), F.bround(2 * n / 3).cast("int")
    lo, hi = {"early": (F.lit(0), F.greatest(third, F.lit(1))), "mid": (third, F.greatest(third + 1, two)), "late": (F.least(n - 1, two), n)}[node["segment"]]
    part = F.filter(symbols, lambda s, i: (i >= lo) & (i < hi))
    held = F.size(F.filter(part, lambda s: s == node["symbol"]))
    return (held >= 1) & (2 * held >= F.size(part))


def compile_predicate(node: dict, symbols: Column, values: Column) -> Column:
    """The column of a checked predicate. An atom over a missing channel is false, so its NOT is true."""
    check_predicate(node)

    def build(x: dict) -> Column:
        if x["op"] == "NOT":
            return ~build(x["args"][0])
        if x["op"] in ("AND", "OR"):
            first, *rest = map(build, x["args"])
            for c in rest:
                first = first & c if x["op"] == "AND" else first | c
            return first
        return F.coalesce(_atom(x, symbols, values), F.lit(False))

    return build(node)
