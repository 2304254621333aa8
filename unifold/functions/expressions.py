"""A calculator's expression language, compiled to Columns. Only what is listed here is accepted."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {
    "abs": F.abs, "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), "exp": F.exp, "log": lambda x: F.when(x > 0, F.ln(x)), "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "min": F.least, "max": F.greatest, "mean": lambda *x: sum(x[1:], x[0]) / len(x),
    "step": lambda x: F.when(x > 0, 1.0).otherwise(0.0), "ispositive": lambda x: F.when(x > 0, 1.0).otherwise(0.0), "isnegative": lambda x: F.when(x < 0, 1.0).otherwise(0.0), "not": lambda x: F.when(x == 0, 1.0).otherwise(0.0),
}
OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Pow: lambda a, b: F.pow(a, b)}


def compiled(text: str, names: dict[str, Column]) -> Column:
    """The Column of ``text`` over the given names. Division by 0 and logarithms of non-positive values give null."""
    tree = ast.parse(text.replace("not(", "_not("), mode="eval").body

    def walk(n) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id in names:
            return names[n.id].cast("double")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp) and type(n.op) in OPERATORS:
            return OPERATORS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id.lstrip("_") in FUNCTIONS and not n.keywords:
            return FUNCTIONS[n.func.id.lstrip("_")](*map(walk, n.args))
        raise ValueError(f"not allowed in an expression: {ast.dump(n)}")

    return walk(tree)
