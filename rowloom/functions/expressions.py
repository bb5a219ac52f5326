"""The two small expression forms of the tool: one value, one comparison.

Both are translated once on the driver into a Column; anything richer is
written as plain Spark SQL (`F.expr`).
"""

from __future__ import annotations

import math
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import dtype, is_float, is_integral, is_number, ref, require
from .parsing import as_text, parse_double

COMPARISONS = ("==", "!=", ">=", "<=", ">", "<")
ARITHMETIC = ("+", "-", "*", "/")


def quoted(text: str) -> str | None:
    """The inside of 'text' or "text", else None."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return None


def literal_number(text: str) -> float | None:
    if "_" in text or text != text.strip():
        return None
    try:
        return float(text)
    except ValueError:
        return None


def checked_double(df: DataFrame, name: str, errors: str) -> Column:
    """The column as a double. With errors="raise" text that is no number fails the job."""
    col, kind = ref(name), dtype(df, name)
    value = parse_double(col, kind)
    if errors == "null" or is_number(kind):
        return value
    problem = F.concat(F.lit(f"column {name!r} holds a value that is not a number: "), col.cast("string"))
    return F.when(col.isNotNull() & value.isNull(), F.raise_error(problem).cast("double")).otherwise(value)


def value_expr(text: str, df: DataFrame, errors: str = "raise") -> Column:
    """A quoted text, a column, a number, or one `+ - * /` between columns and numbers."""
    if errors not in ("raise", "null"):
        raise ValueError(f"errors must be 'raise' or 'null', got {errors!r}")
    text = text.strip()
    inner = quoted(text)
    if inner is not None:
        return F.lit(inner)
    if text in df.columns:
        return ref(text)
    number = literal_number(text)
    if number is not None:
        return F.lit(number)

    def operand(token: str) -> Column | None:
        token = token.strip()
        if token in df.columns:
            return checked_double(df, token, errors)
        value = literal_number(token)
        return None if value is None else F.lit(value)

    for op in ARITHMETIC:
        for at, char in enumerate(text):
            if char != op:
                continue
            left, right = operand(text[:at]), operand(text[at + 1:])
            if left is None or right is None:
                continue
            if op == "+":
                return left + right
            if op == "-":
                return left - right
            if op == "*":
                return left * right
            if errors == "null":
                return F.try_divide(left, right)
            zero = F.raise_error(F.lit(f"division by zero in {text!r}")).cast("double")
            return F.when(right == 0, zero).otherwise(F.try_divide(left, right))
    raise ValueError(f"unsupported expression: {text!r}")


def compare_number(col: Column, op: str, bound: float | int | Decimal, floating: bool) -> Column:
    """A comparison with a literal that the scan can push down."""
    value = F.lit(bound)
    if op in ("==", "eq"):
        return col == value
    if op in ("!=", "neq"):
        return col != value
    if op in ("<", "lt"):
        return col < value
    if op in ("<=", "lte"):
        return col <= value
    cond = col > value if op in (">", "gt") else col >= value
    # NaN is the greatest value for Spark and greater than nothing for IEEE.
    return cond & ~F.isnan(col) if floating else cond


def number_predicate(df: DataFrame, name: str, op: str, bound: float, errors: str = "raise") -> Column:
    kind = dtype(df, name)
    if is_integral(kind) and math.isfinite(bound) and bound == int(bound):
        return compare_number(ref(name), op, int(bound), False)
    if isinstance(kind, T.DecimalType) and math.isfinite(bound):
        return compare_number(ref(name), op, Decimal(repr(bound)), False)
    if is_number(kind) and not is_float(kind):
        return compare_number(ref(name).cast("double"), op, bound, False)
    if is_float(kind):
        return compare_number(ref(name), op, bound, True)
    return compare_number(checked_double(df, name, errors), op, bound, True)


def split_conditions(text: str) -> list[str]:
    """The parts between commas that stand outside quotes."""
    parts, start, quote = [], 0, ""
    for at, char in enumerate(text):
        if quote:
            quote = "" if char == quote else quote
        elif char in "\"'":
            quote = char
        elif char == ",":
            parts.append(text[start:at])
            start = at + 1
    return [*parts, text[start:]]


def bool_expr(text: str, df: DataFrame, errors: str = "raise") -> Column:
    """`column OP literal` with OP one of == != >= <= > <; what follows the operator is the literal."""
    operators = "|".join(map(re.escape, COMPARISONS))
    columns = "|".join(re.escape(c) for c in sorted(df.columns, key=len, reverse=True))
    found = re.fullmatch(rf"\s*({columns})\s*({operators})(.*)", text, re.DOTALL) or re.fullmatch(rf"(.*?)({operators})(.*)", text, re.DOTALL)
    if found is None:
        raise ValueError(f"unsupported condition: {text!r}")
    name, op, right = found[1].strip(), found[2], found[3].strip()
    require(df, [name], "condition")
    wanted = quoted(right)
    if wanted is not None:
        if op not in ("==", "!="):
            raise ValueError(f"operator {op} does not apply to text: {text!r}")
        left = as_text(ref(name), dtype(df, name))
        return left == F.lit(wanted) if op == "==" else ~left.eqNullSafe(F.lit(wanted))
    bound = literal_number(right)
    if bound is None:
        raise ValueError(f"right side is neither a number nor quoted text: {text!r}")
    return number_predicate(df, name, op, bound, errors)
