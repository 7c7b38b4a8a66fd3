"""Tools of a result table: what a user types into the filter row of a column.

A condition is an operator and a value, ``> 5``, ``contains sea``, ``!= "x y"``,
or a bare value: then text columns must contain it and numbers equal it. All
columns' conditions must hold. The operators are those of the reference's table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The operators as words and as signs.
OPERATORS = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
WORDS = ("eq", "ne", "lt", "le", "gt", "ge", "contains", "icontains", "datestartswith", "is blank", "is not blank")

_CONDITION = re.compile(r"\s*(?:(<=|>=|<>|!=|==|=|<|>)|(" + "|".join(WORDS) + r")(?=\s|$))?\s*(.*?)\s*", re.S)


def condition(column: Column, kind: T.DataType, text: str) -> Column:
    """The predicate a condition stands for. A value that is no number matches
    nothing in a number column; NULL meets ``is blank`` alone."""
    sign, word, value = _CONDITION.fullmatch(text).groups()
    op = OPERATORS.get(sign, word)
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"`":
        value = value[1:-1]
    if op == "is blank":
        return column.isNull() | (column.cast("string") == "")
    if op == "is not blank":
        return column.isNotNull() & (column.cast("string") != "")
    number = isinstance(kind, T.NumericType)
    op = op or ("eq" if number else "contains")
    if op == "contains":
        return column.cast("string").contains(value)
    if op == "icontains":
        return F.lower(column.cast("string")).contains(F.lower(F.lit(value)))
    if op == "datestartswith":
        return column.cast("string").startswith(value)
    other = F.lit(value).try_cast("double") if number else F.lit(value)
    column = column.cast("double") if number else column.cast("string")
    return {"eq": column == other, "ne": column != other, "lt": column < other, "le": column <= other,
            "gt": column > other, "ge": column >= other}[op]


def filter_result(result: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Rows that meet the condition of every column named; empty ones ask nothing."""
    for name, text in conditions.items():
        if text.strip():
            result = result.where(condition(F.col(name), result.schema[name].dataType, text))
    return result
