"""Exceptions of rules: clones per statement, and negated conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clone_exceptions(statements: DataFrame, exceptions: DataFrame, document: str, rule: str, stmt_order: list[str], exc_order: list[str], name: str = "exc_no") -> DataFrame:
    """Every exception of a rule for each of its statements, numbered from 0 through the whole
    document, statement by statement."""
    joined = statements.join(exceptions, [document, rule])
    w = Window.partitionBy(document).orderBy(*stmt_order, *exc_order)
    return joined.withColumn(name, F.row_number().over(w) - 1)


def expand(atoms: str, exceptions: str):
    """Condition atoms with exceptions as negated atoms: sorted, each once."""
    negated = F.transform(exceptions, lambda x: F.concat(F.lit("not "), x))
    return F.sort_array(F.array_distinct(F.concat(atoms, negated)))
