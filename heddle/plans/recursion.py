"""Recursion to a fixed point over sets of rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.errors import EngineError
from heddle.sources.shared import dropped, written

#: Rounds that are kept as tables of their own.
MOST_TABLES = 20


def recursive_union(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """All rows that the anchor yields, and that the step yields from rows found before, each once.

    The step is given the last round's new rows alone. Rows are compared null-safe, so cycles end. Each round's rows are
    written to the shared folder, and many rounds are made one table, which keeps the plan short. Raises if rows are still new after ``most_rounds``.
    """
    schema = anchor.schema
    names = [f"_{i}" for i in range(len(schema))]

    def rows(df: DataFrame) -> DataFrame:
        return df.toDF(*names).select(*[F.col(n).cast(f.dataType).alias(n) for n, f in zip(names, schema.fields, strict=True)]).distinct()

    rounds = [written(rows(anchor), "recursion")]
    for _ in range(most_rounds):
        found = rows(step(rounds[-1].toDF(*anchor.columns)))
        seen = reduce(DataFrame.union, rounds)
        same = reduce(lambda a, b: a & b, (found[n].eqNullSafe(seen[n]) for n in names))
        new = written(found.join(seen, same, "left_anti"), "recursion")
        if new.isEmpty():
            dropped(new)
            return seen.toDF(*anchor.columns)
        rounds.append(new)
        if len(rounds) > MOST_TABLES:
            # all but the last are read for comparison alone
            whole = written(reduce(DataFrame.union, rounds[:-1]), "recursion")
            for table in rounds[:-1]:
                dropped(table)
            rounds = [whole, new]
    raise EngineError(f"recursion didn't end after {most_rounds} rounds")
