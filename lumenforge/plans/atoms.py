"""Stand-ins for classifications that models or reviewers would give: deterministic choices by a row's key, the same in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(key: str, values: Sequence, step: int) -> Column:
    """One of the values by the key; None among them is null."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((F.col(key) * step) % 1009 % len(values) + 1).cast("int"))


def pick_sql(key: str, values: Sequence, step: int) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{shown}], 1 + ({key} * {step}) % 1009 % {len(values)})"


def with_atoms(df: DataFrame, key: str, atoms: dict[str, tuple[Sequence, int]], *more: str) -> DataFrame:
    return df.select(key, *more, *[pick(key, v, s).alias(n) for n, (v, s) in atoms.items()])


def atoms_sql(table: str, key: str, atoms: dict[str, tuple[Sequence, int]], *more: str) -> str:
    """The same table as the body of a subquery."""
    return f"SELECT {', '.join([key, *more])}, " + ", ".join(f"{pick_sql(key, v, s)} AS {n}" for n, (v, s) in atoms.items()) + f" FROM {table}"
