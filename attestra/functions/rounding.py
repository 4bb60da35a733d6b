"""Decimal rounding of doubles: nearest by the exact binary value, ties to even.

``F.round`` rounds the shortest decimal text half-up and ``F.bround`` half-even, so both differ
from exact rounding on values such as 2.675 (binary slightly below the tie) and 0.0125 (slightly
above). Here the scaled value is kept as an exact sum of two doubles (Veltkamp split), which makes
the comparison with the tie exact while staying inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITTER = 2**27 + 1


def _rounded(value: str, digits: int) -> str:
    scale = f"{10**digits}D"
    spread = f"({value} * {SPLITTER}D)"
    high = f"({spread} - ({spread} - {value}))"
    head, tail = f"({high} * {scale})", f"(({value} - {high}) * {scale})"
    floor = f"cast(floor({head} + {tail}) AS double)"
    over = f"(({head} - {floor} - 0.5D) + {tail})"
    up = f"({over} > 0 OR ({over} = 0 AND pmod({floor}, 2D) = 1))"
    return f"(({floor} + CASE WHEN {up} THEN 1D ELSE 0D END) / {scale})"


def exact_round(name: str, digits: int) -> Column:
    """Round the DOUBLE column ``name``, given as SQL text since it is used many times."""
    return F.expr(_rounded(name, digits))


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round several DOUBLE columns in place."""
    return df.withColumns({name: exact_round(name, n) for name, n in digits.items()})


def percent_text(name: str) -> Column:
    """The ratio column ``name`` as text with one decimal, e.g. 0.667 -> '66.7%'."""
    return F.expr(f"format_string('%.1f%%', {_rounded(f'({name} * 100D)', 1)})")
