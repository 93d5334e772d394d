"""Cut an ordered set into cells of bounded size.

Ranks and running sums over a whole table, or over one very large key, must
not run in a single task. The order key is cut at quantiles. Rows between two
cuts form a cell. A key value so frequent that it spans two cuts or more gets
a code of its own, and its rows are cut again by a second, tie-breaking
column. With n cuts no cell then holds much more than 2/n of the rows,
whatever the distribution.

The cuts are numbers fetched once (at most ``2 * MAX_CUTS``) and used as
literals, so that every evaluation of the frame, also after a lost executor,
places a row in the same cell. Any cuts give right results; good ones only
balance the work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 10
MAX_CUTS = 2**LEVELS - 1
ROWS_PER_CELL = 500_000
CODE, SUB = "_code", "_sub"


def sort_key(col: Column, dtype: T.DataType, descending: bool = False) -> Column:
    """A long or double whose ascending order is the wanted order.

    Distinct values keep distinct keys. Decimals must fit 18 digits, else the
    cast raises.
    """
    if isinstance(dtype, T.DecimalType):
        key = (col * F.lit(10**dtype.scale).cast("decimal(19,0)")).cast("bigint")
    elif isinstance(dtype, T.DateType):
        key = F.unix_date(col).cast("bigint")
    elif isinstance(dtype, T.TimestampType):
        key = F.unix_micros(col)
    elif isinstance(dtype, T.TimestampNTZType):
        # From the wall-clock parts: no time zone may reorder rows.
        seconds = (
            F.unix_date(col.cast("date")).cast("bigint") * 86_400
            + F.hour(col) * 3_600
            + F.minute(col) * 60
        )
        key = seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), col) * 1_000_000).cast("bigint")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        key = col.cast("double")
    else:
        key = col.cast("bigint")
    return -key if descending else key


def _literal(value: int | float) -> str:
    return f"{value!r}D" if isinstance(value, float) else f"{value}L"


def _array(values: Sequence[int | float]) -> Column:
    """An array literal, parsed in one go instead of built element by element."""
    return F.expr(f"array({', '.join(map(_literal, values))})")


def _cuts_below(cuts: Sequence[int | float], column: str) -> Column:
    """Number of cuts below the column: a balanced tree of comparisons.

    Each row takes about log2 of the number of cuts steps, in generated code.
    """
    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        above, upto = tree(middle + 1, high), tree(low, middle)
        return f"if({column} > {_literal(cuts[middle])}, {above}, {upto})"

    return F.expr(tree(0, len(cuts)))


def _thin(cuts: list, levels: int) -> tuple:
    """Every 2^(LEVELS - levels)-th of the cuts: 2^levels - 1 of them."""
    stride = 2 ** (LEVELS - levels)
    return tuple(cuts[stride - 1 :: stride][: 2**levels - 1])


@dataclass(frozen=True)
class Cuts:
    """Cuts of an order key and of its tie-breaker; ``single`` if one cell holds all rows."""

    single: bool
    order: tuple
    tie: tuple

    def assign(self, df: DataFrame, key: str, tie: str | None = None) -> DataFrame:
        """Add the cell columns; (code, sub) ascends with (key, tie)."""
        distinct = sorted(set(self.order))
        repeated = [c for c in distinct if self.order.count(c) > 1]
        frequent = F.col(key).isNull()
        if repeated:
            frequent = frequent | F.col(key).isin(repeated)
        code = _cuts_below(distinct, key) * 2 + frequent.cast("int")
        sub = F.lit(0) if tie is None else _cuts_below(sorted(set(self.tie)), tie)
        return df.withColumns({
            CODE: F.when(F.col(key).isNull(), -1).otherwise(code),
            SUB: F.when(frequent, sub).otherwise(0),
        })


def measure_cuts(
    df: DataFrame,
    orders: Sequence[tuple[Column, Column | None]],
    rows_per_cell: int = ROWS_PER_CELL,
    extra: Sequence[Column] = (),
) -> tuple[list[Cuts], list]:
    """Cuts for each (key, tie), and the values of further aggregates.

    One aggregation over the key columns for all of them; the driver gets the
    cuts and the values only.
    """
    probabilities = _array([i / (MAX_CUTS + 1) for i in range(1, MAX_CUTS + 1)])
    accuracy = 4 * (MAX_CUTS + 1)
    columns = [c for order in orders for c in order if c is not None]
    rows, *values = df.agg(
        F.count("*"),
        *[F.percentile_approx(c, probabilities, accuracy) for c in columns],
        *extra,
    ).first()
    levels = min(LEVELS, max(0, (-(-rows // rows_per_cell) - 1).bit_length()))
    found = iter(values)
    measured = []
    for order in orders:
        key, tie = (_thin(next(found) or [], levels) if c is not None else () for c in order)
        measured.append(Cuts(levels == 0, key, tie))
    return measured, list(found)
