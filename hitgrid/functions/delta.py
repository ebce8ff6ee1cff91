"""The delta method on columns: an expression of moments carries its partial derivatives along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite by a zero b, NaN where both are zero."""
    inf = float("inf")
    return F.when(b != 0, a / b).when(a > 0, F.lit(inf)).when(a < 0, F.lit(-inf)).otherwise(F.lit(float("nan")))


class Jet:
    """A value and its derivatives by numbered variables. Sums, products, quotients and whole powers follow the usual rules; numbers
    and other columns are constants."""

    def __init__(self, value: Column, slopes: dict[int, Column] | None = None) -> None:
        self.value, self.slopes = value, slopes or {}

    @staticmethod
    def of(x: Jet | Column | float) -> Jet:
        return x if isinstance(x, Jet) else Jet(x if isinstance(x, Column) else F.lit(float(x)))

    def _with(self, other: Jet | Column | float, value: Callable[[Column, Column], Column], slope: Callable[[Column | None, Column | None, Column, Column], Column]) -> Jet:
        b = Jet.of(other)
        return Jet(value(self.value, b.value), {k: slope(self.slopes.get(k), b.slopes.get(k), self.value, b.value) for k in sorted(self.slopes.keys() | b.slopes.keys())})

    def __add__(self, other: Jet | Column | float) -> Jet:
        return self._with(other, lambda a, b: a + b, lambda da, db, a, b: db if da is None else da if db is None else da + db)

    def __sub__(self, other: Jet | Column | float) -> Jet:
        return self + Jet.of(other) * -1.0

    def __mul__(self, other: Jet | Column | float) -> Jet:
        return self._with(other, lambda a, b: a * b, lambda da, db, a, b: a * db if da is None else b * da if db is None else da * b + a * db)

    def __truediv__(self, other: Jet | Column | float) -> Jet:
        def slope(da: Column | None, db: Column | None, a: Column, b: Column) -> Column:
            return divide(da, b) if db is None else divide((da * b if da is not None else F.lit(0.0)) - a * db, b * b)

        return self._with(other, divide, slope)

    def __pow__(self, n: int) -> Jet:
        out = self
        for _ in range(n - 1):
            out = out * self
        return out

    def variance(self, covariance: Callable[[int, int], Column], sizes: bool = False) -> Column:
        """To first order, from the variables' covariances (i <= j); with sizes, the sum of all terms' sizes, by which rounding goes."""
        total = F.lit(0.0)
        for i, a in self.slopes.items():
            for j, b in self.slopes.items():
                if i <= j:
                    term = a * b * covariance(i, j) * (1.0 if i == j else 2.0)
                    total = total + (F.abs(term) if sizes else term)
        return total
