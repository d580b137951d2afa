"""Errors of a prediction as aggregate expressions of two columns. Rows in which either is null don't count; without any row a metric is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(y: str, yhat: str, value: Column) -> Column:
    return F.when(F.col(y).isNotNull() & F.col(yhat).isNotNull(), value)


def mse(y: str, yhat: str) -> Column:
    return F.avg((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat)))


def rmse(y: str, yhat: str) -> Column:
    return F.sqrt(mse(y, yhat))


def mae(y: str, yhat: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(yhat)))


def r2(y: str, yhat: str) -> Column:
    """1 - squared errors over squared deviations; null for a constant y."""
    return 1 - F.try_divide(mse(y, yhat), F.var_pop(_both(y, yhat, F.col(y))))


def nrmse(y: str, yhat: str) -> Column:
    """RMSE over the range of y; null for a constant y."""
    seen = _both(y, yhat, F.col(y))
    return F.try_divide(rmse(y, yhat), F.max(seen) - F.min(seen))
