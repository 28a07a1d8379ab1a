"""Arrow-batched functions that need no session until they are used."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.session import bounded_batches


def arrow_udf(kind: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf`` with a DDL type that is read when the function is first applied to columns.

    Batches are small ones, as tens of thousands of texts and what is made of them are too much for a worker. once: a filter on the result does not call the function a second time.
    """

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def apply(*columns) -> Column:
            if (spark := SparkSession.getActiveSession()) is not None:
                bounded_batches(spark)
            made = F.pandas_udf(f, kind)
            return (made.asNondeterministic() if once else made)(*columns)

        return apply

    return decorate
