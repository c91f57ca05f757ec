"""Arrow functions that are made on first use, so that modules import without a session."""

from __future__ import annotations

import functools

from pyspark.sql.functions import pandas_udf


def arrow(kind: str):
    """Like `pandas_udf`, with the type read when the function is first applied."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return pandas_udf(f, kind)(*columns)

        return call

    return wrap
