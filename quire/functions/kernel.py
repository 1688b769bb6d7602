"""Python functions as Column functions, over Arrow batches.

For what built-in expressions cannot say. A kernel gets a row's values and
returns one value; nulls come as None, and a kernel whose first value is None
gives null without being called.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def kernel(kind: str):
    """Decorator: ``f(*values)`` becomes ``f(*columns) -> Column`` of the DDL type ``kind``; the plain function stays as ``.plain``."""

    def wrap(f):
        def applied(*columns) -> Column:
            from pyspark.sql.pandas.types import to_arrow_type

            import pyarrow as pa

            arrow = to_arrow_type(DataType.fromDDL(kind))

            def run(*arrays):
                import pyarrow as pa

                rows = zip(*(a.to_pylist() for a in arrays), strict=True)
                return pa.array([None if r[0] is None else f(*r) for r in rows], arrow)

            run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
            # said to vary, so that Spark keeps it in a projection of its own: inside the functions of array expressions it could not run
            udf = F.arrow_udf(run, kind).asNondeterministic()
            return udf(*[F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c) for c in columns])

        applied.plain, applied.__name__, applied.__doc__ = f, f.__name__, f.__doc__
        return applied

    return wrap
