"""A filter of fixed size over ids: lets all wanted rows through, and few others while it isn't full.

It keeps rows that a join would drop from being shuffled. It is a help only: the join follows, so results don't
depend on it, and its size (BITS / 8 bytes) doesn't depend on the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def _bit(number: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(BITS)).cast("bigint")


class IdFilter:
    def __init__(self, ids: DataFrame, column: str) -> None:
        """Built by the executors; BITS / 64 rows at most reach the driver."""
        bits = ids.select(_bit(F.col(column)).alias("bit"))
        words = bits.selectExpr("cast(bit div 64 as int) AS w", "shiftleft(1L, cast(bit % 64 as int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
        table = words.toArrow()
        array = np.zeros(BITS // 64, np.int64)
        array[table["w"].to_numpy()] = table["b"].to_numpy()
        self.sent = ids.sparkSession.sparkContext.broadcast(array)

    def may_hold(self, number: Column) -> Column:
        sent = self.sent

        def there(column: pa.Array) -> pa.Array:
            b = column.to_numpy(zero_copy_only=False)
            return pa.array((sent.value[b >> 6] >> (b & 63)) & 1 == 1)

        return F.arrow_udf(there, "boolean")(_bit(number))
