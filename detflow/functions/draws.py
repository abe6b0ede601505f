"""Reproducible pseudo-random draws.

Every random choice in the pipeline is ``h(keys..., salt)``: the first 32 bits
of md5 over the '-'-joined keys, as a non-negative BIGINT.  It is a pure
function of the row, so results do not depend on partitioning, task retries or
executor loss, and DuckDB computes the same number from the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(*parts) -> Column:
    """Draw from columns / column names; wrap literal salts in ``F.lit``."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *cols)), 1, 8), 16, 10).cast("bigint")


def h_sql(*parts: str) -> str:
    """Spark-SQL text of the same draw, for use inside ``F.expr`` lambdas."""
    inner = ", ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"CAST(conv(substring(md5(concat_ws('-', {inner})), 1, 8), 16, 10) AS BIGINT)"
