"""Result presentation for the differential check.

Operators return exact types (DECIMAL, DATE). The check compares pandas
frames from Spark and DuckDB, which map those types differently (DuckDB turns
DECIMAL into float64 and DATE into datetime64), so the registry presents
DECIMAL as DOUBLE (one correctly rounded conversion of the exact value) and
DATE as ISO text. The oracle SQL applies the same casts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)
