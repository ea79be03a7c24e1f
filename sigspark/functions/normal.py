"""Normal tails, which Spark SQL lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 percent point of the normal distribution.
Z95 = 1.959963984540054


def two_sided_p(t: Column) -> Column:
    def tails(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore").astype(float)

    return F.pandas_udf(tails, "double")(t)
