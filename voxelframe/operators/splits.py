"""Train, validation and test splits by position in the order of sample ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .instances import dense_rank_global


def split_assign(samples: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(sample_id, split): the first share in string order trains, the next validates; sizes round half to even."""
    ranks = dense_rank_global(samples, "sample_id", start=0)
    n = ranks.count()
    first, second = round(n * train), round(n * val)
    split = F.when(F.col("rank") < first, "train").when(F.col("rank") < first + second, "val").otherwise("test")
    return ranks.select("sample_id", split.alias("split"))
