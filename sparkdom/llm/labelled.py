"""The bounded labelled sample that both classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, key: str = "doc_id") -> DataFrame:
    """At most `bound` rows of docs with their label as column `y`.

    train is a condition on key. The labelled keys with the smallest hash are taken, so the
    choice depends on the keys alone. The broadcast holds `bound` keys at most. A key
    labelled more than once counts with its largest label; of repeated documents at most
    twice the bound are used.
    """
    keys = labels.where(train & F.col(key).isNotNull() & F.col(label).isNotNull())
    keys = keys.select(key, F.col(label).cast("int").alias("y")).orderBy(F.xxhash64(key), key, F.desc("y")).limit(bound)
    keys = keys.groupBy(key).agg(F.max("y").alias("y"))
    return docs.join(F.broadcast(keys), key).limit(2 * bound)
