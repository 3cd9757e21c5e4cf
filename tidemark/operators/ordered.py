"""Previous rows and positions in an entity's time order, without putting an entity into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous(df: DataFrame, entity: str, slice_: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``prev_<c>`` for each of ``columns``: its value in the entity's row before, by ``order``, which
    must be total; and ``has_prev``. ``slice_`` is a column that grows with the order, as the day does.

    Windows run within (entity, slice). The first row of a slice takes its values from a table of the
    slices' last rows, of which an entity has one a slice. With ``df`` partitioned by (entity, slice),
    rows aren't shuffled again.
    """
    inner = W.partitionBy(entity, slice_).orderBy(*order)
    last = F.max_by(F.struct(*columns), F.struct(*order))
    ends = df.groupBy(F.col(entity).alias("__e"), F.col(slice_).alias("__s")).agg(last.alias("__v"))
    ends = ends.select("__e", "__s", F.lag("__v").over(W.partitionBy("__e").orderBy("__s")).alias("__p"))
    rows = df.withColumn("__l", F.lag(F.struct(*columns)).over(inner)).join(ends, (F.col(entity) == F.col("__e")) & (F.col(slice_) == F.col("__s")))
    prev = F.coalesce("__l", "__p")
    return rows.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns], prev.isNotNull().alias("has_prev"))


def with_position(df: DataFrame, entity: str, slice_: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, the 0-based place of a row in its entity's ``order``, ``pos_back`` from the end, and
    ``n_rows``; by the slices' row counts, as ``with_previous``."""
    inner = W.partitionBy(entity, slice_).orderBy(*order)
    sizes = df.groupBy(F.col(entity).alias("__e"), F.col(slice_).alias("__s")).agg(F.count("*").alias("__c"))
    w = W.partitionBy("__e")
    sizes = sizes.withColumns({"__b": F.sum("__c").over(w.orderBy("__s").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__c"), "n_rows": F.sum("__c").over(w)}).drop("__c")
    rows = df.withColumn("__r", F.row_number().over(inner) - 1).join(sizes, (F.col(entity) == F.col("__e")) & (F.col(slice_) == F.col("__s")))
    pos = F.col("__b") + F.col("__r")
    return rows.select(*df.columns, pos.alias("pos"), (F.col("n_rows") - 1 - pos).alias("pos_back"), "n_rows")


def with_neighbours(df: DataFrame, entity: str, slice_: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What ``with_position`` and ``with_previous`` add, by one sort and one join."""
    inner = W.partitionBy(entity, slice_).orderBy(*order)
    both = F.struct(*columns)
    w = W.partitionBy("__e").orderBy("__s")
    ends = df.groupBy(F.col(entity).alias("__e"), F.col(slice_).alias("__s")).agg(F.count("*").alias("__c"), F.max_by(both, F.struct(*order)).alias("__v"))
    ends = ends.select("__e", "__s", F.lag("__v").over(w).alias("__p"), (F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__c")).alias("__b"), F.sum("__c").over(W.partitionBy("__e")).alias("n_rows"))
    rows = df.withColumns({"__r": F.row_number().over(inner) - 1, "__l": F.lag(both).over(inner)}).join(ends, (F.col(entity) == F.col("__e")) & (F.col(slice_) == F.col("__s")))
    pos, prev = F.col("__b") + F.col("__r"), F.coalesce("__l", "__p")
    return rows.select(*df.columns, pos.alias("pos"), (F.col("n_rows") - 1 - pos).alias("pos_back"), "n_rows", *[prev[c].alias(f"prev_{c}") for c in columns], prev.isNotNull().alias("has_prev"))
