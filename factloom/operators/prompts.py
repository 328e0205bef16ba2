"""What a model is shown: nested values cut to bounds, evidence in order of weight, packed into a budget."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trimmed

#: So many elements of a list are shown.
ELEMENTS = 10


def bounded(value: Column, kind: T.DataType, length: int = 1000) -> Column:
    """A value with its texts trimmed to `length` and its lists cut to ELEMENTS, in structs and maps at any depth. Elements of lists stay as they are; null stays null."""
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), trimmed(value, length))
    if isinstance(kind, T.ArrayType):
        return F.slice(value, 1, ELEMENTS)
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: bounded(v, kind.valueType, length))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(bounded(value[f.name], f.dataType, length).alias(f.name) for f in kind)))
    return value


def bounded_rows(rows: DataFrame, *columns: str, length: int = 1000) -> DataFrame:
    return rows.withColumns({c: bounded(F.col(c), rows.schema[c].dataType, length) for c in columns})


def weight(kind: Column, verified: Column) -> Column:
    """Order of evidence for a judge: what frames show, then what is verified, then the rest; smaller is earlier."""
    return F.when(kind == "keyframe_analysis", 0).otherwise(2) + F.when(F.coalesce(verified, F.lit(False)), 0).otherwise(1)


def packed(items: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The items that are taken in order while they fit a budget, with their place from 0: one that doesn't fit is left out, later smaller ones may follow.

    The rows of a claim come to a task in order and are gone through one after the other: what is held is the budget
    used so far, however many items a claim has. A null size counts as 0. order: columns that set a unique order.
    """
    rows = items.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0))).repartition(by).sortWithinPartitions(by, *order)
    schema = T.StructType([*rows.drop("__size").schema.fields, T.StructField("place", T.IntegerType())])

    def take(batches):
        own, used, place, begun = None, 0, 0, False
        for batch in batches:
            mask, places = [], []
            for who, n in zip(batch.column(by).to_pylist(), batch.column("__size").to_pylist(), strict=True):
                if not begun or who != own:
                    own, used, place, begun = who, 0, 0, True
                fits = used + n <= budget
                mask.append(fits)
                if fits:
                    used += n
                    places.append(place)
                    place += 1
            kept = batch.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in schema.names[:-1]), pa.array(places, pa.int32())], schema.names)

    return rows.mapInArrow(take, schema)
