"""Items of JSON bodies of any shape, by way of VARIANT.

A body is parsed once. Arrays give their elements, anything else is one item, and each item
keeps the type it has. One aggregate over the parsed items finds the fields of all objects;
the rows are cast from the same parsed items, so no text is read a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalake.scratch import written


def items_of(bodies: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """(keys, row, item, kind): an item is a VARIANT, its kind OBJECT, BIGINT, STRING, ...

    A body that is not JSON fails the load; a NULL body has no items, JSON null is a VOID one.
    """
    parsed = bodies.filter(F.col(body).isNotNull()).select(*keys, F.parse_json(body).alias("_v"))
    elements = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
    items = parsed.select(*keys, F.posexplode(elements).alias("row", "item"))
    kind = F.regexp_extract(F.schema_of_variant("item"), "^[A-Z]+", 0)
    return items.withColumn("kind", F.coalesce(kind, F.lit("VOID")))


def fields_of(items: DataFrame) -> T.StructType:
    """Fields of all objects in the order of their names; one row comes to the driver. A field
    that has more than one type is a VARIANT."""
    objects = items.filter("kind = 'OBJECT'")
    merged = objects.agg(F.schema_of_variant_agg("item").alias("s")).first().s
    if not merged or not merged.startswith("OBJECT<"):
        return T.StructType()
    return T.DataType.fromDDL(merged.replace("OBJECT<", "STRUCT<"))


def mixed_rows(bodies: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """(keys, row, kind, value, fields) of every item.

    ``fields`` has the objects' fields with the type that holds all their values; those that
    change between types are text. Items that are no objects have their text as ``value``.
    """
    items = written(items_of(bodies, keys, body), "items")
    is_object = F.col("kind") == "OBJECT"
    by_name = F.try_variant_get("item", "$", "map<string,variant>")

    def field(f: T.StructField) -> Column:
        kind = "string" if isinstance(f.dataType, (T.VariantType, T.NullType)) else f.dataType
        return F.try_element_at(by_name, F.lit(f.name)).cast(kind).alias(f.name)

    found = [field(f) for f in fields_of(items)]
    fields = F.when(is_object, F.struct(*found)) if found else F.lit(None).cast("struct<>")
    value = F.when(~is_object, F.col("item").cast("string"))
    return items.select(*keys, "row", "kind", value.alias("value"), fields.alias("fields"))
