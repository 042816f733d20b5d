"""Levels of books as they come, in JSON of any kind, as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of a book and the columns that hold their levels.
SIDES = ("best_5_buy", "best_5_sell")


def parsed(rows: DataFrame, columns: tuple[str, ...] = SIDES) -> DataFrame:
    """rows with these columns, JSON texts, as variants; a text that is no JSON is null."""
    return rows.withColumns({c: F.try_parse_json(F.col(c)) for c in columns})


def kind(value: Column) -> Column:
    """array, object, string, number, boolean or null, for a variant; null for a null that isn't JSON's."""
    said = F.schema_of_variant(value)
    named = F.when(said.startswith("ARRAY"), "array").when(said.startswith("OBJECT"), "object").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "VOID", "null")
    return F.when(value.isNotNull(), named.otherwise("number"))


def levels(value: Column) -> Column:
    """The levels of a variant, an array of price, quantity and orders: none of one that is no array. An element that is no object, or
    a cell that is no number (nor a text of one), has nulls there, so it stands in its place and is no wall."""
    every = F.try_variant_get(F.when(kind(value) == "array", value), "$", "array<variant>")

    def level(x: Column) -> Column:
        return F.struct(F.try_variant_get(x, "$.price", "double").alias("price"), F.try_variant_get(x, "$.quantity", "bigint").alias("quantity"), F.try_variant_get(x, "$.orders", "bigint").alias("orders"))

    return F.coalesce(F.transform(every, level), F.array().cast("array<struct<price: double, quantity: bigint, orders: bigint>>"))


def books(rows: DataFrame) -> DataFrame:
    """rows with variants of levels as the books that operators/bars.py reads."""
    return rows.withColumns({c: levels(F.col(c)) for c in SIDES})
