"""JSON text columns: shape test and typed extraction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def is_tabular(body: Column) -> Column:
    """True for a JSON array whose first element is an object.

    Looks at the raw text: a path lookup would unquote a first element that is
    a string and take ``["{x"]`` for an object.
    """
    return F.coalesce(F.regexp_like(body, F.lit(r"^\s*\[\s*\{")), F.lit(False))


def array_items(body: Column) -> Column:
    """Elements of a JSON array, each as JSON text."""
    return F.from_json(body, "array<string>")


def typed_items(body: Column, types: Mapping[str, str]) -> Column:
    """Elements of a JSON array of objects as structs of declared fields."""
    return F.from_json(body, f"array<struct<{_ddl(types, ': ')}>>")


def extract_fields(document: Column, types: Mapping[str, str]) -> Column:
    """Struct of typed fields of a JSON document; a missing field is NULL."""
    return F.from_json(document, _ddl(types, " "))


def _ddl(types: Mapping[str, str], separator: str) -> str:
    return ", ".join(f"`{name}`{separator}{t}" for name, t in types.items())
