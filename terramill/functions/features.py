"""Attributes of a place as values and as fragments of a question; serialisation of places as text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terramill.functions.text import strip


def known(column: str) -> Column:
    """The value, or null where it is missing in any spelling."""
    value = F.col(column).cast("string")
    return F.when(~F.lower(strip(value)).isin("nan", "none", ""), value)


@dataclass(frozen=True)
class Feature:
    """A column, how its value is read, and the fragment it makes (null: none). Add own ones by making more of these."""

    column: str
    to_text: Callable[[Column], Column]
    check: Callable[[str], Column] = known

    def value(self) -> Column:
        return self.check(self.column)

    def text(self) -> Column:
        return self.to_text(self.value())


def labelled(name: str) -> Callable[[Column], Column]:
    return lambda value: F.concat(F.lit(f"{name} "), value)


def with_or_without(thing: str) -> Callable[[Column], Column]:
    return lambda value: F.when(value == "yes", f"with {thing}").when(value == "no", f"without {thing}")


CATEGORY = Feature("category", labelled("category"))
COOKING_TYPE = Feature("cooking_type", labelled("cooking_type"))
OUTDOOR_SEATING = Feature("outdoor_seating", with_or_without("outdoor seating"))
INDOOR_SEATING = Feature("indoor_seating", with_or_without("indoor seating"))
FEATURES = [CATEGORY, COOKING_TYPE, OUTDOOR_SEATING, INDOOR_SEATING]


def fragments(features: list[Feature] | None = None) -> Column:
    """ARRAY<STRUCT<text, name, value>> of the features that make a fragment, in the order of their texts."""
    each = [F.struct(f.text().alias("text"), F.lit(f.column).alias("name"), f.value().alias("value")) for f in features or FEATURES]
    return F.array_sort(F.filter(F.array(*each), lambda f: f["text"].isNotNull() & (f["text"] != "")))


def clean(value: Column) -> Column:
    """Underscores, semicolons and runs of blanks as one blank; blank as null."""
    return F.nullif(strip(F.regexp_replace(value.cast("string"), r"[_;\s]+", " ")), F.lit(""))


def first_tag(tags: dict[str, list[str]], default: str = "unknown") -> Column:
    """The value of the first tag column whose value is listed for it."""
    return F.coalesce(*[F.when(F.col(f"`{c}`").isin(values), F.col(f"`{c}`")) for c, values in tags.items()], F.lit(default))


def serialize(columns: list[str], available: list[str], *, name_tags=(), category_tags=(), address: bool = True, context: str | None = None) -> Column:
    """One lower-case line of a place: name, categories, attributes, address, context; parts in order, columns that don't exist left out.

    An attribute of 'yes' gives its column's name, one of 'no' nothing, and one
    whose text is already there isn't repeated.
    """
    has = lambda c: c in available
    col = lambda c: clean(F.col(f"`{c}`"))
    parts = F.array().cast("array<string>")
    names = [col(c) for c in name_tags if has(c)]
    if names:
        parts = F.array(F.coalesce(*names))
    categories = F.array(*[col(c) for c in category_tags if has(c)]).cast("array<string>")
    parts = F.concat(F.array_compact(parts), F.array_distinct(F.array_compact(categories)))
    for c in filter(has, columns):
        value = col(c)
        text = F.when(value == "yes", F.lit(c.replace("_", " "))).when(value != "no", value)
        parts = F.when(text.isNull() | F.array_contains(parts, value), parts).otherwise(F.array_append(parts, text))
    tail = [c for c in (["addr:street", "addr:postcode"] if address else []) + ([context] if context else []) if has(c)]
    if tail:
        parts = F.concat(parts, F.array_compact(F.array(*map(col, tail))))
    return F.lower(F.array_join(parts, " "))
