"""Conclusions, status codes, span kinds and typed attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Span kinds by their numeric code.
KINDS = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]
# Status codes by their numeric code.
STATUSES = ["UNSET", "OK", "ERROR"]

def conclusion_to_result(conclusion: Column) -> Column:
    return F.when(conclusion == "timed_out", F.lit("error")).otherwise(conclusion)


def conclusion_to_status(conclusion: Column) -> Column:
    """Span status struct(code, message) of a run, job or step conclusion."""
    code = (
        F.when(conclusion.isin("success", "cancelled", "skipped"), F.lit("OK"))
        .when(conclusion.isin("failure", "timed_out"), F.lit("ERROR"))
        .otherwise(F.lit("UNSET"))
    )
    message = (
        F.when(conclusion.isin("failure", "timed_out"), conclusion)
        .when(conclusion == "cancelled", F.lit("Cancelled"))
        .when(conclusion == "skipped", F.lit("Skipped"))
        .otherwise(F.lit(""))
    )
    return F.struct(code.alias("code"), message.alias("message"))


def normal_status(code: Column) -> Column:
    """Any casing, with or without the STATUS_CODE_ prefix; the rest is UNSET."""
    up = F.regexp_replace(F.upper(code), "^STATUS_CODE_", "")
    return F.when(up.isin("OK", "ERROR"), up).otherwise(F.lit("UNSET"))


def status_name(code: Column) -> Column:
    names = F.array(*[F.lit(s) for s in STATUSES])
    return F.coalesce(F.get(names, code.cast("int")), F.lit("UNSET"))


def kind_name(code: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.coalesce(F.get(names, code.cast("int")), F.lit("UNSPECIFIED"))


def kind_from_text(kind: Column) -> Column:
    up = F.upper(kind)
    return F.when(up.isin("CLIENT", "SERVER", "PRODUCER", "CONSUMER"), up).otherwise(
        F.lit("UNSPECIFIED")
    )


Entry = tuple[str, Column, str]


def entry(key: str, value: Column | str, kind: str = "STRING") -> Entry:
    """One typed attribute under a fixed key; a null value leaves it out."""
    value = F.lit(value) if isinstance(value, str) else value
    return key, value.cast("string"), kind


def present(pairs: list[tuple[str, Column]]) -> Column:
    """Map of the pairs that have a value; only maps that lack one pay for the filter, which is not compiled."""
    made = F.create_map(*[c for key, value in pairs for c in (F.lit(key), value)])
    whole = reduce(Column.__and__, [value.isNotNull() for _, value in pairs])
    return F.when(whole, made).otherwise(F.map_filter(made, lambda _, v: v.isNotNull()))


def attr_map(entries: list[Entry]) -> Column:
    """Attribute map of entries with distinct keys."""
    return present([(key, value) for key, value, _ in entries])


def type_map(entries: list[Entry]) -> Column:
    """Types of the entries that are not plain text; a key not listed is STRING."""
    typed = [(k, v, t) for k, v, t in entries if t != "STRING"]
    if not typed:
        return F.create_map().cast("map<string,string>")
    return present([(key, F.when(value.isNotNull(), kind)) for key, value, kind in typed])


def known_column(key: str) -> str:
    """Column in which an attribute's value stands beside the map."""
    return f"attribute {key}"


def attribute(spans: DataFrame, key: str) -> Column:
    """Value of an attribute, null when absent.

    A value that stands beside the map is taken from there: then the map isn't made only to be searched, and a
    filter on a fixed value leaves out whole kinds of spans.
    """
    name = known_column(key)
    return F.col(f"`{name}`") if name in spans.columns else F.col("attrs")[key]


def attrs_of(entries: Column) -> Column:
    """Map of an array of struct(key, value, type); nulls drop out, the last key wins."""
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & e["key"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def types_of(entries: Column) -> Column:
    typed = F.filter(
        entries, lambda e: e["value"].isNotNull() & e["key"].isNotNull() & (e["type"] != "STRING")
    )
    return F.map_from_entries(F.transform(typed, lambda e: F.struct(e["key"], e["type"])))


def type_of_json(raw: Column) -> Column:
    """Type of an untyped JSON scalar given as raw text: whole numbers are INT64."""
    return (
        F.when(raw.isin("true", "false"), F.lit("BOOL"))
        .when(raw.rlike(r"^-?\d+(\.0+)?$"), F.lit("INT64"))
        .when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.lit("FLOAT64"))
        .otherwise(F.lit("STRING"))
    )


def attr_text(attrs: Column) -> Column:
    """Canonical text of an attribute map: ``key=value`` sorted by key."""
    return F.array_join(
        F.array_sort(
            F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        ),
        ";",
    )
