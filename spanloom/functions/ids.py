"""Deterministic ids and time conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_SPAN = "0" * 16
ZERO_TRACE = "0" * 32


def trace_id(run_id: Column, attempt: Column) -> Column:
    known = F.when(F.coalesce(attempt, F.lit(0)) == 0, F.lit(1)).otherwise(attempt)
    return F.md5(F.concat_ws("-", run_id.cast("string"), known.cast("string")))


def span_id_int(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number.cast("bigint"))), 16, "0")


def span_id_text(seed: Column) -> Column:
    return F.substring(F.md5(seed), 1, 16)


def seed(*parts: Column | str) -> Column:
    """Join id parts with dashes; plain strings are literals."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat_ws("-", *cols)


def previous_attempt_span_id(run_id: Column, attempt: Column) -> Column:
    return span_id_text(seed("wf-attempt", run_id, attempt))


def job_url(owner: Column, repo: Column, run_id: Column, job_id: Column) -> Column:
    return F.concat(run_url(owner, repo, run_id), F.lit("/job/"), job_id.cast("string"))


def run_url(owner: Column, repo: Column, run_id: Column) -> Column:
    return F.concat(
        F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/actions/runs/"),
        run_id.cast("string"),
    )


def compare_url(owner: Column, repo: Column, before: Column, after: Column) -> Column:
    return F.concat(
        F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/compare/"),
        before, F.lit("..."), after,
    )


def parse_time(text: Column) -> Column:
    """RFC3339 text to timestamp; bad or empty text gives null."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text))


def parse_time_ns(text: Column) -> Column:
    """RFC3339 text to epoch nanoseconds (timestamps alone stop at microseconds)."""
    digits = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0")
    nanos = digits.cast("bigint")
    return F.unix_micros(F.date_trunc("second", parse_time(text))) * 1000 + F.coalesce(nanos, F.lit(0))


def int_div(value: Column, by: int) -> Column:
    """Whole-number division; ``/`` would go through doubles, too coarse for nanoseconds."""
    return F.call_function("div", value, F.lit(by))


def ns_to_time(ns: Column) -> Column:
    return F.timestamp_micros(int_div(ns, 1000))


def ns_to_ms(ns: Column) -> Column:
    return int_div(ns, 1000000)


def time_to_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def is_span_id(text: Column) -> Column:
    """16 hex digits, not all zero."""
    return F.coalesce(text.rlike("^[0-9a-fA-F]{16}$") & (text != ZERO_SPAN), F.lit(False))


def is_trace_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{32}$") & (text != ZERO_TRACE), F.lit(False))


# Fixed value: what ends the bytes of an id that is no span or trace id in hex digits; no such id is as short.
_OTHER = "00" * 17


def packed(text: Column) -> Column:
    """An id as bytes, half as long for span and trace ids in lower case; equal for equal ids only."""
    data = F.unhex(text)
    plain = F.length(data).isin(8, 16) & (F.lower(F.hex(data)) == text)
    return F.when(plain, data).otherwise(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit(_OTHER))))


def unpacked(data: Column) -> Column:
    """The id that was packed."""
    size = F.length(data)
    other = F.substring(data, F.lit(1), size - len(_OTHER) // 2).cast("string")
    return F.when(size <= 16, F.lower(F.hex(data))).otherwise(other)


def valid_span_id(text: Column) -> Column:
    return F.when(is_span_id(text), F.lower(text))


def parse_source(ref: Column) -> dict[str, Column]:
    """owner / repo / type / identifier of a URL or its short form; null type if no match."""
    path = F.regexp_replace(
        F.regexp_replace(ref, r"^https?://", ""), r"^(?:www\.)?github\.com/", ""
    )
    foreign = ref.rlike(r"^https?://(?!(?:www\.)?github\.com(?:/|$))")
    path = F.split_part(F.split_part(path, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    size = F.size(parts)
    kind = (
        F.when(foreign, F.lit(None))
        .when((size == 4) & (F.get(parts, F.lit(2)) == "pull"), F.lit("pr"))
        .when((size == 4) & (F.get(parts, F.lit(2)) == "commit"), F.lit("commit"))
        .when(
            (size >= 5) & (F.get(parts, F.lit(2)) == "actions") & (F.get(parts, F.lit(3)) == "runs"),
            F.lit("run"),
        )
    )
    known = kind.isNotNull()
    return {
        "owner": F.when(known, F.get(parts, F.lit(0))),
        "repo": F.when(known, F.get(parts, F.lit(1))),
        "type": kind,
        "identifier": F.when(kind == "run", F.get(parts, F.lit(4))).when(known, F.get(parts, F.lit(3))),
    }
