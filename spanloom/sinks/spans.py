"""Writers and export projections of spans and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import ids, text

# Track numbers and limits of the track export.
TRACK_MODULUS = 2147483647
MARKER_PROCESS, MARKER_THREAD = 999, 2
OTHER_PROCESS = 998
MAX_VALUE = 1000
MIN_TRACK_NS = 1_000_000

Exporter = Callable[[DataFrame], None]


def _pairs(attrs: str) -> Column:
    types = F.col("attr_types") if attrs == "attrs" else None
    kind = (lambda k: F.coalesce(types[k], F.lit("STRING"))) if types is not None else (lambda k: F.lit("STRING"))
    return F.transform(
        F.map_entries(attrs),
        lambda e: F.struct(e["key"].alias("Key"), F.struct(kind(e["key"]).alias("Type"), e["value"].alias("Value")).alias("Value")),
    )


def _nano_time(ns: Column) -> Column:
    whole = F.date_format(ids.ns_to_time(ns), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad((ns % 1000000000).cast("string"), 9, "0"), F.lit("Z"))


def span_objects(spans: DataFrame) -> DataFrame:
    """One nested span object per row, in the stdout exporter's shape."""

    def context(trace: Column, span: Column) -> Column:
        return F.struct(F.coalesce(trace, F.lit(ids.ZERO_TRACE)).alias("TraceID"), F.coalesce(span, F.lit(ids.ZERO_SPAN)).alias("SpanID"))

    events = F.transform("events", lambda e: F.struct(
        e["name"].alias("Name"), _nano_time(e["time_ns"]).alias("Time"),
        F.transform(F.map_entries(e["attrs"]), lambda a: F.struct(
            a["key"].alias("Key"), F.struct(F.lit("STRING").alias("Type"), a["value"].alias("Value")).alias("Value"))).alias("Attributes"),
    ))
    links = F.transform("links", lambda k: F.struct(
        context(k["trace_id"], k["span_id"]).alias("SpanContext"),
        F.transform(F.map_entries(k["attrs"]), lambda a: F.struct(
            a["key"].alias("Key"), F.struct(F.lit("STRING").alias("Type"), a["value"].alias("Value")).alias("Value"))).alias("Attributes"),
    ))
    kinds = F.array(*[F.lit(k) for k in ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")])
    return spans.select(
        F.col("name").alias("Name"), context(F.col("trace_id"), F.col("span_id")).alias("SpanContext"),
        context(F.col("trace_id"), F.col("parent_span_id")).alias("Parent"),
        (F.array_position(kinds, F.col("kind")) - 1).cast("int").alias("SpanKind"),
        _nano_time(F.col("start_ns")).alias("StartTime"), _nano_time(F.col("end_ns")).alias("EndTime"),
        _pairs("attrs").alias("Attributes"), events.alias("Events"), links.alias("Links"),
        F.struct(F.initcap("status_code").alias("Code"), F.col("status_message").alias("Description")).alias("Status"),
        _pairs("resource").alias("Resource"),
        F.struct(F.col("scope_name").alias("Name"), F.col("scope_version").alias("Version")).alias("InstrumentationScope"),
    )


def write_span_json(spans: DataFrame, path: str, mode: str = "error") -> None:
    """Convert: any read format to one span object per line."""
    span_objects(spans).write.mode(mode).json(path)


def write_span_table(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Spans as Parquet by start date, and by trace inside a date.

    Time filters prune folders.  A date's traces are spread over files by range and sorted in them, so a lookup of
    traces skips files and row groups by their bounds, and by Bloom filters where a wanted id falls inside them.
    """
    by = ["start_date", "trace_id"]
    dated = spans.withColumn("start_date", F.to_date("start_time")).repartitionByRange(*by).sortWithinPartitions(*by)
    writer = dated.write.mode(mode).partitionBy("start_date")
    writer.option("parquet.bloom.filter.enabled#trace_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def write_trace_dates(spans: DataFrame, path: str, mode: str = "append") -> None:
    """(trace_id, start_date): the dates on which each trace has spans, for :func:`spanloom.sources.traces.of_traces`."""
    dates = spans.select("trace_id", F.to_date("start_time").alias("start_date")).distinct()
    dates.repartitionByRange("trace_id").sortWithinPartitions("trace_id").write.mode(mode).parquet(path)


def export(spans: DataFrame, exporters: list[Exporter]) -> None:
    """Hand all spans to every exporter; several exporters share one evaluation."""
    shared = spans.persist() if len(exporters) > 1 else spans
    try:
        for exporter in exporters:
            exporter(shared)
    finally:
        if len(exporters) > 1:
            shared.unpersist()


def write_report(parts: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Every part of a report (trends or metrics) as JSON in its own folder."""
    for name, part in parts.items():
        part.write.mode(mode).json(f"{path}/{name}")


def trends_document(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all parts of a trend result as (part, JSON)."""
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("part"), F.to_json(F.struct(*part.columns)).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _hex_track(span_id: Column) -> Column:
    """Last four bytes of a span id as a thread number."""
    return (F.conv(F.substring(span_id, 9, 8), 16, 10).cast("bigint") % TRACK_MODULUS).cast("bigint")


def assign_tracks(spans: DataFrame, max_value: int | None = MAX_VALUE) -> DataFrame:
    """Process and thread track, times since the earliest span and cleaned texts; values are cut to ``max_value`` (None: whole).

    The earliest time is one number; it is read first and becomes a constant.
    """
    first = spans.agg(F.min("start_ns")).first()[0] or 0
    kind = F.coalesce(F.col("attrs")["type"], F.lit(""))
    run = F.col("attrs")["github.run_id"].try_cast("bigint") % TRACK_MODULUS
    job = F.col("attrs")["github.job_id"].try_cast("bigint") % TRACK_MODULUS
    parent = F.nullif(F.col("parent_span_id"), F.lit(ids.ZERO_SPAN))
    ci = kind.isin("workflow", "job", "step")
    pid = F.when(ci, F.coalesce(run, F.lit(1))).when(kind == "marker", MARKER_PROCESS).otherwise(OTHER_PROCESS)
    tid = (
        F.when(kind == "workflow", F.when(run.isNotNull(), 0).otherwise(1)).when(kind == "job", F.coalesce(job, F.lit(1)))
        .when(kind == "step", _hex_track(F.coalesce(parent, F.lit(ids.ZERO_SPAN)))).when(kind == "marker", MARKER_THREAD)
        .otherwise(_hex_track(F.coalesce(parent, F.col("span_id"))))
    )
    name = text.strip_terminal(F.col("name"))
    track = (
        F.when((kind == "workflow") & run.isNotNull(), name).when((kind == "job") & job.isNotNull(), F.concat(F.lit("Job: "), name))
        .when(kind == "marker", F.lit("GitHub PR Events")).when(ci | parent.isNotNull(), F.lit("")).otherwise(name)
    )
    start = F.greatest(F.col("start_ns") - first, F.lit(0))
    end = F.greatest(F.col("end_ns") - first, start)
    wide = F.when((kind != "marker") & (end <= start), start + MIN_TRACK_NS).otherwise(end)
    # An overlong value is cut from its raw text; others are cleaned.
    def value(_: Column, v: Column) -> Column:
        if max_value is None:
            return text.strip_terminal(v)
        return F.when(F.octet_length(v) > max_value, F.concat(F.substring(v, 1, max_value), F.lit("..."))).otherwise(text.strip_terminal(v))

    cut = F.transform_values("attrs", value)
    return spans.select(
        "source_id", "trace_id", "span_id", pid.cast("bigint").alias("pid"), tid.cast("bigint").alias("tid"),
        track.alias("track_name"), name.alias("name"), start.alias("start_ns"), wide.alias("end_ns"),
        (kind == "marker").alias("is_instant"), cut.alias("attrs"),
    )
