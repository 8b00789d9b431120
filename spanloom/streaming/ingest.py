"""Structured Streaming ingest of trace payloads and webhooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import enrich, lint, metrics
from spanloom.session import configure
from spanloom.sources import traces


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines landing in a folder as a stream of (text, source_id)."""
    reader = configure(spark).readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("value").alias("text"), F.lit(0).alias("source_id"))


def stream_spans(lines: DataFrame) -> DataFrame:
    """Spans of OTLP JSON export requests, one per line: a stateless projection."""
    return traces.otlp_spans(lines).drop("seq")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not export requests."""
    good = F.from_json("text", "resourceSpans array<string>")["resourceSpans"].isNotNull()
    return lines.where((F.trim("text") != "") & ~good)


def ingest_spans(
    lines: DataFrame, path: str, checkpoint: str, rejects: str | None = None, available_now: bool = False
) -> list[StreamingQuery]:
    """Append parsed spans to Parquet, and bad lines to a reject folder."""

    def start(df: DataFrame, out: str, name: str) -> StreamingQuery:
        writer = df.writeStream.format("parquet" if name == "spans" else "json").outputMode("append")
        writer = writer.option("path", out).option("checkpointLocation", f"{checkpoint}/{name}")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    queries = [start(stream_spans(lines), path, "spans")]
    if rejects is not None:
        queries.append(start(rejected_lines(lines), rejects, "rejects"))
    return queries


def live_summary(spans: DataFrame, enrichers: list[enrich.Enricher] | None = None) -> DataFrame:
    """Totals over all spans seen so far, for ``complete`` output: one row of state."""
    return metrics.summarize(enrich.enrich(spans, enrichers or enrich.chain(ci=False)))


def live_lint(spans: DataFrame) -> DataFrame:
    """Counts of lint findings so far, for ``complete`` output."""
    return lint.lint_summary(lint.lint_spans(spans))


def webhook_sources(lines: DataFrame) -> DataFrame:
    """Run or job events to ``owner/repo/commit/sha``; a run is preferred, gaps reject."""
    event = F.from_json("text", (
        "action string, workflow_run struct<head_sha:string>, workflow_job struct<head_sha:string>, repository struct<full_name:string>"
    ))
    rows = lines.select(event.alias("e"))
    sha = F.when(F.col("e.workflow_run").isNotNull(), F.col("e.workflow_run.head_sha")).otherwise(F.col("e.workflow_job.head_sha"))
    repo = F.col("e.repository.full_name")
    ok = (F.coalesce(sha, F.lit("")) != "") & (F.coalesce(repo, F.lit("")) != "")
    return rows.where(ok).select(
        F.concat(repo, F.lit("/commit/"), sha).alias("source"), repo.alias("repository"), sha.alias("head_sha"), F.col("e.action").alias("action")
    )


def once_per_span(spans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop spans delivered again within the delay; state is bounded by the watermark."""
    return spans.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])
