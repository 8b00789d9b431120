"""Semantic-convention lint over spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANY_SPANS = 10

# Replaced attributes -> (whether the value is quoted, advice).
DEPRECATED = {
    "http.method": (True, "Use 'http.request.method' instead (semconv v1.20+)"),
    "http.status_code": (True, "Use 'http.response.status_code' instead (semconv v1.20+)"),
    "http.url": (False, "Use 'url.full' instead (semconv v1.20+)"),
    "http.target": (False, "Use 'url.path' and 'url.query' instead (semconv v1.20+)"),
    "http.scheme": (False, "Use 'url.scheme' instead (semconv v1.20+)"),
    "http.host": (False, "Use 'server.address' and 'server.port' instead (semconv v1.20+)"),
    "net.peer.name": (False, "Use 'server.address' (client spans) or 'client.address' (server spans) instead"),
    "net.peer.port": (False, "Use 'server.port' (client spans) or 'client.port' (server spans) instead"),
    "messaging.destination": (False, "Use 'messaging.destination.name' instead (semconv v1.20+)"),
}


def _has(key: str) -> Column:
    return F.coalesce(F.col("attrs")[key], F.lit("")) != ""


def _finding(condition: Column, level: str, message: Column | str, suggestion: str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        condition,
        F.struct(F.lit(level).alias("level"), text.alias("message"), F.lit(suggestion).alias("suggestion")),
    )


def _rules() -> list[Column]:
    out = []
    for key, (quote, advice) in DEPRECATED.items():
        text = f"Deprecated attribute '{key}'"
        message = (
            F.concat(F.lit(f"{text} (value: "), F.col("attrs")[key], F.lit(")")) if quote else F.lit(text)
        )
        out.append(_finding(_has(key), "warning", message, advice))
    # The messages and advice of the four rules below.
    out.append(_finding(
        _has("db.statement") & ~_has("db.system"), "warning",
        "Has 'db.statement' but missing required 'db.system'",
        "Add 'db.system' attribute (e.g., 'postgresql', 'mysql', 'redis')",
    ))
    http = _has("http.request.method")
    out.append(_finding(
        http & (F.col("kind") == "CLIENT") & ~_has("server.address") & ~_has("net.peer.name"), "info",
        "HTTP client span missing 'server.address'",
        "Add 'server.address' for better service topology visibility",
    ))
    out.append(_finding(
        http & (F.col("kind") == "SERVER") & ~_has("http.route"), "info",
        "HTTP server span missing 'http.route'",
        "Add 'http.route' (e.g., '/api/users/:id') for meaningful span grouping",
    ))
    out.append(_finding(
        _has("rpc.system") & ~_has("rpc.service"), "info",
        "RPC span missing 'rpc.service'",
        "Add 'rpc.service' and 'rpc.method' for meaningful span identification",
    ))
    return out


def lint_spans(spans: DataFrame) -> DataFrame:
    """One row per finding: a single projection with an array, then an explode."""
    found = F.filter(F.array(*_rules()), lambda f: f.isNotNull())
    return spans.select(
        "source_id", "trace_id", "span_id", F.col("name").alias("span_name"), F.explode(found).alias("f")
    ).select("source_id", "trace_id", "span_id", "span_name", "f.*")


def lint_batch(spans: DataFrame) -> DataFrame:
    """HTTP without databases in a batch of more than ten spans."""
    seen = spans.agg(
        F.coalesce(F.bool_or(_has("http.request.method") | _has("http.method")), F.lit(False)).alias("http"),
        F.coalesce(F.bool_or(_has("db.system")), F.lit(False)).alias("db"),
        F.count(F.lit(1)).alias("n"),
    )
    return seen.where(F.col("http") & ~F.col("db") & (F.col("n") > MANY_SPANS)).select(
        F.lit(None).cast("int").alias("source_id"), F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"), F.lit("").alias("span_name"),
        F.lit("info").alias("level"),
        F.lit("Trace has HTTP spans but no database spans").alias("message"),
        F.lit("If your service uses a database, consider adding database instrumentation").alias("suggestion"),
    )


def lint(spans: DataFrame) -> DataFrame:
    return lint_spans(spans).unionByName(lint_batch(spans))


def lint_summary(findings: DataFrame) -> DataFrame:
    """Identical findings with their counts."""
    return findings.groupBy("level", "message", "suggestion").agg(F.count(F.lit(1)).alias("count"))


def lint_levels(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count(F.lit(1)).alias("count"))
