"""Registered queries over trace payloads, built from the generic spans and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import codes
from spanloom.functions.ids import int_div
from spanloom.plans import fixtures as fx
from spanloom.plans.registry import query
from spanloom.sources import traces


def shown(spans):
    return spans.select(
        "trace_id", "span_id", F.coalesce("parent_span_id", F.lit("")).alias("parent_span_id"), "name", "kind",
        "start_ns", "end_ns", "status_code", codes.attr_text(F.col("attrs")).alias("attrs"),
        F.coalesce(F.col("resource")["service.name"], F.lit("")).alias("service"),
    )


def want(name="name", kind="kind", start="start_ns", end="end_ns", status="status_code", attrs="attr_text", service="service_name"):
    return f"""SELECT trace_id, span_id, coalesce(parent_span_id, '') AS parent_span_id, {name} AS name, {kind} AS kind, {start} AS start_ns, {end} AS end_ns,
  {status} AS status_code, {attrs} AS attrs, {service} AS service FROM spans"""


def number(names, col):
    return F.array_position(F.array(*[F.lit(n) for n in names]), col) - 1


def typed(of):
    """Attribute list of a payload format from a span's map and types."""
    return F.transform(
        F.map_entries("attrs"),
        lambda e: of(e["key"], e["value"], F.coalesce(F.col("attr_types")[e["key"]], F.lit("STRING"))),
    )


def otlp_docs(spans):
    def kv(k, v, t):
        return F.struct(k.alias("key"), F.struct(
            F.when(t == "STRING", v).alias("stringValue"), F.when(t == "INT64", v).alias("intValue")
        ).alias("value"))

    attrs = typed(kv)
    res = F.transform(F.map_entries("resource"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"),
        "name", number(codes.KINDS, F.col("kind")).alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").alias("endTimeUnixNano"), attrs.alias("attributes"),
        F.struct(number(codes.STATUSES, F.col("status_code")).alias("code"), F.lit("").alias("message")).alias("status"),
    )
    scope = F.struct(F.struct(F.lit("lib").alias("name"), F.lit("1").alias("version")).alias("scope"), F.array(span).alias("spans"))
    doc = F.struct(F.array(F.struct(F.struct(res.alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))
    return spans.select("source_id", F.to_json(doc).alias("text"))


def rfc3339(ns):
    micros = int_div(ns, 1000)
    return F.concat(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad((ns % 1000).cast("string"), 3, "0"), F.lit("Z"))


def stdout_docs(spans):
    attrs = typed(lambda k, v, t: F.struct(k.alias("Key"), F.struct(t.alias("Type"), v.alias("Value")).alias("Value")))
    res = F.transform(F.map_entries("resource"), lambda e: F.struct(e["key"].alias("Key"), F.struct(F.lit("STRING").alias("Type"), e["value"].alias("Value")).alias("Value")))
    doc = F.struct(
        F.col("name").alias("Name"), F.struct(F.col("trace_id").alias("TraceID"), F.col("span_id").alias("SpanID")).alias("SpanContext"),
        F.struct(F.col("trace_id").alias("TraceID"), F.coalesce("parent_span_id", F.lit("0" * 16)).alias("SpanID")).alias("Parent"),
        number(codes.KINDS, F.col("kind")).alias("SpanKind"), rfc3339(F.col("start_ns")).alias("StartTime"), rfc3339(F.col("end_ns")).alias("EndTime"),
        attrs.alias("Attributes"), F.struct(F.initcap("status_code").alias("Code"), F.lit("").alias("Description")).alias("Status"), res.alias("Resource"),
    )
    comma = F.when(F.col("seq") % 3 == 0, ",").otherwise("")
    return spans.select("source_id", F.concat(F.to_json(doc), comma).alias("text"))


def flat_docs(spans):
    doc = F.struct(
        F.col("name").alias("Name"), F.struct(F.col("trace_id").alias("TraceID"), F.col("span_id").alias("SpanID")).alias("SpanContext"),
        F.coalesce("parent_span_id", F.lit("0" * 16)).alias("ParentSpanID"), number(codes.KINDS, F.col("kind")).alias("SpanKind"),
        rfc3339(F.col("start_ns")).alias("StartTime"), rfc3339(F.col("end_ns")).alias("EndTime"), F.col("attrs").alias("Attributes"),
        F.struct(F.concat(F.lit("STATUS_CODE_"), "status_code").alias("Code")).alias("Status"), F.col("resource").alias("Resource"),
    )
    return spans.select("source_id", F.to_json(doc).alias("text"))


def jaeger_docs(spans):
    def tag(k, v, t):
        return F.struct(k.alias("key"), F.when(t == "INT64", "int64").otherwise("string").alias("type"), v.alias("value"))

    tags = typed(tag)
    status = F.array(F.struct(F.lit("otel.status_code").alias("key"), F.lit("string").alias("type"), F.col("status_code").alias("value")))
    ref = F.when(F.col("parent_span_id").isNotNull(), F.array(
        F.struct(F.lit("FOLLOWS_FROM").alias("refType"), F.col("trace_id").alias("traceID"), F.lit("f" * 16).alias("spanID")),
        F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_span_id").alias("spanID")),
    ))
    span = F.struct(
        F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("name").alias("operationName"), ref.alias("references"),
        int_div(F.col("start_ns"), 1000).alias("startTime"), int_div(F.col("end_ns") - F.col("start_ns"), 1000).alias("duration"),
        F.concat(tags, status).alias("tags"), F.lit("p1").alias("processID"),
    )
    process = F.create_map(F.lit("p1"), F.struct(F.col("resource")["service.name"].alias("serviceName")))
    doc = F.struct(F.array(F.struct(F.col("trace_id").alias("traceID"), F.array(span).alias("spans"), process.alias("processes"))).alias("data"))
    return spans.select("source_id", F.to_json(doc).alias("text"))


def zipkin_docs(spans):
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"), F.col("parent_span_id").alias("parentId"), "name",
        F.when(F.col("kind") != "INTERNAL", F.col("kind")).alias("kind"), int_div(F.col("start_ns"), 1000).alias("timestamp"),
        int_div(F.col("end_ns") - F.col("start_ns"), 1000).alias("duration"),
        F.struct(F.col("resource")["service.name"].alias("serviceName")).alias("localEndpoint"), F.col("attrs").alias("tags"),
    )
    return spans.select("source_id", F.to_json(F.array(span)).alias("text"))


@query("S1_S2_P16_P17_otlp_json", ["spans"], want())
def otlp_json(spark, folder):
    return shown(traces.otlp_spans(otlp_docs(fx.generic_spans(spark, folder))))


@query("S3_P4_P15_stdout_json", ["spans"], want())
def stdout_json(spark, folder):
    return shown(traces.stdout_spans(stdout_docs(fx.generic_spans(spark, folder))))


def with_entry(key, value):
    """The attribute text with one more entry that sorts before the rpc keys and after all others."""
    return f"CASE WHEN event_type = 'click' THEN replace(attr_text, ';rpc.method=', ';{key}=' || {value} || ';rpc.method=') ELSE attr_text || ';{key}=' || {value} END"


@query("S4_flat_json", ["spans"], want(attrs=with_entry("resource.service.name", "service_name")))
def flat_json(spark, folder):
    return shown(traces.flat_spans(flat_docs(fx.generic_spans(spark, folder))))


@query("S5_J8_jaeger", ["spans"], want(kind="'UNSPECIFIED'", attrs=with_entry("otel.status_code", "status_code")))
def jaeger(spark, folder):
    return shown(traces.jaeger_spans(jaeger_docs(fx.generic_spans(spark, folder))))


@query("S6_zipkin", ["spans"], want(kind="CASE WHEN kind = 'INTERNAL' THEN 'UNSPECIFIED' ELSE kind END", status="'UNSET'", attrs="attr_text || ';service.name=' || service_name"))
def zipkin(spark, folder):
    return shown(traces.zipkin_spans(zipkin_docs(fx.generic_spans(spark, folder))))


@query("S8_U1_format_detection", ["spans"], """
SELECT format, count(*) AS spans FROM (SELECT CASE seq % 5 WHEN 0 THEN 'otlp' WHEN 1 THEN 'jaeger' WHEN 2 THEN 'zipkin' WHEN 3 THEN 'flat' ELSE 'stdout' END AS format FROM spans) GROUP BY 1""")
def format_detection(spark, folder):
    spans = fx.generic_spans(spark, folder)
    makers = [otlp_docs, jaeger_docs, zipkin_docs, flat_docs, stdout_docs]
    docs = None
    for i, make in enumerate(makers):
        part = make(spans.where(F.col("seq") % 5 == i))
        docs = part if docs is None else docs.unionByName(part)
    return docs.groupBy(traces.document_format(F.col("text")).alias("format")).agg(F.count(F.lit(1)).alias("spans"))


@query("S16_spans_of_traces", ["spans"], "SELECT span_id FROM spans WHERE user_id IN (3, 14)")
def spans_of_traces(spark, folder):
    spans = fx.generic_spans(spark, folder)
    wanted = spark.range(1).select(F.explode(F.array(F.lit("3"), F.lit("14"))).alias("u")).select(F.md5("u").alias("trace_id"))
    return traces.of_traces(spans, wanted).select("span_id")


@query("S15_source_tag", ["spans"], "SELECT span_id, 7 AS source_id, '7' AS tag FROM spans")
def source_tag(spark, folder):
    out = traces.with_source(fx.generic_spans(spark, folder), 7)
    return out.select("span_id", "source_id", F.col("attrs")["github.url_index"].alias("tag"))


CHUNK = 64


def chrome_docs(spark, folder):
    """Chrome documents of at most 64 events: one per user and block of event ids."""
    e = fx.table(spark, folder, "events")
    event = F.struct(
        F.col("event_id").alias("i"), F.col("event_type").alias("name"), F.lit("X").alias("ph"),
        F.unix_micros("ts").cast("double").alias("ts"), (F.floor("value") * 3600000000.0).alias("dur"),
        (F.col("user_id") % 3).alias("pid"), F.lit(1).alias("tid"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("args"),
    )
    meta = F.struct(
        F.lit(-1).cast("bigint").alias("i"), F.lit("thread_name").alias("name"), F.lit("M").alias("ph"), F.lit(0.0).alias("ts"), F.lit(0.0).alias("dur"),
        F.max(F.col("user_id") % 3).alias("pid"), F.lit(1).alias("tid"),
        F.create_map(F.lit("name"), F.concat(F.lit("thread of "), F.max("user_id").cast("string"))).alias("args"),
    )
    grouped = e.groupBy("user_id", F.floor(F.col("event_id") / CHUNK).alias("block")).agg(
        F.collect_list(F.to_json(event)).alias("events"), F.to_json(meta).alias("meta")
    )
    body = F.array_join(F.concat(F.array("meta"), F.col("events")), ",")
    return grouped.select((F.col("user_id") % 25).cast("int").alias("source_id"), F.concat(F.lit('{"traceEvents":['), body, F.lit("]}")).alias("text"))


@query("S7_J9_J10_P29_F11_chrome_trace", [], """
WITH e AS (SELECT *, event_id // 64 AS block, CAST(CAST(epoch_us(ts) AS DOUBLE) * 1000 AS BIGINT) AS a,
  CAST((CAST(epoch_us(ts) AS DOUBLE) + floor(value) * 3600000000) * 1000 AS BIGINT) - CAST(CAST(epoch_us(ts) AS DOUBLE) * 1000 AS BIGINT) AS d FROM events WHERE floor(value) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY a, d DESC, event_id) AS ord FROM e),
m AS (SELECT c.event_id, max(p.ord) AS p_ord, any_value(c.user_id) AS user_id, any_value(c.block) AS block FROM o c LEFT JOIN o p
  ON p.user_id = c.user_id AND p.block = c.block AND p.ord < c.ord AND p.a + p.d > c.a GROUP BY 1)
SELECT CAST(e.event_id AS VARCHAR) AS event_id, e.event_type AS name, e.a AS start_ns, e.a + e.d AS end_ns, 'thread of ' || e.user_id AS thread,
  coalesce(CAST(p.event_id AS VARCHAR), '') AS parent FROM e JOIN m USING (event_id) LEFT JOIN o p ON p.user_id = m.user_id AND p.block = m.block AND p.ord = m.p_ord""")
def chrome_trace(spark, folder):
    spans = traces.chrome_spans(chrome_docs(spark, folder))
    a = F.col("attrs")
    rows = spans.select(
        "trace_id", "span_id", "parent_span_id", a["chrome.args.id"].alias("event_id"), "name", "start_ns", "end_ns",
        a["chrome.thread_name"].alias("thread"),
    )
    up = rows.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("event_id").alias("parent"))
    out = rows.join(up, ["trace_id", "parent_span_id"], "left")
    return out.select("event_id", "name", "start_ns", "end_ns", "thread", F.coalesce("parent", F.lit("")).alias("parent"))
