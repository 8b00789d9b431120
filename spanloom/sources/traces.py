"""Trace payloads to spans.

Every ``*_spans`` function takes rows with a ``text`` column, one JSON document or
line each, and parses them with ``from_json``; other columns named in ``keep``
(such as ``source_id``) stay on the spans.  ``read_traces`` adds file handling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import codes, ids
from spanloom.functions.text import first_case
from spanloom.operators import intervals
from spanloom.schemas import conform_spans
from spanloom.session import configure, cut, landed

MIN_CHROME_NS = 1_000_000

# JSON scalars are read as text; numbers may come quoted or bare.
_KV = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>>>"
_OTLP = (
    f"resourceSpans array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<"
    f"scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,"
    f"parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},"
    f"events:array<struct<name:string,timeUnixNano:string,attributes:{_KV}>>,"
    f"links:array<struct<traceId:string,spanId:string,attributes:{_KV}>>,status:struct<code:string,message:string>>>>>>>"
)
_CONTEXT = "struct<TraceID:string,SpanID:string>"
_TYPED = "array<struct<Key:string,Value:struct<Type:string,Value:string>>>"
_STDOUT = (
    f"Name string, SpanContext {_CONTEXT}, Parent {_CONTEXT}, SpanKind int, StartTime string, EndTime string, "
    f"Attributes {_TYPED}, Events array<struct<Name:string,Attributes:{_TYPED},Time:string>>, "
    f"Links array<struct<SpanContext:{_CONTEXT},Attributes:{_TYPED}>>, Status struct<Code:string,Description:string>, "
    f"Resource {_TYPED}, InstrumentationScope struct<Name:string,Version:string>"
)
_FLAT = (
    f"Name string, SpanContext {_CONTEXT}, ParentSpanID string, SpanKind int, StartTime string, EndTime string, "
    "Attributes map<string,variant>, Events array<struct<Name:string,Attributes:map<string,variant>,Time:string>>, "
    "Status struct<Code:string,Description:string>, Resource map<string,variant>"
)
_TAGS = "array<struct<key:string,type:string,value:string>>"
_JAEGER = (
    "data array<struct<traceID:string,spans:array<struct<traceID:string,spanID:string,operationName:string,"
    "references:array<struct<refType:string,traceID:string,spanID:string>>,startTime:bigint,duration:bigint,"
    f"tags:{_TAGS},logs:array<struct<timestamp:bigint,fields:{_TAGS}>>,processID:string>>,"
    f"processes:map<string,struct<serviceName:string,tags:{_TAGS}>>>>"
)
_ZIPKIN = (
    "array<struct<traceId:string,id:string,parentId:string,name:string,kind:string,timestamp:bigint,"
    "duration:bigint,localEndpoint:struct<serviceName:string>,tags:map<string,string>>>"
)
_CHROME_EVENT = (
    "struct<name:string,ph:string,ts:double,dur:double,pid:string,tid:string,cat:string,args:map<string,string>>"
)
# Declared attribute types by source name.
_JAEGER_TYPES = {"string": "STRING", "int64": "INT64", "float64": "FLOAT64", "bool": "BOOL"}


def _kept(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("text", "file")]


def _seq(docs: DataFrame) -> Column:
    """Input order for first-seen rules; streams have none."""
    return F.lit(None).cast("bigint") if docs.isStreaming else F.monotonically_increasing_id()


def _entries(raw: Column, make) -> Column:
    return F.transform(F.coalesce(raw, F.array()), make)


def _entry(key: Column, value: Column, kind: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"), kind.alias("type"))


def _otlp_attrs(raw: Column) -> Column:
    def one(a: Column) -> Column:
        v = a["value"]
        whole = v["intValue"].try_cast("bigint").cast("string")
        value = F.coalesce(v["stringValue"], whole, v["doubleValue"], v["boolValue"])
        kind = (
            F.when(v["stringValue"].isNotNull(), "STRING").when(v["intValue"].isNotNull(), "INT64")
            .when(v["doubleValue"].isNotNull(), "FLOAT64").otherwise("BOOL")
        )
        return _entry(a["key"], value, kind)

    return _entries(raw, one)


def _stdout_attrs(raw: Column) -> Column:
    return _entries(raw, lambda a: _entry(
        a["Key"], a["Value"]["Value"],
        F.when(a["Value"]["Type"].isin("INT64", "FLOAT64", "BOOL"), a["Value"]["Type"]).otherwise("STRING"),
    ))


def _flat_attrs(raw: Column) -> Column:
    def one(e: Column) -> Column:
        value = F.variant_get(e["value"], "$", "string")
        shape = F.schema_of_variant(e["value"])
        whole = value.rlike(r"^-?\d+(\.0+)?$")
        kind = (
            F.when(shape == "BOOLEAN", "BOOL")
            .when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.when(whole, "INT64").otherwise("FLOAT64"))
            .otherwise("STRING")
        )
        return _entry(e["key"], F.when(kind == "INT64", F.regexp_replace(value, r"\.0+$", "")).otherwise(value), kind)

    return _entries(F.map_entries(raw), one)


def _jaeger_attrs(raw: Column) -> Column:
    def one(t: Column) -> Column:
        value = (
            F.when(t["type"] == "int64", t["value"].try_cast("bigint").cast("string"))
            .when(t["type"].isin(*_JAEGER_TYPES), t["value"])
        )
        return _entry(t["key"], value, first_case([(t["type"] == k, F.lit(v)) for k, v in _JAEGER_TYPES.items()], F.lit("STRING")))

    return _entries(raw, one)


def otlp_spans(docs: DataFrame) -> DataFrame:
    """OTLP JSON export requests; spans with invalid ids drop out."""
    keep = _kept(docs)
    rows = docs.select(*keep, F.explode(F.from_json("text", _OTLP)["resourceSpans"]).alias("r"))
    rows = rows.select(*keep, F.col("r.resource.attributes").alias("_resource"), F.explode("r.scopeSpans").alias("s"))
    rows = rows.select(*keep, "_resource", F.col("s.scope").alias("_scope"), F.explode("s.spans").alias("x"))
    x = F.col("x")
    rows = rows.where(ids.is_trace_id(x["traceId"]) & ids.is_span_id(x["spanId"]))
    attrs = _otlp_attrs(x["attributes"])
    events = _entries(x["events"], lambda e: F.struct(
        e["name"].alias("name"), e["timeUnixNano"].try_cast("bigint").alias("time_ns"),
        codes.attrs_of(_otlp_attrs(e["attributes"])).alias("attrs"),
    ))
    links = _entries(x["links"], lambda k: F.struct(
        k["traceId"].alias("trace_id"), k["spanId"].alias("span_id"),
        codes.attrs_of(_otlp_attrs(k["attributes"])).alias("attrs"),
    ))
    return conform_spans(rows.withColumns({
        "trace_id": F.lower(x["traceId"]), "span_id": F.lower(x["spanId"]),
        "parent_span_id": ids.valid_span_id(x["parentSpanId"]), "name": x["name"],
        "kind": codes.kind_name(F.coalesce(x["kind"].try_cast("int"), F.lit(0))),
        "start_ns": x["startTimeUnixNano"].try_cast("bigint"), "end_ns": x["endTimeUnixNano"].try_cast("bigint"),
        "attrs": codes.attrs_of(attrs), "attr_types": codes.types_of(attrs),
        "resource": codes.attrs_of(_otlp_attrs(F.col("_resource"))),
        "scope_name": F.coalesce(F.col("_scope.name"), F.lit("")), "scope_version": F.coalesce(F.col("_scope.version"), F.lit("")),
        "status_code": codes.status_name(F.coalesce(x["status"]["code"].try_cast("int"), F.lit(0))),
        "status_message": F.coalesce(x["status"]["message"], F.lit("")),
        "events": events, "links": links, "seq": _seq(docs),
    }))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines of an array or a list of objects: brackets and trailing commas go."""
    clean = F.regexp_replace(F.trim("text"), r",\s*$", "")
    return docs.withColumn("text", clean).where(~F.col("text").rlike(r"^[\[\]]?$"))


def _context(rows: DataFrame, context: Column) -> DataFrame:
    """Rows whose ids are both valid, or both absent."""
    trace, span = F.coalesce(context["TraceID"], F.lit("")), F.coalesce(context["SpanID"], F.lit(""))
    return rows.where(((trace == "") & (span == "")) | (ids.is_trace_id(trace) & ids.is_span_id(span)))


def stdout_spans(docs: DataFrame) -> DataFrame:
    """One span object per line, as the stdout exporter writes; bad lines drop out."""
    keep = _kept(docs)
    x = F.col("x")
    rows = _lines(docs).select(*keep, F.from_json("text", _STDOUT).alias("x"))
    rows = _context(rows.where(x["StartTime"].isNotNull()), x["SpanContext"])
    attrs = _stdout_attrs(x["Attributes"])
    events = _entries(x["Events"], lambda e: F.struct(
        e["Name"].alias("name"), ids.parse_time_ns(e["Time"]).alias("time_ns"), codes.attrs_of(_stdout_attrs(e["Attributes"])).alias("attrs"),
    ))
    links = _entries(x["Links"], lambda k: F.struct(
        k["SpanContext"]["TraceID"].alias("trace_id"), k["SpanContext"]["SpanID"].alias("span_id"),
        codes.attrs_of(_stdout_attrs(k["Attributes"])).alias("attrs"),
    ))
    return conform_spans(rows.withColumns({
        "trace_id": F.lower(x["SpanContext"]["TraceID"]), "span_id": F.lower(x["SpanContext"]["SpanID"]),
        "parent_span_id": ids.valid_span_id(x["Parent"]["SpanID"]), "name": x["Name"],
        "kind": codes.kind_name(F.coalesce(x["SpanKind"], F.lit(0))),
        "start_ns": ids.parse_time_ns(x["StartTime"]), "end_ns": ids.parse_time_ns(x["EndTime"]),
        "attrs": codes.attrs_of(attrs), "attr_types": codes.types_of(attrs),
        "resource": codes.attrs_of(_stdout_attrs(x["Resource"])),
        "scope_name": F.coalesce(x["InstrumentationScope"]["Name"], F.lit("")),
        "scope_version": F.coalesce(x["InstrumentationScope"]["Version"], F.lit("")),
        "status_code": codes.normal_status(F.coalesce(x["Status"]["Code"], F.lit(""))),
        "status_message": F.coalesce(x["Status"]["Description"], F.lit("")),
        "events": events, "links": links, "seq": _seq(docs),
    }))


def flat_spans(docs: DataFrame) -> DataFrame:
    """Spans with attribute maps and ``ParentSpanID``; resource keys are copied as ``resource.*``."""
    keep = _kept(docs)
    x = F.col("x")
    rows = _lines(docs).select(*keep, F.from_json("text", _FLAT).alias("x"))
    rows = _context(rows.where(x["StartTime"].isNotNull()), x["SpanContext"])
    resource = _flat_attrs(x["Resource"])
    copied = F.transform(resource, lambda e: _entry(F.concat(F.lit("resource."), e["key"]), e["value"], e["type"]))
    attrs = F.concat(_flat_attrs(x["Attributes"]), copied)
    events = _entries(x["Events"], lambda e: F.struct(
        e["Name"].alias("name"), ids.parse_time_ns(e["Time"]).alias("time_ns"), codes.attrs_of(_flat_attrs(e["Attributes"])).alias("attrs"),
    ))
    return conform_spans(rows.withColumns({
        "trace_id": F.lower(x["SpanContext"]["TraceID"]), "span_id": F.lower(x["SpanContext"]["SpanID"]),
        "parent_span_id": ids.valid_span_id(x["ParentSpanID"]), "name": x["Name"],
        "kind": codes.kind_name(F.coalesce(x["SpanKind"], F.lit(0))),
        "start_ns": ids.parse_time_ns(x["StartTime"]), "end_ns": ids.parse_time_ns(x["EndTime"]),
        "attrs": codes.attrs_of(attrs), "attr_types": codes.types_of(attrs), "resource": codes.attrs_of(resource),
        "status_code": codes.normal_status(F.coalesce(x["Status"]["Code"], F.lit(""))),
        "status_message": F.coalesce(x["Status"]["Description"], F.lit("")),
        "events": events, "seq": _seq(docs),
    }))


def jaeger_spans(docs: DataFrame) -> DataFrame:
    """Jaeger API documents; the process map of a trace gives the resource."""
    keep = _kept(docs)
    rows = docs.select(*keep, F.explode(F.from_json("text", _JAEGER)["data"]).alias("d"))
    rows = rows.select(*keep, F.col("d.processes").alias("_processes"), F.explode("d.spans").alias("x"))
    x = F.col("x")
    rows = rows.where(ids.is_trace_id(x["traceID"]) & ids.is_span_id(x["spanID"]))
    process = F.try_element_at("_processes", x["processID"])
    service = F.array(_entry(F.lit("service.name"), process["serviceName"], F.lit("STRING")))
    attrs = _jaeger_attrs(x["tags"])
    tag = codes.attrs_of(attrs)
    parent = F.get(F.filter(x["references"], lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]

    def event(log: Column) -> Column:
        named = F.filter(log["fields"], lambda f: f["key"].isin("event", "message") & (f["type"] == "string"))
        return F.struct(
            F.coalesce(F.try_element_at(named, F.lit(-1))["value"], F.lit("log")).alias("name"),
            (log["timestamp"] * 1000).alias("time_ns"), codes.attrs_of(_jaeger_attrs(log["fields"])).alias("attrs"),
        )

    return conform_spans(rows.withColumns({
        "trace_id": F.lower(x["traceID"]), "span_id": F.lower(x["spanID"]), "parent_span_id": ids.valid_span_id(parent),
        "name": x["operationName"], "start_ns": x["startTime"] * 1000, "end_ns": (x["startTime"] + x["duration"]) * 1000,
        "attrs": tag, "attr_types": codes.types_of(attrs),
        "resource": codes.attrs_of(F.concat(service, _jaeger_attrs(process["tags"]))),
        "status_code": codes.normal_status(F.coalesce(tag["otel.status_code"], F.lit(""))),
        "status_message": F.coalesce(tag["otel.status_description"], F.lit("")),
        "events": _entries(x["logs"], event), "seq": _seq(docs),
    }))


def zipkin_spans(docs: DataFrame) -> DataFrame:
    """Zipkin v2 arrays; short trace ids are padded to 128 bits."""
    keep = _kept(docs)
    rows = docs.select(*keep, F.explode(F.from_json("text", _ZIPKIN)).alias("x"))
    x = F.col("x")
    trace = F.when(F.length(x["traceId"]) == 16, F.lpad(x["traceId"], 32, "0")).otherwise(x["traceId"])
    rows = rows.where(ids.is_trace_id(trace) & ids.is_span_id(x["id"]))
    service = F.nullif(x["localEndpoint"]["serviceName"], F.lit(""))
    none = F.create_map().cast("map<string,string>")
    own = F.when(service.isNotNull(), F.create_map(F.lit("service.name"), service)).otherwise(none)
    return conform_spans(rows.withColumns({
        "trace_id": F.lower(trace), "span_id": F.lower(x["id"]), "parent_span_id": ids.valid_span_id(x["parentId"]),
        "name": x["name"], "kind": codes.kind_from_text(x["kind"]),
        "start_ns": x["timestamp"] * 1000, "end_ns": (x["timestamp"] + F.coalesce(x["duration"], F.lit(0))) * 1000,
        "attrs": F.map_concat(own, F.coalesce(x["tags"], none)), "resource": own,
        "seq": _seq(docs),
    }))


def chrome_events(docs: DataFrame) -> DataFrame:
    """Trace events of Chrome documents (wrapped or bare), timed and numbered.

    The trace id is the digest of the document's events in file order and of where the
    document comes from.  ``_doc`` tells equal documents apart; it holds once the result
    is written.
    """
    keep = _kept(docs)
    origin = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in docs.columns if c in ("source_id", "file")]
    wrapped = F.from_json("text", f"traceEvents array<{_CHROME_EVENT}>, otherData map<string,string>")
    bare = F.from_json("text", f"array<{_CHROME_EVENT}>")
    rows = docs.select(
        *keep, F.monotonically_increasing_id().alias("_doc"), F.concat_ws(":", *origin).alias("_origin"),
        F.when(F.size(wrapped["traceEvents"]) > 0, wrapped["traceEvents"]).otherwise(bare).alias("_events"),
        wrapped["otherData"].alias("other"),
    )
    mark = F.transform("_events", lambda e: F.concat(
        F.coalesce(e["name"], F.lit("")), F.lit(":"), F.coalesce(e["ph"], F.lit("")), F.lit(":"),
        F.format_string("%.0f", F.coalesce(e["ts"], F.lit(0.0))),
    ))
    rows = rows.withColumn("trace_id", F.substring(F.sha2(F.concat(F.array_join(mark, ""), "_origin"), 256), 1, 32))
    rows = rows.select(*keep, "_doc", "trace_id", "other", F.posexplode("_events").alias("seq", "e"))
    shift = F.coalesce(F.col("other")["profile_start_ts"].try_cast("double"), F.lit(0.0)) * 1000
    micros = F.coalesce(F.col("e.ts"), F.lit(0.0)) + shift
    start = (micros * 1000).cast("bigint")
    end = ((micros + F.coalesce(F.col("e.dur"), F.lit(0.0))) * 1000).cast("bigint")
    return rows.select(
        *keep, "_doc", "trace_id", "other", F.col("seq").cast("bigint").alias("seq"), F.col("e.name").alias("name"),
        F.col("e.ph").alias("ph"), F.coalesce("e.pid", F.lit("")).alias("pid"), F.coalesce("e.tid", F.lit("")).alias("tid"),
        F.col("e.cat").alias("cat"), F.col("e.args").alias("args"), start.alias("ts_ns"), (end - start).alias("dur_ns"),
    )


def _names(events: DataFrame, kind: str, keys: list[str], out: str) -> DataFrame:
    """Last name a metadata row gave to a process or thread."""
    name = F.nullif(F.col("args")["name"], F.lit(""))
    rows = events.where((F.col("ph") == "M") & (F.col("name") == kind) & name.isNotNull())
    return rows.groupBy(*keys).agg(F.max_by(name, F.struct("ts_ns", "seq")).alias(out))


def chrome_spans(docs: DataFrame) -> DataFrame:
    """Chrome trace documents as nested spans; complete events under 1 ms drop out."""
    keep = _kept(docs)
    # Parsed once: pairing, nesting and naming all read the events.
    events = cut(chrome_events(docs))
    whole = events.where((F.col("ph") == "X") & (F.col("dur_ns") >= MIN_CHROME_NS)).withColumn("_at", F.col("ts_ns"))
    pairs = intervals.pair_begin_end(events, ["_doc", "pid", "tid", "name"])
    pairs = pairs.where(F.col("dur_ns") >= MIN_CHROME_NS).withColumn("_at", F.col("ts_ns") + F.col("dur_ns"))
    moments = events.where(F.col("ph").isin("i", "I")).withColumns({"dur_ns": F.lit(0).cast("bigint"), "_at": F.col("ts_ns")})
    found = whole.unionByName(pairs).unionByName(moments)
    # A document is one input row, so numbering its events is bounded by it.
    number = F.row_number().over(Window.partitionBy("_doc").orderBy("_at", "seq")) - 1
    found = found.withColumn("_n", number.cast("bigint"))
    digest = F.sha2(F.concat(F.unhex("trace_id"), F.unhex(F.lpad(F.hex("_n"), 16, "0"))), 256)
    found = cut(found.withColumn("span_id", F.substring(digest, 1, 16)))
    links = intervals.nest_by_containment(found, ["_doc", "pid", "tid"]).select("_doc", "seq", "parent_seq")
    parents = found.select("_doc", F.col("seq").alias("parent_seq"), F.col("span_id").alias("parent_span_id"))
    found = found.join(links, ["_doc", "seq"], "left").join(parents, ["_doc", "parent_seq"], "left")
    found = found.join(_names(events, "thread_name", ["_doc", "pid", "tid"], "_thread"), ["_doc", "pid", "tid"], "left")
    found = found.join(_names(events, "process_name", ["_doc", "pid"], "_process"), ["_doc", "pid"], "left")
    none = F.create_map().cast("map<string,string>")
    own = codes.attr_map([
        codes.entry("chrome.category", F.nullif(F.col("cat"), F.lit(""))), codes.entry("chrome.pid", F.col("pid")),
        codes.entry("chrome.tid", F.col("tid")), codes.entry("chrome.thread_name", F.col("_thread")),
        codes.entry("chrome.process_name", F.col("_process")),
    ])

    def prefixed(column: str, prefix: str) -> Column:
        return F.coalesce(F.transform_keys(column, lambda k, _: F.concat(F.lit(prefix), k)), none)

    attrs = F.map_concat(own, prefixed("other", "chrome.metadata."), prefixed("args", "chrome.args."))
    return conform_spans(found.select(
        *keep, "trace_id", "span_id", "parent_span_id", "name", F.col("ts_ns").alias("start_ns"),
        (F.col("ts_ns") + F.col("dur_ns")).alias("end_ns"), attrs.alias("attrs"), "seq",
    ))


# Markers of the formats in the order they are tried.
FORMATS = ["otlp", "jaeger", "chrome", "zipkin", "flat", "stdout"]
LINE_FORMATS = {"otlp": otlp_spans, "flat": flat_spans, "stdout": stdout_spans}
MAGIC = {"gzip": b"\x1f\x8b", "zstd": b"\x28\xb5\x2f\xfd"}
PACKED = "packed"
DOCUMENT_FORMATS = {"jaeger": jaeger_spans, "chrome": chrome_spans, "zipkin": zipkin_spans}


def _markers(text: Column) -> list[tuple[str, list[Column]]]:
    return [
        ("otlp", [text.contains('"resourceSpans"')]),
        ("jaeger", [text.contains('"traceID"'), text.contains('"operationName"')]),
        ("chrome", [text.contains('"traceEvents"') | text.rlike(r'"ph"[ \t]*:')]),
        ("zipkin", [text.contains('"localEndpoint"')]),
        ("flat", [text.contains('"ParentSpanID"')]),
    ]


def document_format(text: Column) -> Column:
    """Format of one document by its marker keys."""
    return first_case([(reduce(lambda a, b: a & b, tests), F.lit(name)) for name, tests in _markers(text)], F.lit("stdout"))


def file_formats(lines: DataFrame) -> DataFrame:
    """Format of every file from its lines; one flag row per file and task is shuffled."""
    begins = [F.substring(F.col("text").cast("binary"), 1, len(magic)) == F.lit(magic) for magic in MAGIC.values()]
    flags = [F.bool_or(reduce(lambda a, b: a | b, begins)).alias("_packed")]
    cases = [(F.col("_packed"), F.lit(PACKED))]
    for name, tests in _markers(F.col("text")):
        seen = []
        for i, test in enumerate(tests):
            flags.append(F.bool_or(test).alias(f"_{name}{i}"))
            seen.append(F.col(f"_{name}{i}"))
        cases.append((reduce(lambda a, b: a & b, seen), F.lit(name)))
    return lines.groupBy("file").agg(*flags).select("file", first_case(cases, F.lit("stdout")).alias("format"))


def _unpacked(data: bytes) -> bytes:
    """Every member of gzip or zstd data; what follows the last one (a line end) is left."""
    out = []
    while True:
        if data.startswith(MAGIC["gzip"]):
            one = zlib.decompressobj(wbits=31)
        elif data.startswith(MAGIC["zstd"]):
            one = zstandard.ZstdDecompressor().decompressobj()
        else:
            return b"".join(out)
        out.append(one.decompress(data))
        data = one.unused_data


def unpack(files: DataFrame) -> DataFrame:
    """(file, text) of compressed files, whatever their names; broken data fails with the file's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                name = batch.column("file")[i].as_py()
                try:
                    text = _unpacked(batch.column("data")[i].as_py()).decode("utf-8", "replace")
                except (zlib.error, zstandard.ZstdError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text])], ["file", "text"])

    return files.select("file", F.col("text").cast("binary").alias("data")).mapInArrow(run, "file string, text string")


def parse_documents(docs: DataFrame) -> DataFrame:
    """Documents of any mix of formats, told apart one by one."""
    kinds = docs.withColumn("_format", document_format(F.col("text")))
    parsers = {**LINE_FORMATS, **DOCUMENT_FORMATS}
    parts = [parsers[f](kinds.where(F.col("_format") == f).drop("_format")) for f in FORMATS]
    return reduce(DataFrame.unionByName, parts)


def _text(spark: SparkSession, path: str | list[str], whole: bool) -> DataFrame:
    rows = spark.read.text(path, wholetext=whole)
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def read_traces(
    spark: SparkSession, path: str | list[str], format: str = "auto", sources: DataFrame | None = None,
    pretty: bool = False,
) -> DataFrame:
    """Spans of trace files.  ``.gz`` and ``.zst`` files are read by extension, with ``auto`` also by their first bytes.

    OTLP lines, stdout and flat spans are split by line.  Jaeger, Zipkin and
    Chrome files (and pretty-printed OTLP) are documents, one row per file.
    With ``auto`` each file's format is told from its lines, and the lines of document
    files are put together again, in their order, to one row per file; no list of
    files passes through the driver.  ``sources`` (file, source_id) tags every file.
    """
    configure(spark)

    def tagged(docs: DataFrame) -> DataFrame:
        if sources is None:
            return docs.withColumn("source_id", F.lit(0))
        return docs.join(sources.select("file", "source_id"), "file", "left")

    if format != "auto":
        parser = {**LINE_FORMATS, **DOCUMENT_FORMATS}[format]
        return parser(tagged(_text(spark, path, pretty or format in DOCUMENT_FORMATS)))
    lines = _text(spark, path, False)
    # A row for each file, written once: formats that no file has cost nothing, and lines find theirs without a shuffle.
    kinds = landed(file_formats(lines))
    found = _formats(kinds)
    parts = []
    for name in [f for f in LINE_FORMATS if f in found] or ["stdout"]:
        files = kinds.where(F.col("format") == name).select("file")
        parts.append(LINE_FORMATS[name](tagged(lines.join(files, "file", "left_semi"))))
    whole = [PACKED, *DOCUMENT_FORMATS]
    if found.isdisjoint(whole):
        return reduce(DataFrame.unionByName, parts)
    # A document is one row however it is read; its lines meet by file.
    placed = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
    )
    chosen = placed.join(kinds.where(F.col("format").isin(whole)), "file")
    documents = chosen.groupBy("file", "format").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("lines"))
    documents = documents.select("file", "format", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
    # Compressed files come as the bytes their lines make up, and show their format when unpacked: once, for all formats.
    if PACKED in found:
        packed = documents.where(F.col("format") == PACKED).select("file", F.concat("text", F.lit("\n")).alias("text"))
        opened = landed(unpack(packed).withColumn("format", document_format(F.col("text"))), "format")
        inside = _formats(opened)
    else:
        opened, inside = documents.limit(0), set()
    for name in [f for f in DOCUMENT_FORMATS if f in found | inside]:
        both = documents.unionByName(opened).where(F.col("format") == name)
        parts.append(DOCUMENT_FORMATS[name](tagged(both.drop("format"))))
    for name in [f for f in LINE_FORMATS if f in inside]:
        own = opened.where(F.col("format") == name).select("file", F.explode(F.split("text", "\r\n|\r|\n")).alias("text"))
        parts.append(LINE_FORMATS[name](tagged(own)))
    return reduce(DataFrame.unionByName, parts)


def _formats(files: DataFrame) -> set[str]:
    """The formats that occur, a few at most."""
    return {row[0] for row in files.select("format").distinct().collect()}


def with_source(spans: DataFrame, source_id: int) -> DataFrame:
    """Tag spans with their input, on the column and as an attribute."""
    tag = F.create_map(F.lit("github.url_index"), F.lit(str(source_id)))
    return spans.withColumn("source_id", F.lit(source_id)).withColumn("attrs", F.map_concat("attrs", tag))


def of_traces(spans: DataFrame, trace_ids: list[str] | DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Spans of given traces: a pushed-down list, or a semi join with an id table.

    For a table written by date, ``dates`` (trace_id, start_date) tells where the traces are; the scan then reads
    those dates only, and the folder of spans without a start.
    """
    if isinstance(trace_ids, DataFrame):
        wanted = trace_ids.select("trace_id").distinct()
        chosen = spans.join(wanted, "trace_id", "left_semi")
        known = None if dates is None else dates.join(wanted, "trace_id", "left_semi")
    else:
        among = F.col("trace_id").isin([t.lower() for t in trace_ids])
        chosen = spans.where(among)
        known = None if dates is None else dates.where(among)
    if known is None:
        return chosen
    placed = chosen.join(known.select("trace_id", "start_date").distinct(), ["trace_id", "start_date"], "left_semi")
    return placed.unionByName(chosen.where(F.col("start_date").isNull()))
