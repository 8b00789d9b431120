"""Span classification: one ``hints`` struct per span, built from columns only.

An enricher is a function ``(Span) -> (matches, fields)``: a condition and the
hint columns it gives.  :func:`enrich` takes the first enricher that matches.
Attributes are looked up once, into flat columns; each hint field is its own
small ``CASE``, so that a filter on one field never drags in the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.codes import attribute
from spanloom.functions.text import all_of, first_case, glob
from spanloom.operators.rules import GIVES, NAME, conditions, given, matched

FIELDS = {
    "category": "string", "outcome": "string", "icon": "string", "bar_char": "string",
    "color": "string", "url": "string", "user": "string", "event_type": "string",
    "is_required": "boolean", "is_marker": "boolean", "is_root": "boolean", "is_leaf": "boolean",
    "sort_priority": "int", "dedup_key": "string", "group_key": "string", "vcs_branch": "string",
    "vcs_revision": "string", "run_id": "string", "detail": "string", "service_name": "string",
    "environment": "string",
}
RULES_INLINE = 32
_DEFAULT = {"string": "", "boolean": False, "int": 0}


@dataclass
class Span:
    """What an enricher may look at; attribute keys asked for are collected."""

    name: Column
    zero_duration: Column
    kind: Column
    keys: dict[str, str] = field(default_factory=dict)
    values: list[Column] = field(default_factory=list)

    def once(self, value: Column) -> Column:
        """A value worked out once, beside the attributes looked up."""
        self.values.append(value)
        return F.col(f"_value_{len(self.values) - 1}")

    def raw(self, key: str) -> Column:
        """Attribute value, null when absent."""
        return F.col(self.keys.setdefault(key, f"_attr_{len(self.keys)}"))

    def get(self, key: str) -> Column:
        """Attribute value, empty text when absent."""
        return F.coalesce(self.raw(key), F.lit(""))

    def first(self, *keys: str) -> Column:
        """First non-empty attribute of ``keys``."""
        return F.coalesce(*[F.nullif(self.raw(k), F.lit("")) for k in keys], F.lit(""))

    @property
    def status_code(self) -> Column:
        """OK or ERROR of the span itself, else of its attributes."""
        return F.coalesce(F.col("_status"), self.raw("otel.status_code"), F.lit(""))


Fields = dict[str, Column]
Enricher = Callable[[Span], tuple[Column, Fields]]


def hints(**values: Column | str | bool | int) -> Fields:
    """Hint columns; a field not given takes its zero value."""
    unknown = set(values) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown hint fields: {sorted(unknown)}")
    return {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}


def _pick(key: Column, table: dict, default: str) -> Column:
    return first_case([(key == k, F.lit(v)) for k, v in table.items()], F.lit(default))


# Icons and bar characters by CI span type.
CI_ICONS = {"workflow": "📋", "job": "⚙️", "step": "↳", "log_span": "░"}
CI_BARS = {"workflow": "█", "job": "█", "step": "▒", "log_span": "░"}
CI_TYPES = ["workflow", "job", "step", "marker", "log_span"]
# Marker icon, bar, colour and outcome by event type.
MARKERS = {
    "merged": ("◆ ", "◆", "green", "success"),
    "approved": ("▲ ", "✓", "green", "success"),
    "comment": ("● ", "●", "blue", "pending"),
    "commented": ("● ", "●", "blue", "pending"),
    "COMMENTED": ("● ", "●", "blue", "pending"),
    "changes_requested": ("❌", "✗", "red", "failure"),
}
OTHER_MARKER = ("▲ ", "▲", "blue", "pending")


def ci_enricher(span: Span) -> tuple[Column, Fields]:
    """Spans of CI runs, recognised by their ``type`` attribute."""
    kind = span.get("type")
    status, conclusion = span.get("github.status"), span.get("github.conclusion")
    event = span.get("github.event_type")
    pending = status.isin("in_progress", "queued", "waiting")
    skipped = conclusion.isin("skipped", "cancelled")
    plain_log = (kind == "log_span") & (conclusion == "") & ~pending
    outcome = (
        F.when(pending, "pending")
        .when(conclusion.isin("success", "failure"), conclusion)
        .when(skipped, "skipped")
        .when(plain_log, "success")
        .otherwise("")
    )
    color = (
        F.when(pending, "blue").when(conclusion == "success", "green")
        .when(conclusion == "failure", "red").when(plain_log, "green").otherwise("gray")
    )
    marker = kind == "marker"

    def of_marker(part: int) -> Column:
        return _pick(event, {k: v[part] for k, v in MARKERS.items()}, OTHER_MARKER[part])

    event_id = span.get("github.event_id")
    base_key = F.concat_ws("-", event, span.get("github.user"), span.get("github.event_time"))
    dedup = F.when(event_id != "", F.concat_ws("-", event_id, base_key)).otherwise(base_key)
    found = hints(
        category=kind, url=span.get("github.url"), user=span.get("github.user"), event_type=event,
        is_required=span.get("github.is_required") == "true",
        outcome=F.when(marker, of_marker(3)).otherwise(outcome),
        color=F.when(marker, of_marker(2)).otherwise(color),
        icon=F.when(marker, of_marker(0)).otherwise(_pick(kind, CI_ICONS, "")),
        bar_char=F.when(marker, of_marker(1)).otherwise(_pick(kind, CI_BARS, "")),
        is_root=kind == "workflow", is_leaf=kind.isin("step", "log_span"), is_marker=marker,
        sort_priority=F.when(marker, -1).otherwise(0),
        group_key=F.when(marker, "activity"), dedup_key=F.when(marker, dedup),
    )
    return kind.isin(*CI_TYPES), found


# Icons by pipeline or task type.
TASK_ICONS = {"deploy": "🚀 ", "build": "🔨 ", "test": "🧪 "}
# Outcome and colour by run result.
RESULTS = {
    "success": ("success", "green"), "failure": ("failure", "red"),
    "cancelled": ("skipped", "gray"), "error": ("failure", "red"),
}


def cicd_enricher(span: Span) -> tuple[Column, Fields]:
    """Spans with the CI/CD semantic conventions of any CI system."""
    pipeline, task = span.get("cicd.pipeline.name"), span.get("cicd.pipeline.task.name")
    root = task == ""
    result = span.first("cicd.pipeline.task.run.result", "cicd.pipeline.run.result")
    by_status = {"OK": ("success", "green"), "ERROR": ("failure", "red")}

    def of_result(part: int, default: str) -> Column:
        status = _pick(span.status_code, {k: v[part] for k, v in by_status.items()}, default)
        return first_case(
            [(result == k, F.lit(v[part])) for k, v in RESULTS.items()], status
        )

    root_icon = _pick(span.get("cicd.pipeline.type"), TASK_ICONS, "▶ ")
    task_icon = _pick(span.get("cicd.pipeline.task.type"), TASK_ICONS, "⚙ ")
    found = hints(
        category=F.when(root, "pipeline").otherwise("task"), is_root=root, bar_char="█",
        icon=F.when(root, root_icon).otherwise(task_icon),
        url=span.first(
            "cicd.pipeline.task.run.url.full", "cicd.pipeline.run.url.full", "vcs.repository.url.full"
        ),
        vcs_branch=span.get("vcs.ref.head.name"), vcs_revision=span.get("vcs.revision"),
        run_id=F.when(root, span.get("cicd.pipeline.run.id")).otherwise(
            span.get("cicd.pipeline.task.run.id")
        ),
        outcome=of_result(0, ""), color=of_result(1, "blue"),
    )
    return (pipeline != "") | (task != ""), found


# Icons of generic spans.
CATEGORY_ICONS = {"http": "⇄ ", "database": "⛁ ", "rpc": "⇌ ", "messaging": "✉ ", "faas": "λ "}
KIND_ICONS = {"SERVER": "⇣ ", "CLIENT": "⇢ ", "PRODUCER": "⇡ ", "CONSUMER": "⇠ "}
STATEMENT_BYTES = 80


def _join_if(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(""))


def generic_enricher(span: Span, statement_bytes: int | None = STATEMENT_BYTES) -> tuple[Column, Fields]:
    """Any span, by the general semantic conventions; database statements are cut to ``statement_bytes`` (None: whole)."""
    method = span.first("http.request.method", "http.method")
    route = span.first("http.route", "url.path")
    server, port = span.get("server.address"), span.get("server.port")
    code = span.first("http.response.status_code", "http.status_code").try_cast("int")
    db, rpc = span.get("db.system"), span.get("rpc.system")
    msg, faas = span.get("messaging.system"), span.get("faas.trigger")
    marker = span.zero_duration
    category = (
        F.when(marker, "marker").when(method != "", "http").when(db != "", "database")
        .when(rpc != "", "rpc").when(msg != "", "messaging").when(faas != "", "faas")
        .otherwise("operation")
    )
    http_detail = F.concat(
        method,
        _join_if(route != "", F.concat(F.lit(" "), route)),
        _join_if((server != "") & (port != ""), F.concat(F.lit(" → "), server, F.lit(":"), port)),
        F.coalesce(F.concat(F.lit(" ["), code.cast("string"), F.lit("]")), F.lit("")),
    )
    statement, operation, table = span.get("db.statement"), span.get("db.operation"), span.get("db.sql.table")
    short = statement
    if statement_bytes is not None:
        head = F.make_valid_utf8(F.substring(F.encode(statement, "UTF-8"), 1, statement_bytes - 3).cast("string"))
        short = F.when(F.octet_length(statement) > statement_bytes, F.concat(head, F.lit("..."))).otherwise(statement)
    db_detail = (
        F.when(statement != "", F.concat(db, F.lit(": "), short))
        .when(operation != "", F.concat(db, F.lit(": "), operation, _join_if(table != "", F.concat(F.lit(" "), table))))
        .otherwise(db)
    )
    service, call = span.get("rpc.service"), span.get("rpc.method")
    rpc_detail = F.when(
        service != "",
        F.concat(rpc, F.lit(" "), service, _join_if(call != "", F.concat(F.lit("/"), call))),
    ).otherwise(rpc)
    target, action = span.get("messaging.destination.name"), span.get("messaging.operation")
    msg_detail = F.concat(
        msg, _join_if(target != "", F.concat(F.lit(" "), target)),
        _join_if(action != "", F.concat(F.lit(" ("), action, F.lit(")"))),
    )
    function = span.get("faas.name")
    faas_detail = F.when(function != "", F.concat(function, F.lit(" ("), faas, F.lit(")"))).otherwise(faas)
    failed_http = (category == "http") & (code >= 400)
    status = span.status_code
    outcome = F.when(failed_http, "failure").when(status == "OK", "success").when(status == "ERROR", "failure").otherwise("")
    color = F.when(failed_http, "red").when(status == "OK", "green").when(status == "ERROR", "red").otherwise("blue")
    return F.lit(True), hints(
        category=category, outcome=outcome, color=color, is_marker=marker,
        sort_priority=F.when(marker, -1).otherwise(0),
        bar_char=F.when(marker, "▲").otherwise("█"),
        icon=F.when(marker, F.lit("▲ "))
        .when(category == "operation", _pick(span.kind, KIND_ICONS, "● "))
        .otherwise(_pick(category, CATEGORY_ICONS, "● ")),
        group_key=F.when(span.get("github.artifact_name") != "", "artifact"),
        service_name=span.get("service.name"), environment=span.get("deployment.environment"),
        detail=F.when(category == "http", http_detail).when(category == "database", db_detail)
        .when(category == "rpc", rpc_detail).when(category == "messaging", msg_detail)
        .when(category == "faas", faas_detail),
    )


def rule_enricher(rules: list[dict]) -> Enricher:
    """User rules ``{"match": {"attributes", "span_name"}, "hints"}``, first match wins.

    A rule without conditions never matches.  A match whose category is empty
    ends the list, and the chain goes on to the next enricher.  A few rules
    become a CASE; a CASE of thousands would outgrow the plan, so more than
    ``RULES_INLINE`` are found through an index, with the same result.
    """

    def inline(span: Span) -> tuple[Column, Fields]:
        cases: list[tuple[Column, dict]] = []
        for rule in rules:
            tests = [
                F.coalesce(glob(span.name if key == NAME else span.raw(key), pattern), F.lit(False))
                for key, pattern in conditions(rule)
            ]
            if tests:
                cases.append((all_of(tests), given(rule)))
        if not cases:
            return F.lit(False), {}
        found = {n: first_case([(c, F.lit(v[n])) for c, v in cases], F.lit(_DEFAULT[FIELDS[n]])) for n in GIVES}
        return found["category"] != "", found

    def indexed(span: Span) -> tuple[Column, Fields]:
        rule = span.once(matched(span.name, F.col("attrs"), rules))
        return F.coalesce(rule["category"] != "", F.lit(False)), {n: rule[n] for n in GIVES}

    return inline if len(rules) <= RULES_INLINE else indexed


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules of a JSON file ``{"enrichers": [...]}`` (a small configuration file)."""
    text = "\n".join(row[0] for row in spark.read.text(path, wholetext=True).collect())
    return json.loads(text).get("enrichers") or []


def chain(ci: bool = True, rules: list[dict] | None = None, extra: list[Enricher] | None = None,
          statement_bytes: int | None = STATEMENT_BYTES) -> list[Enricher]:
    """Enrichers in order: CI (for CI inputs), CI/CD, user rules, extras, generic."""
    out: list[Enricher] = [ci_enricher] if ci else []
    out.append(cicd_enricher)
    if rules:
        out.append(rule_enricher(rules))
    return out + list(extra or []) + [partial(generic_enricher, statement_bytes=statement_bytes)]


def looked_up(enrichers: list[Enricher] | None = None) -> list[str]:
    """Attributes that enrichers look at."""
    span = Span(F.col("name"), F.col("_zero"), F.col("kind"))
    for e in enrichers or chain():
        e(span)
    return list(span.keys)


def enrich(spans: DataFrame, enrichers: list[Enricher] | None = None) -> DataFrame:
    """Add ``hints`` by the first enricher that matches, then fill in resource context."""
    span = Span(F.col("name"), F.col("_zero"), F.col("kind"))
    found = [e(span) for e in (enrichers or chain())]
    flat = {name: attribute(spans, key) for key, name in span.keys.items()}
    flat |= {f"_value_{i}": v for i, v in enumerate(span.values)}
    flat["_zero"] = F.col("end_ns") <= F.col("start_ns")
    flat["_status"] = F.when(F.col("status_code") != "UNSET", F.col("status_code"))
    flat["_service"] = F.coalesce(F.col("resource")["service.name"], F.lit(""))
    flat["_place"] = F.coalesce(F.col("resource")["deployment.environment"], F.lit(""))
    rows = spans.withColumns(flat)
    which = {f"_is_{i}": matches for i, (matches, _) in enumerate(found)}
    tested = rows.withColumns(which)
    context = {"service_name": "_service", "environment": "_place"}
    cols = []
    for name, kind in FIELDS.items():
        zero = F.lit(_DEFAULT[kind]).cast(kind)
        cases = [(F.col(f"_is_{i}"), f.get(name, zero).cast(kind)) for i, (_, f) in enumerate(found)]
        value = F.coalesce(first_case(cases, zero), zero)
        if name in context:
            value = F.coalesce(F.nullif(value, F.lit("")), F.col(context[name]))
        cols.append(value.alias(name))
    return tested.withColumn("hints", F.struct(*cols)).drop(*flat, *which)
