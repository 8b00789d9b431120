"""Projection of the driver's star-schema tables onto runs, jobs, steps, spans and logs.

Used by the registered queries, the bench and the tests.  Orders stand in for
runs, line items for jobs, events for generic spans and log lines.  Only the lazy plans
are remembered between calls, never data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import configure


@lru_cache(maxsize=64)
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; zone-less timestamps become UTC instants."""
    configure(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def _ms(ms):
    return F.timestamp_millis(ms)


@lru_cache(maxsize=64)
def sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source per nation: pull request, commit or single run in turn."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    key = F.col("n_nationkey")
    kind = F.when(key % 3 == 0, "pr").when(key % 3 == 1, "commit").otherwise("run")
    base = F.lit(1704067200000)  # 2024-01-01
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.alias("source_id"),
        F.lower("r_name").alias("owner"),
        F.lower("n_name").alias("repo"),
        kind.alias("type"),
        key.cast("string").alias("identifier"),
        F.md5(key.cast("string")).alias("head_sha"),
        F.lit("main").alias("branch"),
        F.concat(F.lit("source "), key.cast("string")).alias("display_name"),
        F.concat(
            F.lit("https://github.com/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"),
            F.when(key % 3 == 0, "/pull/").when(key % 3 == 1, "/commit/").otherwise("/actions/runs/"),
            key.cast("string"),
        ).alias("display_url"),
        F.when(key % 3 == 0, _ms(base + key.cast("bigint") * 86400000)).alias("merged_at"),
        F.when(key % 3 == 1, _ms(base + key.cast("bigint") * 3600000)).alias("commit_time"),
        F.when(key % 3 == 1, _ms(base + key.cast("bigint") * 3600000 + 60000)).alias("pushed_at"),
        (key % 4).cast("int").alias("changed_files"),
        (key * 10).cast("int").alias("additions"),
        (key * 3).cast("int").alias("deletions"),
    )


@lru_cache(maxsize=64)
def runs(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    where = sources(spark, folder).select("source_id", "owner", "repo")
    key = F.col("o_orderkey")
    created = F.unix_millis("o_orderdate")
    open_ = F.col("o_orderstatus") == "P"
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(where, F.col("c_nationkey") == F.col("source_id"))
        .select(
            "source_id",
            key.alias("run_id"),
            F.when(key % 10 == 0, 2).otherwise(1).cast("bigint").alias("run_attempt"),
            F.col("o_orderpriority").alias("name"),
            F.concat(F.lit(".github/workflows/"), F.lower("o_orderpriority"), F.lit(".yml")).alias("path"),
            F.when(open_, "in_progress").otherwise("completed").alias("status"),
            F.when(F.col("o_orderstatus") == "O", "success")
            .when(F.col("o_orderstatus") == "F", "failure").alias("conclusion"),
            _ms(created).alias("created_at"),
            _ms(created + (key % 60) * 1000).alias("run_started_at"),
            _ms(created + F.floor("o_totalprice").cast("bigint")).alias("updated_at"),
            F.md5(key.cast("string")).alias("head_sha"),
            F.col("c_mktsegment").alias("head_branch"),
            F.when(key % 3 == 0, "pull_request").otherwise("push").alias("event"),
            "owner",
            "repo",
        )
    )


@lru_cache(maxsize=64)
def jobs(spark: SparkSession, folder: str) -> DataFrame:
    run_rows = runs(spark, folder)
    item = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    run = run_rows.select(
        "run_id", "source_id", "owner", "repo",
        F.col("run_attempt").alias("_attempt"),
        F.col("status").alias("_status"),
        F.unix_millis("created_at").alias("_created"),
    )
    order = Window.partitionBy("l_orderkey").orderBy(*[c for c in item.columns if c != "l_orderkey"])
    started = F.col("_created") + F.col("l_linenumber") * 1000
    pending = (F.col("_status") == "in_progress") & (F.col("_seq") == 1)
    failed = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 35)
    job_id = F.col("run_id") * 1000 + F.col("_seq")
    return (
        item.withColumn("_seq", F.row_number().over(order))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(run, F.col("l_orderkey") == F.col("run_id"))
        .select(
            "source_id", "run_id", job_id.alias("job_id"),
            F.when((F.col("_attempt") == 2) & (F.col("_seq") % 2 == 0), 1)
            .otherwise(F.col("_attempt")).cast("bigint").alias("run_attempt"),
            F.concat("p_brand", F.lit(" / "), "p_type").alias("name"),
            F.when(pending, "in_progress").otherwise("completed").alias("status"),
            F.when(pending, None).when(failed, "failure")
            .when(F.col("_seq") == 6, "skipped").otherwise("success").alias("conclusion"),
            _ms(F.col("_created")).alias("created_at"),
            _ms(started).alias("started_at"),
            F.when(~pending, _ms(started + F.col("l_quantity").cast("bigint") * 1000)).alias("completed_at"),
            F.col("s_name").alias("runner_name"),
            F.when(F.col("_seq") % 5 == 0, "").otherwise(
                F.concat(
                    F.lit("https://github.com/"), "owner", F.lit("/"), "repo", F.lit("/actions/runs/"),
                    F.col("run_id").cast("string"), F.lit("/job/"), job_id.cast("string"),
                )
            ).alias("html_url"),
            F.col("l_quantity").cast("bigint").alias("_seconds"),
        )
    )


# The three steps of every projected job.
STEP_NAMES = ["Checkout", "Build", "Run tests"]


@lru_cache(maxsize=64)
def steps(spark: SparkSession, folder: str) -> DataFrame:
    return steps_of(jobs(spark, folder))


def steps_of(job_rows: DataFrame) -> DataFrame:
    """Three equal steps per job; the last one carries the job's conclusion."""
    kept = ["source_id", "run_id", "job_id", "run_attempt"]
    return job_rows.select(*kept, "html_url", F.explode(step_array()).alias("s")).select(*kept, "s.*", "html_url")


def step_array() -> Column:
    """The steps of a job row as an array."""
    third = F.floor(F.col("_seconds") * 1000 / 3).cast("bigint")
    begin = F.unix_millis("started_at")
    steps = []
    for number, name in enumerate(STEP_NAMES, 1):
        last = number == len(STEP_NAMES)
        end = _ms(begin + number * third)
        steps.append(F.struct(
            F.lit(number).alias("number"), F.lit(name).alias("name"),
            (F.col("status") if last else F.lit("completed")).alias("status"),
            (F.col("conclusion") if last else F.lit("success")).alias("conclusion"),
            _ms(begin + (number - 1) * third).alias("started_at"),
            (F.when(F.col("status") == "completed", end) if last else end).alias("completed_at"),
        ))
    return F.array(*steps)


@lru_cache(maxsize=64)
def clean_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return jobs(spark, folder).drop("_seconds")


@lru_cache(maxsize=64)
def review_events(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-ups become reviews, clicks comments, purchases merges."""
    events = table(spark, folder, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "review")
        .when(F.col("event_type") == "click", "comment")
        .when(F.col("event_type") == "purchase", "merged")
    )
    merged = F.col("type") == "merged"
    return (
        events.withColumn("type", kind)
        .where(F.col("type").isNotNull())
        .select(
            (F.col("user_id") % 25).cast("int").alias("source_id"),
            "type",
            F.when(F.col("type") == "review", F.when(F.col("value") > 25, "APPROVED").otherwise("COMMENTED")).alias("state"),
            F.timestamp_millis(F.unix_millis("ts")).alias("time"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
            F.concat(F.lit("https://github.com/o/r/pull/"), F.col("event_id").cast("string")).alias("url"),
            F.when(merged, F.col("event_id")).alias("pr_number"),
            F.when(merged, F.concat(F.lit("change "), F.col("event_id").cast("string"))).alias("pr_title"),
        )
    )


# Which attributes an event type brings.
EVENT_ATTRS = {
    "view": {"http.request.method": "GET", "http.route": "/view"},
    "click": {"rpc.system": "grpc", "rpc.service": "ui", "rpc.method": "Click"},
    "purchase": {"db.system": "postgresql", "db.operation": "INSERT"},
    "signup": {"messaging.system": "kafka", "messaging.destination.name": "signups"},
    "error": {},
}


@lru_cache(maxsize=64)
def generic_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Events as spans: a user is a trace."""
    from spanloom.functions import codes, ids
    from spanloom.schemas import conform_spans

    events = table(spark, folder, "events")
    key = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    extra = []
    for kind, attrs in EVENT_ATTRS.items():
        for name, value in attrs.items():
            extra.append(codes.entry(name, F.when(key == kind, F.lit(value))))
    entries = [
        *extra,
        codes.entry("http.response.status_code", F.when(key == "view", (F.lit(200) + (F.col("event_id") % 4) * 100)), "INT64"),
        codes.entry("k", k, "INT64"),
    ]
    start = F.unix_micros("ts") * 1000
    rows = events.select(
        (F.col("user_id") % 25).cast("int").alias("source_id"),
        F.md5(F.col("user_id").cast("string")).alias("trace_id"),
        ids.span_id_int(F.col("event_id") + 1).alias("span_id"),
        F.concat(key, F.lit(" "), F.col("event_id").cast("string")).alias("name"),
        F.when(key == "view", "SERVER").when(key == "click", "CLIENT").otherwise("INTERNAL").alias("kind"),
        start.alias("start_ns"),
        (start + F.floor("value").cast("bigint") * 1000000).alias("end_ns"),
        codes.attr_map(entries).alias("attrs"),
        codes.type_map(entries).alias("attr_types"),
        F.when(key == "error", "ERROR").otherwise("UNSET").alias("status_code"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))).alias("resource"),
        F.col("event_id").alias("seq"),
        "user_id",
    )
    # The first event of a user in each block of 1000 event ids is the parent of
    # that user's other events in the block.
    first = events.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("_block")).agg(
        F.min("event_id").alias("_head")
    )
    rows = rows.withColumn("_block", F.floor(F.col("seq") / 1000)).join(first, ["user_id", "_block"])
    parent = F.when(F.col("_head") != F.col("seq"), ids.span_id_int(F.col("_head") + 1))
    return conform_spans(rows.withColumn("parent_span_id", parent))


@lru_cache(maxsize=64)
def timing(spark: SparkSession, folder: str) -> DataFrame:
    """Billable rows: every run on UBUNTU, every seventh on MACOS as well."""
    took = (F.unix_millis("updated_at") - F.unix_millis("created_at")).alias("took")
    rows = runs(spark, folder).select("run_id", took)
    return rows.select("run_id", F.lit("UBUNTU").alias("os"), F.col("took").alias("total_ms")).unionByName(
        rows.where(F.col("run_id") % 7 == 0).select(
            "run_id", F.lit("MACOS").alias("os"), F.floor(F.col("took") / 10).cast("bigint").alias("total_ms")
        )
    )


@lru_cache(maxsize=64)
def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """One artifact per job shorter than 20 s; those over 15 s have expired."""
    return jobs(spark, folder).where(F.col("_seconds") < 20).select(
        "run_id",
        F.col("job_id").alias("artifact_id"),
        F.concat(
            F.when(F.col("_seconds") % 2 == 0, "gha-trace-").otherwise("logs-"), F.col("job_id").cast("string")
        ).alias("name"),
        (F.col("_seconds") * 1000).alias("size_in_bytes"),
        F.concat(F.lit("https://example.com/zip/"), F.col("job_id").cast("string")).alias("archive_download_url"),
        (F.col("_seconds") > 15).alias("expired"),
    )


@lru_cache(maxsize=64)
def contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Required checks per source: one brand, and on every fifth source one priority."""
    key = F.col("source_id")
    brand = F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string"))
    return sources(spark, folder).select(
        "source_id",
        F.when(key % 2 == 0, F.array(brand)).alias("contexts"),
        F.when(key % 5 == 0, F.array(F.lit("1-URGENT"), brand)).alias("checks"),
    )


@lru_cache(maxsize=64)
def check_runs(spark: SparkSession, folder: str) -> DataFrame:
    head = runs(spark, folder).select("run_id", "head_sha")
    return jobs(spark, folder).join(head, "run_id").select(
        F.col("job_id").alias("check_run_id"), "head_sha", "name", "status", "conclusion"
    )


@lru_cache(maxsize=64)
def annotations(spark: SparkSession, folder: str) -> DataFrame:
    return jobs(spark, folder).select(
        F.col("job_id").alias("check_run_id"),
        F.concat(F.lit("src/"), F.col("runner_name")).alias("path"),
        F.col("_seconds").cast("int").alias("start_line"),
        F.lit("failure").alias("annotation_level"),
        F.concat(F.lit("failed "), F.col("job_id").cast("string")).alias("message"),
        F.when(F.col("_seconds") % 2 == 0, "").otherwise(F.concat(F.lit("title "), F.col("job_id").cast("string"))).alias("title"),
    )


HOUR_TICKS = 3600 * 10_000_000


@lru_cache(maxsize=64)
def raw_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw log lines: a user is a job, event order is file order.

    A quarter of the jobs each speak Gradle, Bazel, set-up and plain log.  Some
    lines are too short for a timestamp.
    """
    e = table(spark, folder, "events")
    key = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    kind = F.col("user_id") % 4

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    gradle = F.when(key == "view", say("> Task :app:t", k, " UP-TO-DATE")).when(
        key == "click", say("> Task :lib:t", k)).otherwise(say("note ", k))
    bazel = (
        F.when(key == "view", say("[", k, " / 100] Compiling f", (F.col("event_id") % 2).cast("string")))
        .when(key == "click", say("[", k, " / 100] ", k, " / 9 tests; no actions running"))
        .when(key == "signup", say("Loading: ", k)).otherwise(say("note ", k))
    )
    setup = (
        F.when(key == "view", "Getting action download info").when(key == "click", say("Download action repository ", k))
        .when(key == "signup", "Prepare workflow directory").otherwise(say("note ", k))
    )
    plain = (
        F.when(key == "error", say("##[group]Run ", k)).when(key == "purchase", "##[endgroup]")
        .when(key == "view", say("\x1b[32mCompiling unit", k, "\x1b[0m")).when(key == "click", "......").otherwise(say("Downloading pkg", k))
    )
    content = F.when(kind == 0, gradle).when(kind == 1, bazel).when(kind == 2, setup).otherwise(plain)
    micros = F.unix_micros("ts")
    stamp = F.concat(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    short = F.col("event_id") % 211 == 0
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"),
        F.when(short, "short").otherwise(F.concat(stamp, F.lit(" "), content)).alias("line"),
    )


@lru_cache(maxsize=64)
def log_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Two steps per job with a gap between them: days 2 to 14 and 16 to 28."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("job_id")).distinct()
    base, day = 1704067200000, 86400000
    number = F.col("number")
    return users.withColumn("number", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "job_id", "number", F.when(number == 1, "Build").otherwise("Run tests").alias("name"),
        _ms(F.lit(base) + F.when(number == 1, 1 * day).otherwise(15 * day)).alias("started_at"),
        _ms(F.lit(base) + F.when(number == 1, 13 * day).otherwise(27 * day)).alias("completed_at"),
    )


@lru_cache(maxsize=64)
def log_jobs(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").select(F.col("user_id").alias("job_id")).distinct()
    return users.select(
        "job_id", (F.col("job_id") % 25).cast("int").alias("source_id"), F.col("job_id").alias("run_id"),
        F.lit(1).cast("bigint").alias("attempt"),
        F.concat(F.lit("https://github.com/o/r/actions/runs/1/job/"), F.col("job_id").cast("string")).alias("html_url"),
    )
