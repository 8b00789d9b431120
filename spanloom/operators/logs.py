"""Job logs to sub-step spans.

Lines keep their place as a whole number, so order-dependent work runs on slices
of 65,536 places: a step that holds a third of all lines is spread like any
other.  Times are whole 100 ns ticks, the precision of the log format.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import ids, text
from spanloom.operators.ci_spans import step_span_id
from spanloom.operators.intervals import islands
from spanloom.operators.ordered import sliced_window
from spanloom.schemas import conform_spans
from spanloom.session import cut

TICK_NS = 100
SECOND = 10_000_000
SLICE_LINES = 65_536
STAMP = 28
NAME_BYTES = 80
STEP = ["job_id", "number"]

# Line patterns of the build tools.
GRADLE_TASK = r"^> Task (:\S+)(.*)$"
BAZEL_ACTION = r"^\[(\d+)\s*/\s*(\d+)\]\s+(.+)$"
BAZEL_ANALYZED = r"^INFO: Analyzed (?:target )?(.+)$"
BAZEL_PHASE = r"^(Extracting Bazel|Starting local Bazel|Computing main repo|Loading|Analyzing)"
BAZEL_WAITING = r"^\d+\s*/\s*\d+\s+tests;\s+(.+)$"
# Set-up phases by the text that marks them, first match wins.
SETUP_PHASES = [
    ("Current runner version:", "Runner setup"),
    ("Getting action download info", "Resolve actions"),
    ("Download action repository", "Download actions"),
    ("Complete job name:", "Prepare job"),
    ("Prepare workflow directory", "Prepare workspace"),
    ("Prepare all required actions", "Prepare actions"),
    ("Getting action download URL", "Download actions"),
]

SPANS = [
    *STEP, "parser", "depth", "key", "parent_key", "place", "name", "start_t", "end_t", "attrs",
]


def ticks(stamp: Column) -> Column:
    """100 ns ticks of a 28 character timestamp, null if malformed."""
    good = stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{7}Z$")
    whole = F.unix_micros(F.try_to_timestamp(F.concat(F.substring(stamp, 1, 19), F.lit("Z")))) * 10
    return F.when(good, whole + F.substring(stamp, 21, 7).cast("bigint"))


def assign_steps(lines: DataFrame, steps: DataFrame) -> DataFrame:
    """Step of every raw line (job_id, pos, line); lines without a good time drop out.

    A line belongs to the containing step that starts closest before it, else to
    the last step begun before it, else to the nearest start.  Lines too short
    for a time go to the last step.  The steps of a job travel as one short array,
    so a line never multiplies.
    """
    timed = steps.where(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull())
    plan = timed.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "number", (F.unix_micros("started_at") * 10).alias("s"), (F.unix_micros("completed_at") * 10).alias("e")
        ))).alias("_steps")
    )
    short = F.length("line") < STAMP
    rows = lines.join(plan, "job_id").withColumn("t", ticks(F.substring("line", 1, STAMP)))
    t = F.col("t")
    inside = F.filter("_steps", lambda s: (t >= s["s"]) & (t <= s["e"]))
    containing = F.array_min(F.transform(inside, lambda s, i: F.struct((t - s["s"]).alias("d"), i.alias("i"), s["number"].alias("n"))))["n"]
    begun = F.element_at(F.filter("_steps", lambda s: s["s"] <= t), -1)["number"]
    nearest = F.array_min(F.transform("_steps", lambda s, i: F.struct(F.abs(t - s["s"]).alias("d"), i.alias("i"), s["number"].alias("n"))))["n"]
    last = F.element_at("_steps", -1)["number"]
    begun = F.when(F.exists("_steps", lambda s: s["s"] <= t), begun)
    number = F.when(short, last).when(t.isNotNull(), F.coalesce(containing, begun, nearest))
    return rows.withColumn("number", number).where(F.col("number").isNotNull()).drop("_steps")


def parse_lines(assigned: DataFrame) -> DataFrame:
    """Numbered log lines of each step; short lines count but are not kept."""
    placed = assigned.withColumn("_slice", F.floor(F.col("pos") / SLICE_LINES))
    numbered = sliced_window(placed, STEP, "_slice", ["pos"], sums={"line_num": F.lit(1)})
    return numbered.where((F.length("line") > STAMP) & F.col("t").isNotNull()).select(
        *STEP, F.col("line_num").cast("int").alias("line_num"), "t",
        text.strip_ansi(F.expr(f"substring(line, {STAMP + 2})")).alias("content"),
    )


def _sliced(rows: DataFrame, at: str = "line_num") -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col(at) / SLICE_LINES))


def _next_start(rows: DataFrame, keys: list[str], end: Column) -> DataFrame:
    """Each entry ends where the next one of its key begins; the last at ``end``."""
    out = sliced_window(_sliced(rows), keys, "_slice", ["line_num"], leads={"_next": F.col("t")})
    return out.withColumn("end_t", F.coalesce("_next", end)).drop("_next", "_slice")


def _attrs(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[c for k, v in pairs for c in (F.lit(k), v.cast("string"))])


def _top(rows: DataFrame, parser: str, name: Column, attrs: Column) -> DataFrame:
    """Entries as spans right under the step."""
    return rows.select(
        *STEP, F.lit(parser).alias("parser"), F.lit(0).alias("depth"),
        F.concat_ws("-", F.lit("l"), F.col("line_num").cast("string")).alias("key"),
        F.lit("").alias("parent_key"), F.col("line_num").cast("bigint").alias("place"),
        name.alias("name"), F.col("t").alias("start_t"), "end_t", attrs.alias("attrs"),
    )


def gradle_spans(lines: DataFrame) -> DataFrame:
    """One span per task line, up to the next task."""
    content = F.col("content")
    tasks = lines.where(content.rlike(GRADLE_TASK)).withColumns({
        "task": F.regexp_extract(content, GRADLE_TASK, 1),
        "outcome": F.coalesce(F.nullif(text.trim_space(F.regexp_extract(content, GRADLE_TASK, 2)), F.lit("")), F.lit("SUCCESS")),
    })
    return _top(
        _next_start(tasks, STEP, F.col("step_end")), "gradle", F.col("task"),
        _attrs(("gradle.task.name", F.col("task")), ("gradle.task.outcome", F.col("outcome")), ("log.line_number", F.col("line_num"))),
    )


def bazel_spans(lines: DataFrame, name_bytes: int | None = NAME_BYTES) -> DataFrame:
    """Actions, and phases before the first action; equal neighbours merge.

    Names are cut to ``name_bytes``; None keeps them whole.
    """
    content = F.col("content")
    action = content.rlike(BAZEL_ACTION)
    first = lines.where(action).groupBy(*STEP).agg(F.min("line_num").alias("_first"))
    rows = lines.where(action | content.rlike(BAZEL_PHASE)).join(first, STEP, "left")
    rows = rows.where(action | F.col("_first").isNull() | (F.col("line_num") < F.col("_first")))
    described = F.regexp_extract(content, BAZEL_ACTION, 3)
    waiting = F.regexp_extract(described, BAZEL_WAITING, 1)
    colon = F.locate(":", content)
    phase = F.when((colon > 1) & (colon <= 40), text.trim_space(F.split_part(content, F.lit(":"), F.lit(1)))).otherwise(content)
    label = F.when(action, described).otherwise(phase)
    key = F.when(action & (waiting != ""), F.concat(F.lit("waiting ("), waiting, F.lit(")"))).otherwise(label)
    rows = _sliced(rows.withColumns({"label": text.truncate(label, name_bytes), "merge_key": key}))
    runs = islands(rows, STEP, "_slice", ["line_num"], F.col("merge_key"), "_run")
    merged = runs.groupBy(*STEP, "_run").agg(
        F.min_by("label", "line_num").alias("label"), F.first("merge_key").alias("merge_key"),
        F.min_by("t", "line_num").alias("t"), F.min("line_num").alias("line_num"),
        F.count(F.lit(1)).alias("count"), F.first("step_start").alias("step_start"), F.first("step_end").alias("step_end"),
    )
    merged = cut(merged)
    ended = _next_start(merged, STEP, F.col("step_end"))
    name = F.when(F.col("count") > 1, F.concat("label", F.lit(" (×"), F.col("count").cast("string"), F.lit(")"))).otherwise(F.col("label"))
    spans = _top(ended, "bazel", name, _attrs(
        ("bazel.action.description", F.col("merge_key")), ("log.line_number", F.col("line_num"))
    ))
    begin = merged.where((F.col("_run") == 1) & (F.col("t") - F.col("step_start") > SECOND)).select(
        *STEP, F.lit(0).alias("line_num"), F.col("step_start").alias("t"), F.col("t").alias("end_t")
    )
    return spans.unionByName(_top(begin, "bazel", F.lit("Starting"), _attrs(
        ("log.line_number", F.lit(1)), ("bazel.action.description", F.lit("Bazel startup and initialization"))
    )))


def setup_spans(lines: DataFrame) -> DataFrame:
    """Set-up phases; a repeat of the phase before it is dropped."""
    phase = text.first_case(
        [(F.col("content").contains(mark), F.lit(name)) for mark, name in SETUP_PHASES], F.lit(None).cast("string")
    )
    marks = _sliced(lines.withColumn("phase", phase).where(F.col("phase").isNotNull()))
    seen = sliced_window(marks, STEP, "_slice", ["line_num"], lags={"_before": F.col("phase")})
    kept = seen.where(~F.col("_before").eqNullSafe(F.col("phase"))).drop("_before", "_slice")
    return _top(
        _next_start(kept, STEP, F.col("step_end")), "setup-job", F.col("phase"),
        _attrs(("gha.setup.phase", F.col("phase")), ("log.line_number", F.col("line_num"))),
    )


@dataclass(frozen=True)
class Gaps:
    """Thresholds of the generic parser in 100 ns ticks, and the bytes its names are cut to (None: whole)."""

    gap: int = SECOND
    shortest: int = SECOND // 10
    noise: int = 2 * SECOND
    name_bytes: int | None = NAME_BYTES


REGION = [*STEP, "region"]


def gap_groups(lines: DataFrame, gaps: Gaps) -> DataFrame:
    """Lines of a region cut where the gap to the line before reaches the limit.

    A region in one piece gives nothing; pieces that are too short or have no
    telling line drop out.  A piece ends where the next one begins.
    """
    rows = sliced_window(_sliced(lines), REGION, "_slice", ["line_num"], lags={"_before": F.col("t")})
    cut_here = F.when(F.coalesce(F.col("t") - F.col("_before") >= gaps.gap, F.lit(True)), 1).otherwise(0)
    rows = sliced_window(rows.withColumn("_cut", cut_here), REGION, "_slice", ["line_num"], sums={"piece": F.col("_cut")})
    clean = text.trim_space(F.col("content"))
    telling = ~text.is_boilerplate(clean)
    pieces = rows.groupBy(*REGION, "piece").agg(
        F.min_by("t", "line_num").alias("t"), F.min("line_num").alias("line_num"),
        F.count(F.lit(1)).alias("line_count"),
        F.min_by(F.when(telling, text.truncate(clean, gaps.name_bytes)), F.when(telling, F.col("line_num"))).alias("name"),
        F.first("region_end").alias("region_end"),
    )
    pieces = cut(pieces)
    many = pieces.groupBy(*REGION).agg(F.max("piece").alias("_pieces"))
    pieces = _next_start(pieces.join(many, REGION).where(F.col("_pieces") > 1), REGION, F.col("region_end"))
    return pieces.where(
        (F.col("end_t") - F.col("t") >= gaps.shortest) & F.col("name").isNotNull() & ~F.col("name").startswith("log group")
    ).drop("_pieces", "region_end")


def _ms(start: Column, end: Column) -> Column:
    return F.floor((end - start) / 10000)


def collapse(pieces: DataFrame, gaps: Gaps) -> DataFrame:
    """Equal or telling-nothing neighbours become one piece with a count."""
    noise = text.is_noise_name(F.col("name"))
    key = F.when(noise, F.lit("\u0000")).otherwise(F.col("name"))
    runs = islands(_sliced(pieces), REGION, "_slice", ["line_num"], key, "_run")
    merged = runs.groupBy(*REGION, "_run").agg(
        F.min_by("name", "line_num").alias("name"), F.min_by("t", "line_num").alias("t"),
        F.max_by("end_t", "line_num").alias("end_t"), F.min("line_num").alias("line_num"),
        F.sum("line_count").alias("line_count"), F.count(F.lit(1)).alias("count"),
    )
    noisy = text.is_noise_name(F.col("name"))
    took = F.col("end_t") - F.col("t")
    shown = text.format_duration_ms(_ms(F.col("t"), F.col("end_t")))
    many = F.col("count") > 1
    name = (
        F.when(many, F.concat("name", F.lit(" (x"), F.col("count").cast("string"), F.lit(", "), shown, F.lit(")")))
        .when(noisy, F.concat(F.lit("("), F.col("name"), F.lit(")")))
        .otherwise(F.col("name"))
    )
    return merged.where(many | ~noisy | (took >= gaps.noise)).withColumns({
        "name": name, "collapsed": F.when(many, F.col("count"))
    }).drop("_run", "count")


def prefix_runs(pieces: DataFrame) -> DataFrame:
    """Three or more neighbours with the same first word go under a parent of that name.

    Gives every piece ``run`` (place of its run), ``run_size`` and its leading ``word``.
    """
    word = text.leading_word(F.col("name"))
    runs = cut(islands(_sliced(pieces.withColumn("word", word)), REGION, "_slice", ["line_num"], F.col("word"), "run"))
    size = runs.groupBy(*REGION, "run").agg(
        F.count(F.lit(1)).alias("run_size"), F.min("t").alias("run_start"), F.max_by("end_t", "line_num").alias("run_end"),
        F.min("line_num").alias("run_line"),
    )
    joined = runs.join(size, [*REGION, "run"]).drop("_slice")
    return joined.withColumn("in_run", (F.col("word") != "") & (F.col("run_size") >= 3))


def _piece_spans(pieces: DataFrame, depth: Column, parent: Column, line: Column) -> DataFrame:
    """Pieces and their prefix parents as spans below ``parent``."""
    rows = cut(prefix_runs(pieces))
    head = F.concat_ws("-", F.lit("p"), F.col("run_line").cast("string"))
    suffix = text.trim_space(F.expr("substring(name, length(word) + 1)"))
    inside = F.col("in_run")
    attrs = F.map_filter(
        _attrs(("log.line_count", F.col("line_count")), ("log.line_number", line), ("log.collapsed", F.col("collapsed"))),
        lambda _, v: v.isNotNull(),
    )
    own = rows.select(
        *STEP, F.lit("timestamp").alias("parser"),
        F.when(inside, depth + 1).otherwise(depth).alias("depth"),
        F.concat_ws("-", F.lit("l"), F.col("line_num").cast("string")).alias("key"),
        F.when(inside, head).otherwise(parent).alias("parent_key"),
        (F.col("line_num") * 2 + 1).cast("bigint").alias("place"),
        F.when(inside, F.coalesce(F.nullif(suffix, F.lit("")), F.col("name"))).otherwise(F.col("name")).alias("name"),
        F.col("t").alias("start_t"), "end_t", attrs.alias("attrs"),
    )
    shown = text.format_duration_ms(_ms(F.col("run_start"), F.col("run_end")))
    parents = rows.where(inside & (F.col("line_num") == F.col("run_line"))).select(
        *STEP, F.lit("timestamp").alias("parser"), depth.alias("depth"), head.alias("key"),
        parent.alias("parent_key"), (F.col("line_num") * 2 + 1).cast("bigint").alias("place"),
        F.concat("word", F.lit(" (x"), F.col("run_size").cast("string"), F.lit(", "), shown, F.lit(")")).alias("name"),
        F.col("run_start").alias("start_t"), F.col("run_end").alias("end_t"),
        _attrs(("log.line_number", line), ("log.collapsed", F.col("run_size"))).alias("attrs"),
    )
    return own.unionByName(parents)


def mark_regions(lines: DataFrame) -> DataFrame:
    """``region`` of every line: 0 outside groups, else the group's number; null if lost.

    A group that another group opens before its end is lost with its lines.
    """
    content = F.col("content")
    mark = F.when(content.startswith("##[group]"), "group").when(content.startswith("##[endgroup]"), "end")
    rows = cut(_sliced(lines.withColumn("mark", mark)))
    marks = sliced_window(
        rows.where(F.col("mark").isNotNull()), STEP, "_slice", ["line_num"], leads={"_next": F.col("mark")}
    )
    lost = marks.where((F.col("mark") == "group") & (F.col("_next") == "group")).select(
        *STEP, F.col("line_num").alias("group_line"), F.lit(True).alias("_lost")
    )
    opened = F.when(F.col("mark") == "group", F.col("line_num")).when(F.col("mark") == "end", F.lit(0))
    seen = sliced_window(rows, STEP, "_slice", ["line_num"], lasts={"group_line": opened})
    seen = seen.withColumn("group_line", F.coalesce("group_line", F.lit(0))).drop("_slice")
    return seen.join(lost, [*STEP, "group_line"], "left").withColumn(
        "region", F.when(F.col("_lost").isNull(), F.col("group_line"))
    ).drop("_lost", "group_line")


def timestamp_spans(lines: DataFrame, gaps: Gaps | None = None) -> DataFrame:
    """Groups as parents and gap pieces inside and between them."""
    gaps = gaps or Gaps()
    marked = cut(mark_regions(lines).where(F.col("region").isNotNull()))
    groups = marked.where(F.col("mark") == "group").drop("mark")
    groups = _next_start(groups, STEP, F.col("step_end"))
    label = F.expr("substring(content, length('##[group]') + 1)")
    heads = groups.select(
        *STEP, F.lit("timestamp").alias("parser"), F.lit(0).alias("depth"),
        F.concat_ws("-", F.lit("g"), F.col("line_num").cast("string")).alias("key"), F.lit("").alias("parent_key"),
        (F.col("line_num") * 2).cast("bigint").alias("place"), text.truncate(label, gaps.name_bytes).alias("name"),
        F.col("t").alias("start_t"), "end_t",
        _attrs(("log.line_number", F.col("line_num")), ("log.group", label)).alias("attrs"),
    )
    ends = groups.select(*STEP, F.col("line_num").alias("region"), F.col("end_t").alias("group_end"))
    plain = marked.where(F.col("mark").isNull()).drop("mark").join(ends, REGION, "left")
    plain = plain.withColumn("region_end", F.coalesce("group_end", "step_end"))
    pieces = collapse(gap_groups(plain, gaps), gaps)
    inside = F.col("region") > 0
    group_key = F.concat_ws("-", F.lit("g"), F.col("region").cast("string"))
    spans = _piece_spans(
        pieces, F.when(inside, 1).otherwise(0), F.when(inside, group_key).otherwise(F.lit("")),
        F.when(inside, F.col("region")).otherwise(F.col("line_num")),
    )
    return heads.unionByName(spans)


@dataclass(frozen=True)
class Parser:
    """A log format: a test on ``content`` and the spans of the matching steps' lines."""

    name: str
    match: Callable[[], Column]
    spans: Callable[[DataFrame], DataFrame]


def default_parsers(name_bytes: int | None = NAME_BYTES) -> list[Parser]:
    """The built-in formats; Bazel's names are cut to ``name_bytes`` (None: whole)."""
    content = F.col("content")
    return [
        Parser("gradle", lambda: content.rlike(GRADLE_TASK) | content.contains("BUILD SUCCESSFUL") | content.contains("BUILD FAILED"), gradle_spans),
        Parser("bazel", lambda: content.rlike(BAZEL_ACTION) | content.rlike(BAZEL_ANALYZED), partial(bazel_spans, name_bytes=name_bytes)),
        Parser("setup-job", lambda: content.contains("Getting action download info") | content.contains("Prepare workflow directory"), setup_spans),
    ]


def detect_formats(lines: DataFrame, parsers: list[Parser] | None = None) -> DataFrame:
    """Format of every step: the first parser with a matching line, else timestamp."""
    parsers = default_parsers() if parsers is None else parsers
    flags = [F.bool_or(p.match()).alias(f"_{i}") for i, p in enumerate(parsers)]
    found = lines.groupBy(*STEP).agg(F.lit(True).alias("_any"), *flags)
    name = text.first_case([(F.col(f"_{i}"), F.lit(p.name)) for i, p in enumerate(parsers)], F.lit("timestamp"))
    return found.select(*STEP, name.alias("format"))


def significant(spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """Spans of at least a hundredth of their parent; children go with their parent."""
    rows = spans.join(bounds, STEP)
    kept: list[DataFrame] = []
    above: DataFrame | None = None
    for depth in range(3):
        level = rows.where(F.col("depth") == depth)
        if above is None:
            level = level.withColumns({"_ps": F.col("step_start"), "_pe": F.col("step_end")})
        else:
            level = level.join(
                above.select(*STEP, F.col("key").alias("parent_key"), F.col("start_t").alias("_ps"), F.col("end_t").alias("_pe")),
                [*STEP, "parent_key"],
            )
        whole = (F.col("_pe") - F.col("_ps")) * TICK_NS
        took = (F.col("end_t") - F.col("start_t")) * TICK_NS
        level = level.where((whole <= 0) | (took >= F.floor(whole / 100))).select(*SPANS)
        kept.append(level)
        above = level
    return reduce(DataFrame.unionByName, kept)


def parsed_spans(
    lines: DataFrame, bounds: DataFrame, parsers: list[Parser] | None = None, gaps: Gaps | None = None
) -> DataFrame:
    """Spans of numbered lines; ``bounds`` are (job_id, number, step_start, step_end) in ticks."""
    parsers = default_parsers() if parsers is None else parsers
    lines = cut(lines)
    rows = cut(lines.join(bounds, STEP).join(detect_formats(lines, parsers), STEP))

    def of(name: str) -> DataFrame:
        return rows.where(F.col("format") == name).drop("format")

    parts = [p.spans(of(p.name)).select(*SPANS) for p in parsers]
    parts.append(timestamp_spans(of("timestamp"), gaps).select(*SPANS))
    return significant(cut(reduce(DataFrame.unionByName, parts)), bounds)


def step_bounds(steps: DataFrame) -> DataFrame:
    timed = steps.where(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull())
    return timed.select(
        *STEP, (F.unix_micros("started_at") * 10).alias("step_start"), (F.unix_micros("completed_at") * 10).alias("step_end")
    )


def log_spans(
    raw: DataFrame, steps: DataFrame, jobs: DataFrame, parsers: list[Parser] | None = None, gaps: Gaps | None = None
) -> DataFrame:
    """Sub-step spans of raw log lines (job_id, pos, line), linked under their steps.

    ``jobs`` give ``source_id``, ``run_id``, ``attempt`` and ``html_url`` by ``job_id``.  After the
    one-percent rule a parent keeps about a hundred children at most, so their
    numbering is a plain window.
    """
    lines = parse_lines(assign_steps(raw, steps))
    spans = parsed_spans(lines, step_bounds(steps), parsers, gaps)
    order = Window.partitionBy(*STEP, "parent_key").orderBy("start_t", "place", "key")
    names = steps.select(*STEP, F.col("name").alias("step_name"))
    rows = cut(spans).withColumn("_i", F.row_number().over(order) - 1).join(names, STEP)
    seed = ids.seed(F.col("job_id"), F.col("step_name"), F.col("name"), F.col("depth"), F.col("_i"))
    rows = rows.withColumn("span_id", ids.span_id_text(seed))
    parents = rows.select(*STEP, F.col("key").alias("parent_key"), F.col("span_id").alias("_up"))
    rows = rows.join(parents, [*STEP, "parent_key"], "left")
    about = jobs.select("job_id", "source_id", "run_id", "attempt", "html_url")
    rows = rows.join(about, "job_id")
    step_url = F.when(
        F.coalesce("html_url", F.lit("")) != "",
        F.concat("html_url", F.lit("#step:"), F.col("number").cast("string"), F.lit(":1")),
    )
    extra = F.map_filter(
        _attrs(
            ("type", F.lit("log_span")), ("log.parser", F.col("parser")), ("github.url_index", F.col("source_id")),
            ("github.url", text.log_deep_link(step_url, F.col("attrs")["log.line_number"])),
        ),
        lambda _, v: v.isNotNull(),
    )
    return conform_spans(rows.withColumns({
        "trace_id": ids.trace_id(F.col("run_id"), F.col("attempt")),
        "parent_span_id": F.coalesce("_up", step_span_id(F.col("job_id"), F.col("step_name"))),
        "start_ns": F.col("start_t") * TICK_NS, "end_ns": F.col("end_t") * TICK_NS,
        "attrs": F.map_concat(extra, F.col("attrs")),
    }))
