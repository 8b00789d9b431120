"""Registered queries over job logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import logs
from spanloom.plans import fixtures as fx
from spanloom.plans.registry import query

GAPS = logs.Gaps(gap=12 * fx.HOUR_TICKS, shortest=fx.HOUR_TICKS, noise=14 * fx.HOUR_TICKS)

LINES = """
WITH raw AS (SELECT user_id AS job_id, event_id AS pos, epoch_us(ts) * 10 AS t, event_id % 211 = 0 AS short, user_id % 4 AS kind, event_type AS e,
    json_extract_string(props, '$.k') AS k, event_id FROM events),
said AS (SELECT *, CASE kind
    WHEN 0 THEN CASE e WHEN 'view' THEN '> Task :app:t' || k || ' UP-TO-DATE' WHEN 'click' THEN '> Task :lib:t' || k ELSE 'note ' || k END
    WHEN 1 THEN CASE e WHEN 'view' THEN '[' || k || ' / 100] Compiling f' || (event_id % 2) WHEN 'click' THEN '[' || k || ' / 100] ' || k || ' / 9 tests; no actions running'
      WHEN 'signup' THEN 'Loading: ' || k ELSE 'note ' || k END
    WHEN 2 THEN CASE e WHEN 'view' THEN 'Getting action download info' WHEN 'click' THEN 'Download action repository ' || k WHEN 'signup' THEN 'Prepare workflow directory' ELSE 'note ' || k END
    ELSE CASE e WHEN 'error' THEN '##[group]Run ' || k WHEN 'purchase' THEN '##[endgroup]' WHEN 'view' THEN 'Compiling unit' || k WHEN 'click' THEN '......' ELSE 'Downloading pkg' || k END
    END AS content FROM raw),
c AS (SELECT 1704067200000 * 10000 AS base, 864000000000 AS day),
stepped AS (SELECT said.*, CASE WHEN short THEN 2 WHEN t BETWEEN base + day AND base + 13 * day THEN 1 WHEN t BETWEEN base + 15 * day AND base + 27 * day THEN 2
    WHEN t >= base + 15 * day THEN 2 ELSE 1 END AS number FROM said, c),
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id, number ORDER BY pos) AS line_num FROM stepped),
b AS (SELECT numbered.*, base + CASE number WHEN 1 THEN day ELSE 15 * day END AS step_start, base + CASE number WHEN 1 THEN 13 * day ELSE 27 * day END AS step_end FROM numbered, c),
lines AS (SELECT *, CASE WHEN bool_or(starts_with(content, '> Task :')) OVER w THEN 'gradle' WHEN bool_or(starts_with(content, '[')) OVER w THEN 'bazel'
    WHEN bool_or(content IN ('Getting action download info', 'Prepare workflow directory')) OVER w THEN 'setup-job' ELSE 'timestamp' END AS fmt
  FROM b WHERE NOT short WINDOW w AS (PARTITION BY job_id, number))
"""


def lines_of(spark, folder):
    return logs.parse_lines(logs.assign_steps(fx.raw_log_lines(spark, folder), fx.log_steps(spark, folder)))


def of_format(spark, folder, name):
    """The lines of every step that is told to be of a format, with the step's bounds."""
    rows = lines_of(spark, folder)
    told = logs.detect_formats(rows).where(F.col("format") == name).select(*logs.STEP)
    return rows.join(told, logs.STEP).join(logs.step_bounds(fx.log_steps(spark, folder)), logs.STEP)


def shown(spans, *keys):
    attrs = [F.coalesce(F.col("attrs")[k], F.lit("")).alias(n) for k, n in keys]
    return spans.select("job_id", "number", "name", "start_t", "end_t", *attrs)


@query("J13_S13_P6_step_lines", [], LINES + """
SELECT job_id, CAST(number AS INTEGER) AS number, CAST(line_num AS INTEGER) AS line_num, t, content FROM lines""")
def step_lines(spark, folder):
    return lines_of(spark, folder)


@query("G1_format_detection", [], LINES + """
SELECT job_id, CAST(number AS INTEGER) AS number, CASE WHEN bool_or(starts_with(content, '> Task :')) THEN 'gradle' WHEN bool_or(starts_with(content, '[')) THEN 'bazel'
  WHEN bool_or(content IN ('Getting action download info', 'Prepare workflow directory')) THEN 'setup-job' ELSE 'timestamp' END AS format FROM lines GROUP BY 1, 2""")
def format_detection(spark, folder):
    return logs.detect_formats(lines_of(spark, folder))


@query("G2_W8_gradle_spans", [], LINES + """
SELECT job_id, CAST(number AS INTEGER) AS number, regexp_extract(content, '^> Task (:\\S+)(.*)$', 1) AS name, t AS start_t,
  coalesce(lead(t) OVER (PARTITION BY job_id, number ORDER BY line_num), step_end) AS end_t, CASE WHEN e = 'view' THEN 'UP-TO-DATE' ELSE 'SUCCESS' END AS outcome,
  CAST(line_num AS VARCHAR) AS line FROM lines WHERE fmt = 'gradle' AND e IN ('view', 'click')""")
def gradle_spans(spark, folder):
    return shown(logs.gradle_spans(of_format(spark, folder, "gradle")), ("gradle.task.outcome", "outcome"), ("log.line_number", "line"))


@query("G3_W11_W14_bazel_spans", [], LINES + """,
f AS (SELECT job_id, number, min(line_num) AS first_action FROM lines WHERE fmt = 'bazel' AND e IN ('view', 'click') GROUP BY 1, 2),
m AS (SELECT l.*, CASE e WHEN 'view' THEN 'Compiling f' || (event_id % 2) WHEN 'click' THEN k || ' / 9 tests; no actions running' ELSE 'Loading' END AS label,
    CASE e WHEN 'view' THEN 'Compiling f' || (event_id % 2) WHEN 'click' THEN 'waiting (no actions running)' ELSE 'Loading' END AS mk
  FROM lines l LEFT JOIN f USING (job_id, number) WHERE fmt = 'bazel' AND (e IN ('view', 'click') OR (e = 'signup' AND (first_action IS NULL OR line_num < first_action)))),
g AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM mk THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, number ORDER BY line_num) AS run
  FROM (SELECT *, lag(mk) OVER (PARTITION BY job_id, number ORDER BY line_num) AS p FROM m)),
r AS (SELECT job_id, number, run, first(label ORDER BY line_num) AS label, any_value(mk) AS mk, first(t ORDER BY line_num) AS t, min(line_num) AS line_num, count(*) AS n,
  any_value(step_start) AS step_start, any_value(step_end) AS step_end FROM g GROUP BY 1, 2, 3)
SELECT job_id, CAST(number AS INTEGER) AS number, label || CASE WHEN n > 1 THEN ' (×' || n || ')' ELSE '' END AS name, t AS start_t,
  coalesce(lead(t) OVER (PARTITION BY job_id, number ORDER BY line_num), step_end) AS end_t, mk AS description, CAST(line_num AS VARCHAR) AS line FROM r
UNION ALL SELECT job_id, CAST(number AS INTEGER), 'Starting', step_start, t, 'Bazel startup and initialization', '1' FROM r WHERE run = 1 AND t - step_start > 10000000""")
def bazel_spans(spark, folder):
    return shown(logs.bazel_spans(of_format(spark, folder, "bazel")), ("bazel.action.description", "description"), ("log.line_number", "line"))


@query("G4_W15_setup_spans", [], LINES + """,
m AS (SELECT *, CASE e WHEN 'view' THEN 'Resolve actions' WHEN 'click' THEN 'Download actions' ELSE 'Prepare workspace' END AS phase FROM lines WHERE fmt = 'setup-job' AND e IN ('view', 'click', 'signup')),
d AS (SELECT *, lag(phase) OVER (PARTITION BY job_id, number ORDER BY line_num) AS p FROM m)
SELECT job_id, CAST(number AS INTEGER) AS number, phase AS name, t AS start_t, coalesce(lead(t) OVER (PARTITION BY job_id, number ORDER BY line_num), step_end) AS end_t,
  CAST(line_num AS VARCHAR) AS line FROM d WHERE p IS DISTINCT FROM phase""")
def setup_spans(spark, folder):
    return shown(logs.setup_spans(of_format(spark, folder, "setup-job")), ("log.line_number", "line"))


REGIONS = LINES + """,
p AS (SELECT *, CASE WHEN starts_with(content, '##[group]') THEN 'group' WHEN starts_with(content, '##[endgroup]') THEN 'end' END AS mark FROM lines WHERE fmt = 'timestamp'),
n AS (SELECT *, lead(mark) OVER (PARTITION BY job_id, number ORDER BY line_num) AS nxt FROM p WHERE mark IS NOT NULL),
lost AS (SELECT job_id, number, line_num AS gl FROM n WHERE mark = 'group' AND nxt = 'group'),
o AS (SELECT *, coalesce(last_value(CASE mark WHEN 'group' THEN line_num WHEN 'end' THEN 0 END IGNORE NULLS) OVER (PARTITION BY job_id, number ORDER BY line_num), 0) AS gl FROM p),
q AS (SELECT o.*, o.gl AS region FROM o ANTI JOIN lost l ON l.job_id = o.job_id AND l.number = o.number AND l.gl = o.gl),
heads AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY job_id, number ORDER BY line_num), step_end) AS end_t FROM q WHERE mark = 'group'),
pl AS (SELECT q.*, coalesce(h.end_t, q.step_end) AS region_end FROM q LEFT JOIN heads h ON h.job_id = q.job_id AND h.number = q.number AND h.line_num = q.region WHERE q.mark IS NULL),
gp AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b >= 432000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, number, region ORDER BY line_num) AS piece
  FROM (SELECT *, lag(t) OVER (PARTITION BY job_id, number, region ORDER BY line_num) AS b FROM pl)),
pc AS (SELECT job_id, number, region, piece, first(t ORDER BY line_num) AS t, min(line_num) AS line_num, count(*) AS line_count, first(content ORDER BY line_num) AS name,
  any_value(region_end) AS region_end FROM gp GROUP BY 1, 2, 3, 4),
pe AS (SELECT *, max(piece) OVER (PARTITION BY job_id, number, region) AS pieces, coalesce(lead(t) OVER (PARTITION BY job_id, number, region ORDER BY line_num), region_end) AS end_t FROM pc),
pieces AS (SELECT * FROM pe WHERE pieces > 1 AND end_t - t >= 36000000000)
"""


@query("W10_W13_G6_gap_pieces", [], REGIONS + """
SELECT job_id, CAST(number AS INTEGER) AS number, CAST(region AS INTEGER) AS region, name, t AS start_t, end_t, line_count FROM pieces""")
def gap_pieces(spark, folder):
    marked = logs.mark_regions(of_format(spark, folder, "timestamp")).where(F.col("region").isNotNull())
    groups = logs._next_start(marked.where(F.col("mark") == "group").drop("mark"), logs.STEP, F.col("step_end"))
    ends = groups.select(*logs.STEP, F.col("line_num").alias("region"), F.col("end_t").alias("group_end"))
    plain = marked.where(F.col("mark").isNull()).drop("mark").join(ends, logs.REGION, "left")
    pieces = logs.gap_groups(plain.withColumn("region_end", F.coalesce("group_end", "step_end")), GAPS)
    return pieces.select("job_id", "number", "region", "name", F.col("t").alias("start_t"), "end_t", "line_count")


TIMESTAMP = REGIONS + """,
z AS (SELECT *, name = '......' AS noise, CASE WHEN name = '......' THEN '' ELSE name END AS mk FROM pieces),
z1 AS (SELECT *, sum(CASE WHEN pk IS NOT DISTINCT FROM mk THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, number, region ORDER BY line_num) AS run
  FROM (SELECT *, lag(mk) OVER (PARTITION BY job_id, number, region ORDER BY line_num) AS pk FROM z)),
z2 AS (SELECT job_id, number, region, run, first(name ORDER BY line_num) AS name, bool_or(noise) AS noise, first(t ORDER BY line_num) AS t, last(end_t ORDER BY line_num) AS end_t,
  min(line_num) AS line_num, CAST(sum(line_count) AS BIGINT) AS line_count, count(*) AS n FROM z1 GROUP BY 1, 2, 3, 4),
z3 AS (SELECT *, format('{:.1f}m', round_even(((end_t - t) // 10000) / 6000.0, 0) / 10.0) AS took FROM z2 WHERE n > 1 OR NOT noise OR end_t - t >= 504000000000),
z4 AS (SELECT * EXCLUDE (name), CASE WHEN n > 1 THEN name || ' (x' || n || ', ' || took || ')' WHEN noise THEN '(' || name || ')' ELSE name END AS name FROM z3),
w AS (SELECT *, regexp_extract(name, '^([A-Za-z][^ ]*) ', 1) AS word FROM z4),
w1 AS (SELECT *, sum(CASE WHEN pw IS NOT DISTINCT FROM word THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, number, region ORDER BY line_num) AS wrun
  FROM (SELECT *, lag(word) OVER (PARTITION BY job_id, number, region ORDER BY line_num) AS pw FROM w)),
w2 AS (SELECT *, count(*) OVER v AS size, min(line_num) OVER v AS run_line, min(t) OVER v AS run_start,
  last_value(end_t) OVER (PARTITION BY job_id, number, region, wrun ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run_end FROM w1
  WINDOW v AS (PARTITION BY job_id, number, region, wrun)),
x AS (SELECT *, word <> '' AND size >= 3 AS ins FROM w2),
ts AS (
  SELECT job_id, number, 0 AS depth, 'g-' || line_num AS key, '' AS parent_key, substr(content, 10) AS name, t AS start_t, end_t, line_num * 2 AS place, line_num AS line FROM heads
  UNION ALL SELECT job_id, number, CASE WHEN region > 0 THEN 1 ELSE 0 END + CASE WHEN ins THEN 1 ELSE 0 END, 'l-' || line_num,
    CASE WHEN ins THEN 'p-' || run_line WHEN region > 0 THEN 'g-' || region ELSE '' END, CASE WHEN ins THEN trim(substr(name, length(word) + 1)) ELSE name END, t, end_t,
    line_num * 2 + 1, CASE WHEN region > 0 THEN region ELSE line_num END FROM x
  UNION ALL SELECT job_id, number, CASE WHEN region > 0 THEN 1 ELSE 0 END, 'p-' || run_line, CASE WHEN region > 0 THEN 'g-' || region ELSE '' END,
    word || ' (x' || size || ', ' || format('{:.1f}m', round_even(((run_end - run_start) // 10000) / 6000.0, 0) / 10.0) || ')', run_start, run_end,
    line_num * 2 + 1, CASE WHEN region > 0 THEN region ELSE line_num END FROM x WHERE ins AND line_num = run_line)
"""


@query("G5_W12_F15_F16_timestamp_spans", [], TIMESTAMP + """
SELECT job_id, CAST(number AS INTEGER) AS number, depth, key, parent_key, name, start_t, end_t FROM ts""")
def timestamp_spans(spark, folder):
    out = logs.timestamp_spans(of_format(spark, folder, "timestamp"), GAPS)
    return out.select("job_id", "number", "depth", "key", "parent_key", "name", "start_t", "end_t")


@query("F13_significant_log_spans", [], TIMESTAMP + """,
d0 AS (SELECT * FROM ts WHERE depth = 0 AND (end_t - start_t) * 100 >= (12 * 864000000000 * 100) // 100),
d1 AS (SELECT a.* FROM ts a JOIN d0 p ON a.job_id = p.job_id AND a.number = p.number AND a.parent_key = p.key WHERE a.depth = 1
  AND (p.end_t <= p.start_t OR (a.end_t - a.start_t) * 100 >= ((p.end_t - p.start_t) * 100) // 100)),
d2 AS (SELECT a.* FROM ts a JOIN d1 p ON a.job_id = p.job_id AND a.number = p.number AND a.parent_key = p.key WHERE a.depth = 2
  AND (p.end_t <= p.start_t OR (a.end_t - a.start_t) * 100 >= ((p.end_t - p.start_t) * 100) // 100))
SELECT job_id, CAST(number AS INTEGER) AS number, depth, key, name FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)""")
def significant_log_spans(spark, folder):
    bounds = logs.step_bounds(fx.log_steps(spark, folder))
    out = logs.significant(logs.timestamp_spans(of_format(spark, folder, "timestamp"), GAPS).select(*logs.SPANS), bounds)
    return out.select("job_id", "number", "depth", "key", "name")


LOG_SPANS = TIMESTAMP + """,
gr AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY job_id, number ORDER BY line_num), step_end) AS end_t FROM lines WHERE fmt = 'gradle' AND e IN ('view', 'click')),
bf AS (SELECT job_id, number, min(line_num) AS first_action FROM lines WHERE fmt = 'bazel' AND e IN ('view', 'click') GROUP BY 1, 2),
bm AS (SELECT l.*, CASE e WHEN 'view' THEN 'Compiling f' || (event_id % 2) WHEN 'click' THEN k || ' / 9 tests; no actions running' ELSE 'Loading' END AS label,
    CASE e WHEN 'view' THEN 'Compiling f' || (event_id % 2) WHEN 'click' THEN 'waiting (no actions running)' ELSE 'Loading' END AS mk
  FROM lines l LEFT JOIN bf USING (job_id, number) WHERE fmt = 'bazel' AND (e IN ('view', 'click') OR (e = 'signup' AND (first_action IS NULL OR line_num < first_action)))),
bg AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM mk THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, number ORDER BY line_num) AS run
  FROM (SELECT *, lag(mk) OVER (PARTITION BY job_id, number ORDER BY line_num) AS p FROM bm)),
br AS (SELECT job_id, number, run, first(label ORDER BY line_num) AS label, first(t ORDER BY line_num) AS t, min(line_num) AS line_num, count(*) AS n,
  any_value(step_start) AS step_start, any_value(step_end) AS step_end FROM bg GROUP BY 1, 2, 3),
sd AS (SELECT *, lag(phase) OVER (PARTITION BY job_id, number ORDER BY line_num) AS p FROM (SELECT *, CASE e WHEN 'view' THEN 'Resolve actions' WHEN 'click' THEN 'Download actions'
  ELSE 'Prepare workspace' END AS phase FROM lines WHERE fmt = 'setup-job' AND e IN ('view', 'click', 'signup'))),
al AS (
  SELECT * FROM ts
  UNION ALL SELECT job_id, number, 0, 'l-' || line_num, '', regexp_extract(content, '^> Task (:\\S+)(.*)$', 1), t, end_t, line_num, line_num FROM gr
  UNION ALL SELECT job_id, number, 0, 'l-' || line_num, '', label || CASE WHEN n > 1 THEN ' (×' || n || ')' ELSE '' END, t,
    coalesce(lead(t) OVER (PARTITION BY job_id, number ORDER BY line_num), step_end), line_num, line_num FROM br
  UNION ALL SELECT job_id, number, 0, 'l-0', '', 'Starting', step_start, t, 0, 1 FROM br WHERE run = 1 AND t - step_start > 10000000
  UNION ALL SELECT job_id, number, 0, 'l-' || line_num, '', phase, t, coalesce(lead(t) OVER (PARTITION BY job_id, number ORDER BY line_num), step_end), line_num, line_num
    FROM sd WHERE p IS DISTINCT FROM phase),
d0 AS (SELECT * FROM al WHERE depth = 0 AND (end_t - start_t) * 100 >= (12 * 864000000000 * 100) // 100),
d1 AS (SELECT a.* FROM al a JOIN d0 p ON a.job_id = p.job_id AND a.number = p.number AND a.parent_key = p.key WHERE a.depth = 1
  AND (p.end_t <= p.start_t OR (a.end_t - a.start_t) * 100 >= ((p.end_t - p.start_t) * 100) // 100)),
d2 AS (SELECT a.* FROM al a JOIN d1 p ON a.job_id = p.job_id AND a.number = p.number AND a.parent_key = p.key WHERE a.depth = 2
  AND (p.end_t <= p.start_t OR (a.end_t - a.start_t) * 100 >= ((p.end_t - p.start_t) * 100) // 100)),
nu AS (SELECT *, CASE number WHEN 1 THEN 'Build' ELSE 'Run tests' END AS step, row_number() OVER (PARTITION BY job_id, number, parent_key ORDER BY start_t, place, key) - 1 AS i
  FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)),
s AS (SELECT *, substr(md5(job_id || '-' || step || '-' || name || '-' || depth || '-' || i), 1, 16) AS span_id FROM nu)
SELECT md5(s.job_id || '-1') AS trace_id, s.span_id, coalesce(p.span_id, substr(md5(s.job_id || '-' || s.step), 1, 16)) AS parent_span_id, s.name,
  s.start_t * 100 AS start_ns, s.end_t * 100 AS end_ns, 'https://github.com/o/r/actions/runs/1/job/' || s.job_id || '#step:' || s.number || ':' || s.line AS url
FROM s LEFT JOIN s p ON p.job_id = s.job_id AND p.number = s.number AND p.key = s.parent_key
"""


@query("G7_P28_X2_log_spans", [], LOG_SPANS)
def log_spans(spark, folder):
    """All spans of the logs, by the built-in formats given as a caller would give them."""
    spans = logs.log_spans(
        fx.raw_log_lines(spark, folder), fx.log_steps(spark, folder), fx.log_jobs(spark, folder), parsers=logs.default_parsers(), gaps=GAPS
    )
    return spans.select("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", F.col("attrs")["github.url"].alias("url"))
