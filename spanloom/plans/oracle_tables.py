"""The fixture projection once more, as plain SQL for the DuckDB side of the checks."""

SOURCES = """
sources AS (
  SELECT n_nationkey AS source_id, lower(r_name) AS owner, lower(n_name) AS repo,
    CASE WHEN n_nationkey % 3 = 0 THEN 'pr' WHEN n_nationkey % 3 = 1 THEN 'commit' ELSE 'run' END AS type,
    CAST(n_nationkey AS VARCHAR) AS identifier, md5(CAST(n_nationkey AS VARCHAR)) AS head_sha,
    'main' AS branch, 'source ' || n_nationkey AS display_name,
    'https://github.com/' || lower(r_name) || '/' || lower(n_name) ||
      CASE WHEN n_nationkey % 3 = 0 THEN '/pull/' WHEN n_nationkey % 3 = 1 THEN '/commit/' ELSE '/actions/runs/' END
      || n_nationkey AS display_url,
    CASE WHEN n_nationkey % 3 = 0 THEN 1704067200000 + CAST(n_nationkey AS BIGINT) * 86400000 END AS merged_ms,
    CASE WHEN n_nationkey % 3 = 1 THEN 1704067200000 + CAST(n_nationkey AS BIGINT) * 3600000 END AS commit_ms,
    CASE WHEN n_nationkey % 3 = 1 THEN 1704067200000 + CAST(n_nationkey AS BIGINT) * 3600000 + 60000 END AS pushed_ms,
    n_nationkey % 4 AS changed_files, n_nationkey * 10 AS additions, n_nationkey * 3 AS deletions
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

RUNS = """
runs AS (
  SELECT s.source_id, o_orderkey AS run_id,
    CAST(CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS run_attempt,
    o_orderpriority AS name, '.github/workflows/' || lower(o_orderpriority) || '.yml' AS path,
    CASE WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'completed' END AS status,
    CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failure' END AS conclusion,
    epoch_ms(o_orderdate) AS created_ms,
    epoch_ms(o_orderdate) + (o_orderkey % 60) * 1000 AS run_started_ms,
    epoch_ms(o_orderdate) + CAST(floor(o_totalprice) AS BIGINT) AS updated_ms,
    CAST(floor(o_totalprice) AS BIGINT) AS duration_ms,
    md5(CAST(o_orderkey AS VARCHAR)) AS head_sha, c_mktsegment AS head_branch,
    CASE WHEN o_orderkey % 3 = 0 THEN 'pull_request' ELSE 'push' END AS event, s.owner, s.repo
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN sources s ON c_nationkey = s.source_id)"""

JOBS = """
items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem),
jobs AS (
  SELECT r.source_id, r.run_id, r.run_id * 1000 + seq AS job_id,
    CAST(CASE WHEN r.run_attempt = 2 AND seq % 2 = 0 THEN 1 ELSE r.run_attempt END AS BIGINT) AS run_attempt,
    p_brand || ' / ' || p_type AS name,
    CASE WHEN r.status = 'in_progress' AND seq = 1 THEN 'in_progress' ELSE 'completed' END AS status,
    CASE WHEN r.status = 'in_progress' AND seq = 1 THEN NULL
      WHEN l_returnflag = 'R' AND l_quantity > 35 THEN 'failure' WHEN seq = 6 THEN 'skipped' ELSE 'success' END AS conclusion,
    created_ms, created_ms + l_linenumber * 1000 AS started_ms,
    CASE WHEN r.status = 'in_progress' AND seq = 1 THEN NULL
      ELSE created_ms + l_linenumber * 1000 + CAST(l_quantity AS BIGINT) * 1000 END AS completed_ms,
    s_name AS runner_name,
    CASE WHEN seq % 5 = 0 THEN '' ELSE 'https://github.com/' || owner || '/' || repo || '/actions/runs/' || r.run_id
      || '/job/' || (r.run_id * 1000 + seq) END AS html_url,
    CAST(l_quantity AS BIGINT) AS seconds, seq
  FROM items JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN runs r ON l_orderkey = r.run_id)"""

STEPS = """
steps AS (
  SELECT source_id, run_id, job_id, run_attempt, k AS number,
    CASE k WHEN 1 THEN 'Checkout' WHEN 2 THEN 'Build' ELSE 'Run tests' END AS name,
    CASE WHEN k = 3 THEN status ELSE 'completed' END AS status,
    CASE WHEN k = 3 THEN conclusion ELSE 'success' END AS conclusion,
    started_ms + (k - 1) * (seconds * 1000 // 3) AS started_ms,
    CASE WHEN k = 3 AND status <> 'completed' THEN NULL ELSE started_ms + k * (seconds * 1000 // 3) END AS completed_ms,
    html_url
  FROM jobs, (VALUES (1), (2), (3)) AS t(k))"""

RUN_JOBS = """
run_jobs AS (
  SELECT j.run_id, job_id, j.name, j.status, j.conclusion, html_url, started_ms, completed_ms,
    r.created_ms AS run_created_ms, head_sha, owner, repo,
    coalesce(completed_ms - started_ms, 0) AS duration_ms, coalesce(started_ms - j.created_ms, 0) AS queue_ms
  FROM jobs j JOIN runs r ON j.run_id = r.run_id
  WHERE j.run_attempt = 0 OR j.run_attempt = r.run_attempt)"""

REVIEWS = """
review_events AS (
  SELECT CAST(user_id % 25 AS INTEGER) AS source_id,
    CASE event_type WHEN 'signup' THEN 'review' WHEN 'click' THEN 'comment' ELSE 'merged' END AS type,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value > 25 THEN 'APPROVED' ELSE 'COMMENTED' END END AS state,
    epoch_us(ts) // 1000 AS time_ms, 'user' || user_id AS "user",
    'https://github.com/o/r/pull/' || event_id AS url,
    CASE WHEN event_type = 'purchase' THEN event_id END AS pr_number,
    CASE WHEN event_type = 'purchase' THEN 'change ' || event_id END AS pr_title
  FROM events WHERE event_type IN ('signup', 'click', 'purchase'))"""

SPANS = """
spans AS (
  SELECT CAST(user_id % 25 AS INTEGER) AS source_id, md5(CAST(user_id AS VARCHAR)) AS trace_id,
    lpad(lower(to_hex(event_id + 1)), 16, '0') AS span_id,
    CASE WHEN event_id <> min(event_id) OVER (PARTITION BY user_id, event_id // 1000)
      THEN lpad(lower(to_hex(min(event_id) OVER (PARTITION BY user_id, event_id // 1000) + 1)), 16, '0') END AS parent_span_id,
    event_type || ' ' || event_id AS name,
    CASE event_type WHEN 'view' THEN 'SERVER' WHEN 'click' THEN 'CLIENT' ELSE 'INTERNAL' END AS kind,
    epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + CAST(floor(value) AS BIGINT) * 1000000 AS end_ns,
    CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'UNSET' END AS status_code,
    event_type, event_id AS seq, user_id, json_extract_string(props, '$.k') AS k,
    'svc' || (user_id % 5) AS service_name,
    CASE WHEN event_type = 'view' THEN 200 + (event_id % 4) * 100 END AS http_status,
    CASE event_type
      WHEN 'view' THEN 'http.request.method=GET;http.response.status_code=' || (200 + (event_id % 4) * 100) || ';http.route=/view;k=' || json_extract_string(props, '$.k')
      WHEN 'click' THEN 'k=' || json_extract_string(props, '$.k') || ';rpc.method=Click;rpc.service=ui;rpc.system=grpc'
      WHEN 'purchase' THEN 'db.operation=INSERT;db.system=postgresql;k=' || json_extract_string(props, '$.k')
      WHEN 'signup' THEN 'k=' || json_extract_string(props, '$.k') || ';messaging.destination.name=signups;messaging.system=kafka'
      ELSE 'k=' || json_extract_string(props, '$.k') END AS attr_text
  FROM events)"""

WINDOWS = """
current_jobs AS (SELECT j.* FROM jobs j JOIN runs r USING (run_id) WHERE j.run_attempt = r.run_attempt),
done AS (SELECT run_id, max(CASE WHEN status = 'completed' THEN completed_ms END) AS done_ms, count(*) AS job_count
  FROM current_jobs GROUP BY 1),
windows AS (
  SELECT r.*, CASE WHEN run_attempt > 1 THEN run_started_ms ELSE created_ms END AS start_ms, updated_ms AS end_ms,
    greatest(updated_ms, coalesce(done_ms, updated_ms)) AS effective_end_ms, coalesce(job_count, 0) AS job_count
  FROM runs r LEFT JOIN done USING (run_id)),
attempts AS (
  SELECT j.run_id, j.run_attempt AS attempt, min(j.created_ms) AS start_ms, max(completed_ms) AS end_ms0,
    CASE WHEN count(CASE WHEN j.conclusion = 'failure' THEN 1 END) > 0 THEN 'failure' ELSE 'success' END AS conclusion
  FROM jobs j JOIN runs r USING (run_id) WHERE j.run_attempt < r.run_attempt GROUP BY 1, 2),
bounds AS (
  SELECT run_id, run_attempt AS attempt, effective_end_ms AS bound_ms FROM windows
  UNION ALL SELECT run_id, attempt, coalesce(end_ms0, start_ms + 1) FROM attempts)"""

FACTS = """
required AS (SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'Brand#' || (source_id % 25 + 1) END AS c1,
  CASE WHEN source_id % 5 = 0 THEN '1-URGENT' END AS c2,
  CASE WHEN source_id % 5 = 0 THEN 'Brand#' || (source_id % 25 + 1) END AS c3 FROM sources),
facts AS (
  SELECT j.source_id, j.run_id, j.job_id, j.run_attempt AS attempt, j.run_attempt = r.run_attempt AS is_current,
    j.name, r.name AS workflow, j.status, j.conclusion, j.runner_name, r.owner, r.repo, r.head_sha, j.html_url, j.created_ms,
    CASE WHEN j.html_url <> '' THEN j.html_url ELSE 'https://github.com/' || r.owner || '/' || r.repo || '/actions/runs/' || j.run_id || '/job/' || j.job_id END AS url,
    coalesce(c1, c2, c3) IS NULL OR coalesce(starts_with(j.name, c1), false) OR coalesce(starts_with(r.name || ' / ' || j.name, c2), false)
      OR coalesce(starts_with(j.name, c3), false) AS is_required,
    completed_ms IS NULL AS is_pending,
    completed_ms IS NOT NULL AND j.conclusion <> 'success' AS is_failed,
    started_ms AS start_ms, greatest(started_ms + 1, least(coalesce(completed_ms, bound_ms), bound_ms)) AS end_ms,
    least(started_ms, bound_ms) AS span_start_ms, least(coalesce(completed_ms, bound_ms), bound_ms) AS span_end_ms,
    greatest(started_ms - j.created_ms, 0) AS queue_ms,
    CASE WHEN coalesce(j.conclusion, '') IN ('skipped', 'cancelled') THEN 0 ELSE greatest(started_ms - j.created_ms, 0) END AS ran_queue_ms,
    greatest(started_ms + 1, least(coalesce(completed_ms, bound_ms), bound_ms)) - started_ms AS duration_ms
  FROM jobs j JOIN runs r USING (run_id) JOIN bounds b ON b.run_id = j.run_id AND b.attempt = j.run_attempt
  LEFT JOIN required q ON q.source_id = j.source_id)"""

STEP_FACTS = """
step_facts AS (
  SELECT f.source_id, f.run_id, f.job_id, f.attempt, s.number, s.name, s.status, s.conclusion, f.name AS job_name,
    f.url || '#step:' || s.number || ':1' AS url, least(started_ms, f.end_ms) AS start_ms,
    greatest(least(started_ms, f.end_ms) + 1, least(completed_ms, f.end_ms)) AS end_ms,
    least(completed_ms, f.end_ms) AS span_end_ms, f.end_ms AS job_end_ms,
    greatest(least(started_ms, f.end_ms) + 1, least(completed_ms, f.end_ms)) - least(started_ms, f.end_ms) AS duration_ms
  FROM steps s JOIN facts f USING (job_id) WHERE completed_ms IS NOT NULL)"""

PARTS = {
    "windows": (["jobs"], WINDOWS), "facts": (["windows"], FACTS), "step_facts": (["facts", "steps"], STEP_FACTS),
    "sources": ([], SOURCES), "runs": (["sources"], RUNS), "jobs": (["runs"], JOBS),
    "steps": (["jobs"], STEPS), "run_jobs": (["jobs"], RUN_JOBS),
    "review_events": ([], REVIEWS), "spans": ([], SPANS),
}


def with_tables(needs: list[str], body: str) -> str:
    """Prefix ``body`` (its own CTEs or a SELECT) with the fixture CTEs it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in PARTS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for need in needs:
        add(need)
    head = ",".join(PARTS[n][1] for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
