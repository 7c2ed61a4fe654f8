"""Queries of operations: retention, log analytics, progress, history, batches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import ops as O
from docloom.plans.registry import query
from docloom.sources import carriers as C

R, M = (C.RUNS,), (C.MESSAGES,)


@query("retention", """WITH expired AS (SELECT run_id FROM runs WHERE created_at < 1704500000 ORDER BY created_at, run_id LIMIT 2000),
kept AS (SELECT * FROM runs WHERE run_id NOT IN (SELECT run_id FROM expired)),
over AS (SELECT run_id FROM kept ORDER BY created_at, run_id LIMIT (SELECT greatest(0, least(2000, count(*) - 500)) FROM kept))
SELECT run_id, run_id IN (SELECT run_id FROM expired) OR run_id IN (SELECT run_id FROM over) AS removed FROM runs""", R)  # fmt: skip
def retention(spark, sf):
    rows = C.runs(spark, sf).select("run_id", "created_at")
    return O.prune(rows, "run_id", "created_at", 1704500000, 500, 2000).select("run_id", "removed")


@query("win_history_cap", "SELECT session_id, seq, role FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3", M)
def win_history_cap(spark, sf):
    return O.newest(C.messages(spark, sf), ["session_id"], [F.desc("seq")], 3).select("session_id", "seq", "role")


@query("win_run_cap", "SELECT run_id, user_id FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id DESC) <= 10", R)
def win_run_cap(spark, sf):
    return O.newest(C.runs(spark, sf), ["user_id"], [F.desc("created_at"), F.desc("run_id")], 10).select("run_id", "user_id")


@query("win_history_tail", "SELECT session_id, seq, (row_number() OVER (PARTITION BY session_id ORDER BY seq))::INT AS pos FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4)", M)
def win_history_tail(spark, sf):
    rows = O.newest(C.messages(spark, sf), ["session_id"], [F.desc("seq")], 4)
    return rows.select("session_id", "seq", F.row_number().over(W.partitionBy("session_id").orderBy("seq")).alias("pos"))


@query("win_latest_answer", "SELECT query_id, arg_max(run_id, created_at * 1000000 + run_id) AS run_id FROM runs GROUP BY query_id", R)
def win_latest_answer(spark, sf):
    return C.runs(spark, sf).groupBy("query_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


@query("win_compact_history", """SELECT session_id, seq, least(length(text), room)::INT AS chars, substr(text, 1, room) AS text FROM (
  SELECT *, (1400 - coalesce(sum(length(text)) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS room FROM (
    SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 8)) WHERE room > 0""", M)  # fmt: skip
def win_compact_history(spark, sf):
    """Last eight turns, then newest first until 1,400 characters; the turn at the limit is cut."""
    rows = O.newest(C.messages(spark, sf), ["session_id"], [F.desc("seq")], 8)
    back = W.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(back), F.lit(0))
    rows = rows.withColumn("room", F.lit(1400) - used).filter("room > 0")
    return rows.select("session_id", "seq", F.least(F.length("text"), F.col("room")).cast("int").alias("chars"), F.substring("text", F.lit(1), F.col("room").cast("int")).alias("text"))


@query("agg_ops_failure", """WITH recent AS (SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 500),
ans AS (SELECT * FROM runs WHERE run_id % 2 = 1 ORDER BY created_at DESC, run_id DESC LIMIT 500),
codes AS (SELECT DISTINCT query_id, failure_code FROM (SELECT query_id, failure_code FROM recent UNION ALL SELECT query_id, failure_code FROM ans) WHERE failure_code <> '')
SELECT * FROM (SELECT 'failure_code' AS kind, failure_code AS value, count(*) AS n FROM codes GROUP BY 2 ORDER BY n DESC, value LIMIT 12)
UNION ALL SELECT * FROM (SELECT 'status' AS kind, status AS value, count(*) AS n FROM recent GROUP BY 2 ORDER BY n DESC, value LIMIT 12)
UNION ALL SELECT 'gap', 'slow', count_if(latency > 100) FROM recent""", R)  # fmt: skip
def agg_ops_failure(spark, sf):
    r = C.runs(spark, sf)
    order = [F.desc("created_at"), F.desc("run_id")]
    recent, answers = r.orderBy(*order).limit(500), r.filter("run_id % 2 = 1").orderBy(*order).limit(500)
    codes = recent.select("query_id", "failure_code").unionByName(answers.select("query_id", "failure_code")).filter("failure_code <> ''").dropDuplicates()
    gaps = recent.agg(F.count_if(F.col("latency") > 100).alias("n")).select(F.lit("gap").alias("kind"), F.lit("slow").alias("value"), "n")
    return O.histogram(codes, F.col("failure_code"), "failure_code", 12).unionByName(O.histogram(recent, F.col("status"), "status", 12)).unionByName(gaps)


@query("st_dedupe_failure", "SELECT DISTINCT query_id, failure_code FROM runs WHERE failure_code <> ''", R)
def st_dedupe_failure(spark, sf):
    return C.runs(spark, sf).filter("failure_code <> ''").select("query_id", "failure_code").dropDuplicates()


@query("agg_validator_diag", "SELECT status, count(*) AS n, count_if(k > 50) AS retries, count(DISTINCT failure_code) FILTER (failure_code <> '') AS codes FROM runs GROUP BY status", R)
def agg_validator_diag(spark, sf):
    return C.runs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 50).alias("retries"), F.count_distinct(F.when(F.col("failure_code") != "", F.col("failure_code"))).alias("codes"))


# answers and searches: two logs that hold every run, failed ones both
LOGS = """answer_log AS (SELECT * FROM runs WHERE status IN ('view', 'click', 'error')), search_log AS (SELECT * FROM runs WHERE status NOT IN ('view', 'click'))"""


def _logs(spark, sf):
    r = C.runs(spark, sf)
    return r.filter(F.col("status").isin("view", "click", "error")), r.filter(~F.col("status").isin("view", "click"))


@query("agg_latest_kb", "SELECT kb, max(created_at) AS latest, count(*) AS n FROM (SELECT kb, created_at FROM answer_log UNION ALL SELECT kb, created_at FROM search_log) GROUP BY kb", (C.RUNS, LOGS))
def agg_latest_kb(spark, sf):
    a, b = _logs(spark, sf)
    return a.select("kb", "created_at").unionByName(b.select("kb", "created_at")).groupBy("kb").agg(F.max("created_at").alias("latest"), F.count(F.lit(1)).alias("n"))


@query("agg_last_activity", "SELECT (SELECT max(created_at) FROM answer_log) AS answered, (SELECT max(created_at) FROM search_log) AS searched, greatest((SELECT max(created_at) FROM answer_log), (SELECT max(created_at) FROM search_log)) AS latest", (C.RUNS, LOGS))
def agg_last_activity(spark, sf):
    a, b = (x.agg(F.max("created_at").alias(n)) for x, n in zip(_logs(spark, sf), ("answered", "searched"), strict=True))
    return a.join(F.broadcast(b)).select("answered", "searched", F.greatest("answered", "searched").alias("latest"))  # one row each


@query("set_union_all", "SELECT kb, run_id, 'answer' AS log FROM answer_log UNION ALL SELECT kb, run_id, 'search' FROM search_log", (C.RUNS, LOGS))
def set_union_all(spark, sf):
    a, b = _logs(spark, sf)
    return a.select("kb", "run_id", F.lit("answer").alias("log")).unionByName(b.select("kb", "run_id", F.lit("search").alias("log")))


@query("agg_batch_wall", "SELECT kb, round(avg(latency), 3) AS mean, round(quantile_cont(latency, 0.5), 3) AS p50, round(quantile_cont(latency, 0.95), 3) AS p95, round(max(latency), 3) AS longest FROM runs GROUP BY kb", R)
def agg_batch_wall(spark, sf):
    return C.runs(spark, sf).groupBy("kb").agg(F.round(F.avg("latency"), 3).alias("mean"), F.round(F.expr("percentile(latency, 0.5)"), 3).alias("p50"), F.round(F.expr("percentile(latency, 0.95)"), 3).alias("p95"), F.round(F.max("latency"), 3).alias("longest"))


@query("agg_token_stats", "SELECT kb, quantile_disc(k, 0.95) AS p95, max(k) AS most, sum(k)::BIGINT AS total, count_if(k > 90) AS truncated FROM runs GROUP BY kb", R)
def agg_token_stats(spark, sf):
    return C.runs(spark, sf).groupBy("kb").agg(O.nearest_rank("k", 0.95).cast("int").alias("p95"), F.max("k").alias("most"), F.sum("k").alias("total"), F.count_if(F.col("k") > 90).alias("truncated"))


@query("agg_matrix_best", "SELECT status, run_id FROM runs WHERE latency IS NOT NULL QUALIFY row_number() OVER (PARTITION BY status ORDER BY latency, k, run_id) = 1", R)
def agg_matrix_best(spark, sf):
    return C.runs(spark, sf).filter("latency IS NOT NULL").groupBy("status").agg(F.min_by("run_id", F.struct("latency", "k", "run_id")).alias("run_id"))


@query("topk_recent_logs", "SELECT run_id FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 50", R)
def topk_recent_logs(spark, sf):
    return C.runs(spark, sf).orderBy(F.desc("created_at"), F.desc("run_id")).limit(50).select("run_id")


@query("topk_jobs", "SELECT run_id, status FROM runs WHERE status = 'view' OR status = 'purchase' ORDER BY created_at DESC, run_id DESC LIMIT 20", R)
def topk_jobs(spark, sf):
    return C.runs(spark, sf).filter(F.col("status").isin("view", "purchase")).orderBy(F.desc("created_at"), F.desc("run_id")).limit(20).select("run_id", "status")


@query("job_find_reported", "SELECT user_id, status, arg_max(run_id, created_at * 1000000 + run_id) AS run_id FROM runs GROUP BY user_id, status", R)
def job_find_reported(spark, sf):
    return C.runs(spark, sf).groupBy("user_id", "status").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


@query("jobs_cleanup", "SELECT run_id FROM runs WHERE NOT (status IN ('view', 'click') AND created_at < 1705276800)", R)
def jobs_cleanup(spark, sf):
    return C.runs(spark, sf).filter(~(F.col("status").isin("view", "click") & (F.col("created_at") < 1705276800))).select("run_id")


PH = """ev AS (SELECT run_id AS event_id, user_id AS job, created_at AS at_, status AS phase, k FROM runs),
ph AS (SELECT *, sum(n) OVER (PARTITION BY job ORDER BY at_, event_id) AS phase_no FROM (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY job ORDER BY at_, event_id) = phase THEN 0 ELSE 1 END AS n FROM ev))"""


def _events(spark, sf):
    return C.runs(spark, sf).select(F.col("run_id").alias("event_id"), F.col("user_id").alias("job"), F.col("created_at").alias("at"), F.col("status").alias("phase"), "k")


@query("st_phase_state", """SELECT event_id, phase_no, count(*) OVER w AS phase_rows, sum(k) OVER w AS phase_sum, min(at_) OVER w AS phase_started_at FROM ph
  WINDOW w AS (PARTITION BY job, phase_no ORDER BY at_, event_id ROWS UNBOUNDED PRECEDING)""", (C.RUNS, PH))  # fmt: skip
def st_phase_state(spark, sf):
    return O.fold_phases(_events(spark, sf), "job", "at", "phase", "k").select("event_id", "phase_no", "phase_rows", "phase_sum", "phase_started_at")


@query("st_job_state", """SELECT event_id, sum(c) OVER (PARTITION BY job ORDER BY at_, event_id) AS version FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(phase) OVER w <> phase OR lag(k // 10) OVER w <> k // 10 THEN 1 ELSE 0 END AS c FROM ev WINDOW w AS (PARTITION BY job ORDER BY at_, event_id))""", (C.RUNS, PH))
def st_job_state(spark, sf):
    e = _events(spark, sf).withColumn("tens", F.floor(F.col("k") / 10))
    return O.versions(e, "job", "at", ["phase", "tens"]).select("event_id", "version")


@query("st_stall", "SELECT event_id, gap FROM (SELECT event_id, coalesce(lead(at_) OVER (PARTITION BY job ORDER BY at_, event_id), 1706745600) - at_ AS gap FROM ev) WHERE gap >= 36000", (C.RUNS, PH))
def st_stall(spark, sf):
    return O.stalls(_events(spark, sf), "job", "at", 36000, 1706745600).select("event_id", "gap")


@query("coerce_stalled", "SELECT job, CASE WHEN 1706745600 - max(at_) >= 36000 THEN 'error' ELSE arg_max(phase, at_ * 1000000 + event_id) END AS status FROM ev GROUP BY job", (C.RUNS, PH))
def coerce_stalled(spark, sf):
    last = _events(spark, sf).groupBy("job").agg(F.max("at").alias("at"), F.max_by("phase", F.struct("at", "event_id")).alias("phase"))
    return last.select("job", F.when(F.lit(1706745600) - F.col("at") >= 36000, "error").otherwise(F.col("phase")).alias("status"))


STG = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in O.STAGES.items())
def stage_of():
    return F.element_at(F.array(*map(F.lit, sorted(O.STAGES))), (F.col("run_id") % len(O.STAGES) + 1).cast("int"))
PROG = f"""pr AS (SELECT run_id, ([{', '.join(f"'{k}'" for k in sorted(O.STAGES))}])[run_id % {len(O.STAGES)} + 1] AS stage, CASE WHEN run_id % 17 = 0 THEN 'success' ELSE 'processing' END AS status, k % 101 AS stored, (run_id % 8) / 8.0::DOUBLE AS ratio, k FROM runs),
bounds(stage, lo, hi) AS (VALUES {STG})"""


@query("st_progress", """SELECT run_id, CASE WHEN status = 'success' THEN stored WHEN hi <= lo THEN greatest(stored, hi) ELSE least(99, greatest(stored, lo + round_even((hi - lo) * ratio, 0)::INT)) END::INT AS percent FROM pr JOIN bounds USING (stage)""", (C.RUNS, PROG))
def st_progress(spark, sf):
    r = C.runs(spark, sf).withColumn("stage", stage_of())
    status = F.when(F.col("run_id") % 17 == 0, "success").otherwise("processing")
    return r.select("run_id", O.progress(F.col("stage"), status, F.col("k") % 101, (F.col("run_id") % 8) / 8.0).alias("percent"))


@query("elapsed_ratio", "SELECT run_id, round(pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, k / 60.0::DOUBLE)), 0.82::DOUBLE), 6) AS ratio FROM runs", R)
def elapsed_ratio(spark, sf):
    return C.runs(spark, sf).select("run_id", F.round(O.elapsed_ratio(F.col("k"), F.lit(60.0)), 6).alias("ratio"))


@query("agg_conversation_state", """WITH t AS (SELECT session_id, seq, CASE role WHEN 'user' THEN 'document_qa' WHEN 'assistant' THEN 'casual_chat' ELSE 'clarify' END AS mode, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM messages),
f AS (SELECT session_id, min(CASE WHEN mode <> 'casual_chat' AND mode <> 'clarify' THEN n END) AS stop FROM t GROUP BY session_id)
SELECT session_id, arg_min(mode, n) FILTER (mode <> 'clarify') AS last_mode, arg_min(seq, n) FILTER (mode <> 'clarify') AS anchor, count_if(mode = 'casual_chat' AND n < coalesce(stop, 1000000)) AS streak FROM t JOIN f USING (session_id) GROUP BY session_id""", M)  # fmt: skip
def agg_conversation_state(spark, sf):
    mode = F.when(F.col("role") == "user", "document_qa").when(F.col("role") == "assistant", "casual_chat").otherwise("clarify")
    t = C.messages(spark, sf).withColumn("mode", mode)
    n = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))
    t = t.withColumn("n", n)
    stop = F.min(F.when(F.col("mode") == "document_qa", F.col("n"))).over(W.partitionBy("session_id"))
    t = t.withColumn("stop", F.coalesce(stop, F.lit(1_000_000)))
    active = F.when(F.col("mode") != "clarify", F.col("n"))
    return t.groupBy("session_id").agg(F.min_by("mode", active).alias("last_mode"), F.min_by("seq", active).alias("anchor"), F.count_if((F.col("mode") == "casual_chat") & (F.col("n") < F.col("stop"))).alias("streak"))


@query("page_batches", "SELECT id, (row_number() OVER (PARTITION BY source_path ORDER BY id) - 1) // 8 AS batch FROM chunks", (C.CHUNKS,))
def page_batches(spark, sf):
    return O.keep_batches(C.chunks(spark, sf).select("source_path", "id"), "source_path", "id", 8).select("id", "batch")


# one step for each row of a source, the shortest first
BATCHES = r"""sized AS (SELECT source_path, id, greatest(1, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')), ceil(length(text) / 4))::BIGINT AS n FROM chunks),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY n, id) AS rn FROM sized),
steps AS (SELECT source_path, id, n, rn, 0 AS batch, 1 AS held, n AS used FROM ordered WHERE rn = 1
  UNION ALL SELECT o.source_path, o.id, o.n, o.rn, CASE WHEN held >= 16 OR used + o.n > 8192 THEN batch + 1 ELSE batch END, CASE WHEN held >= 16 OR used + o.n > 8192 THEN 1 ELSE held + 1 END, CASE WHEN held >= 16 OR used + o.n > 8192 THEN o.n ELSE used + o.n END
  FROM steps s JOIN ordered o ON o.source_path = s.source_path AND o.rn = s.rn + 1)"""


@query("batch_plan", "SELECT source_path, id, n::INT AS n, batch FROM steps", (C.CHUNKS, BATCHES), recursive=True)
def batch_plan(spark, sf):
    """Rows of a source sorted by length, packed to at most 16 rows and 8,192 tokens a batch."""
    from docloom.functions import text as T
    from docloom.operators.packing import pack

    rows = C.chunks(spark, sf).select("source_path", "id", T.server_tokens("text").alias("n"))
    return pack(rows, "source_path", [F.col("n"), F.col("id")], "n", 8192, most_rows=16).select("source_path", "id", "n", F.col("bundle").cast("int").alias("batch"))


@query("topk_recent_chunks", "SELECT id FROM chunks WHERE is_normalized = 0 AND doc_role = 'guide' ORDER BY uploaded_at DESC, id DESC LIMIT 50", (C.CHUNKS,))
def topk_recent_chunks(spark, sf):
    return C.chunks(spark, sf).filter("is_normalized = 0 AND doc_role = 'guide'").orderBy(F.desc("uploaded_at"), F.desc("id")).limit(50).select("id")


@query("failed_run_filter", "SELECT run_id FROM runs WHERE failure_code = '' AND status <> 'error'", R)
def failed_run_filter(spark, sf):
    return C.runs(spark, sf).filter("failure_code = '' AND status <> 'error'").select("run_id")


@query("validation_summary", "SELECT user_id, status AS validator, count(*) AS n, max(k) AS worst, arg_max(failure_code, created_at * 1000000 + run_id) AS last_issue FROM runs GROUP BY user_id, status", R)
def validation_summary(spark, sf):
    return C.runs(spark, sf).groupBy("user_id", F.col("status").alias("validator")).agg(F.count("*").alias("n"), F.max("k").alias("worst"), F.max_by("failure_code", F.struct("created_at", "run_id")).alias("last_issue"))
