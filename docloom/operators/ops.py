"""Operations: retention, log analytics, job progress and stalls, classification of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T


def prune(rows: DataFrame, id_col: str, at: str, expire_before: int = 0, max_rows: int = 0, batch: int = 1000) -> DataFrame:
    """Adds removed: the oldest expired rows (at most batch), then the oldest of what is left beyond max_rows (at most batch).

    Ranks come from sorts that keep only a batch, so no window holds the table.
    """
    gone = rows.limit(0).select(id_col)
    if expire_before > 0:
        gone = rows.filter(F.col(at) < expire_before).orderBy(at, id_col).limit(batch).select(id_col)
    left = rows.join(gone, id_col, "left_anti")
    if max_rows > 0:
        over = min(batch, max(0, left.count() - max_rows))
        gone = gone.unionByName(left.orderBy(at, id_col).limit(over).select(id_col))
    return rows.join(gone.withColumn("removed", F.lit(True)), id_col, "left").na.fill(False, ["removed"])


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")


def histogram(rows: DataFrame, value: Column, kind: str, most: int) -> DataFrame:
    """kind, value, n of the commonest values (then by name)."""
    c = rows.select(value.alias("value")).filter(F.coalesce("value", F.lit("")) != "").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "value").limit(most).select(F.lit(kind).alias("kind"), "value", "n")


# fixed values: ordered rules (all words of a group in the lower-case text) to failure codes
FAILURES = (
    ((("tool_calls_limit",), ("tool calls limit",)), "answer_tool_budget_exhausted"),
    ((("파일 형식이 올바르지",), ("공간 이름 형식이 올바르지",)), "upload_validation_fail"),
    ((("파일 크기", "초과"), ("too large",)), "upload_size_limit"),
    ((("queue", "upload"),), "upload_queue_full"),
    ((("paddleocr-vl 로더를 불러오지 못했습니다",), ("paddleocr", "module"), ("paddleocr", "설치")), "ocr_runtime_missing"),
    ((("paddleocr-vl 모델 로딩 실패",),), "ocr_model_load_fail"),
    ((("paddleocr-vl pdf 인식 실패",), ("pdf", "ocr")), "ocr_inference_fail"),
    ((("pymupdf 로더를 불러오지 못했습니다",),), "pdf_text_runtime_missing"),
    ((("pymupdf pdf 추출 실패",),), "pdf_text_extract_fail"),
    ((("pdf 결과에서 추출 가능한 텍스트를 찾지 못했습니다",),), "pdf_extract_empty"),
    ((("embedding_provider=api requires embedding_api_url",),), "embedding_config_fail"),
    ((("failed to initialize remote embedding provider",),), "embedding_provider_fail"),
    ((("could not load embedding model",),), "embedding_model_load_fail"),
    ((("llama-server runtime",), ("llm model file not found",)), "llm_runtime_fail"),
    ((("context", "token"), ("context", "maximum"), ("context", "available"), ("context", "size")), "context_overflow"),
)
OCR_FAILURES = (
    ((("resourceexhaustederror",), ("out of memory error on gpu",), ("cuda out of memory",), ("memoryerror", "gpu")), "gpu_oom"),
    ((("cannot init gpu",), ("failed to initialize gpu",), ("gpu is not available",), ("cuda driver version is insufficient",), ("gpu device", "not found"), ("cannot set device",)), "gpu_init_fail"),
    ((("no kernel image is available for execution on the device",),), "gpu_kernel_incompatible"),
)


def by_rules(c, rules, default: str, exception: Column | None = None) -> Column:
    """Code of the first rule one of whose word groups stands in the text; then of the exception's name; else the default."""
    t = F.lower(F.trim(T.text(c)))
    out = F.lit(default)
    if exception is not None:
        for name, code in (("permissionerror", "file_permission_fail"), ("filenotfounderror", "file_not_found"), ("modulenotfounderror", "runtime_import_missing")):
            out = F.when(F.lower(exception) == name, code).otherwise(out)
    for groups, code in reversed(rules):
        hit = F.lit(False)
        for words in groups:
            own = F.lit(True)
            for w in words:
                own = own & t.contains(w)
            hit = hit | own
        out = F.when(hit, code).otherwise(out)
    return F.when(t == "", default).otherwise(out)


# fixed values: percent range of each upload stage
STAGES = {
    "queued": (0, 4), "preparing": (5, 9), "prepare_kb": (10, 16), "inspect_file": (12, 17), "check_cache": (18, 27), "cache_hit": (36, 45), "read_text": (30, 41), "split_text": (42, 49), "chunk_text": (54, 61),
    "read_sheet": (30, 47), "chunk_sheet": (48, 61), "inspect_pdf": (28, 33), "extract_pdf_text": (34, 41), "fallback_pdf_ocr": (38, 45), "load_pdf_ocr_model": (42, 48), "run_pdf_ocr": (49, 76), "merge_pdf_ocr": (77, 84),
    "release_pdf_ocr_worker": (85, 86), "chunk_pdf": (85, 92), "prepare_pdf_chunks": (85, 92), "store_cache": (93, 94), "store_ocr_cache": (93, 94), "persist_meta": (95, 96), "store_chunks": (96, 98),
    "refresh_index": (99, 99), "embed_chunks": (99, 99), "embed_concepts": (99, 99), "sync_derived_concept_embedding": (99, 99), "sync_derived": (99, 99), "done": (100, 100),
}
FINAL = ("success", "error", "not_found")


def elapsed_ratio(elapsed: Column, expected: Column) -> Column:
    """Share of the expected time, bent by a power of 0.82."""
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), elapsed / F.greatest(expected, F.lit(1.0)))), 0.82)


def progress(stage: Column, status: Column, stored: Column, ratio: Column) -> Column:
    """Percent shown: the stage's range at ratio, never under the stored one, 99 at most until the job ends. Half goes to even."""
    lower = F.coalesce(F.create_map(*[F.lit(x) for k, (a, _) in STAGES.items() for x in (k, a)])[F.lower(stage)], F.lit(-1))
    upper = F.create_map(*[F.lit(x) for k, (_, b) in STAGES.items() for x in (k, b)])[F.lower(stage)]
    kept = F.least(F.greatest(stored, F.lit(0)), F.lit(100))
    value = F.greatest(kept, lower + F.bround((upper - lower) * ratio).cast("int"))
    return F.when(status.isin(*FINAL) | (lower < 0), kept).when(upper <= lower, F.greatest(kept, upper)).otherwise(F.least(value, F.lit(99)))


def fold_phases(events: DataFrame, key: str, at: str, phase: str, count: str) -> DataFrame:
    """Adds phase_no and the counters of the running phase: rows so far, sum of count, start, heartbeats; they start anew when the phase changes."""
    w = W.partitionBy(key).orderBy(at, "event_id")
    rows = events.withColumn("__new", F.coalesce((F.col(phase) != F.lag(phase).over(w)).cast("int"), F.lit(1))).withColumn("phase_no", F.sum("__new").over(w)).drop("__new")
    run = W.partitionBy(key, "phase_no").orderBy(at, "event_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("phase_rows", F.count(F.lit(1)).over(run)).withColumn("phase_sum", F.sum(count).over(run)).withColumn("phase_started_at", F.min(at).over(run))


def versions(events: DataFrame, key: str, at: str, snapshot: list[str]) -> DataFrame:
    """Adds version: grows only where the public snapshot of the job changes."""
    w = W.partitionBy(key).orderBy(at, "event_id")
    changed = F.lit(False)
    for c in snapshot:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return events.withColumn("__c", F.when(F.row_number().over(w) == 1, 1).otherwise(changed.cast("int"))).withColumn("version", F.sum("__c").over(w)).drop("__c")


def stalls(events: DataFrame, key: str, at: str, least: int, end: int) -> DataFrame:
    """Events after which a job gave no sign for ``least`` seconds (until the next one, or end)."""
    w = W.partitionBy(key).orderBy(at, "event_id")
    return events.withColumn("gap", F.coalesce(F.lead(at).over(w), F.lit(end)) - F.col(at)).filter(F.col("gap") >= least)


def nearest_rank(values: str, p: float) -> Column:
    """The percentile that is one of the values: nearest rank."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {values})")


def keep_batches(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """Adds batch: fixed batches of ``size`` rows in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(part).orderBy(order)) - 1) / size))
