"""Streams over parsed elements, job updates, tokens, quota requests and records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docframe.functions.text import strip
from docframe.operators import chunking as ck
from docframe.operators import cleaning as cl
from docframe.operators import index as ix
from docframe.operators import quotas as qt
from docframe.operators import visuals as vs
from docframe.operators.guardrails import redact_secrets, sanitize_html
from docframe.session import materialize
from docframe.sources.versioned import DocumentStore, committed


def ingested(
    elements: DataFrame, config: ck.ChunkingConfig | None = None, model: Callable | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Papers of a batch of elements, and their tables: cleaned, structured, chunked and, with a
    ``model``, embedded (T1). ``papers`` has the outcome of each; one without any usable text failed."""
    elements = materialize(elements)
    papers = elements.select("paper_id").distinct()
    audit = materialize(cl.audit_elements(elements))
    kept = cl.kept_elements(audit)
    visuals = materialize(vs.describe_visuals(elements))
    chunks = ck.link_parents(ck.chunk(kept, visuals, config))
    outcome = cl.cleaning_statistics(audit).selectExpr(
        "paper_id", "IF(kept_for_text = 0, 'failed', 'completed') AS status", "IF(kept_for_text = 0, 'no usable text', NULL) AS error"
    )
    tables = {
        "sections": cl.build_sections(elements), "elements": kept, "visuals": visuals,
        "chunks": ix.embed(chunks, model) if model else chunks, "papers": outcome,
    }
    return papers, tables


def ingest_stream(
    elements: DataFrame, root: str, checkpoint: str, config: ck.ChunkingConfig | None = None, model: Callable | None = None
) -> DataStreamWriter:
    """Stream of parsed elements into a ``DocumentStore`` below ``root`` (T1). A paper's elements
    must arrive in one batch. All tables of a batch count at once; a batch that is repeated
    after a failure changes nothing."""
    store = DocumentStore(root, elements.sparkSession)
    return elements.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        committed(store, lambda batch: ingested(batch, config, model))
    )


def job_progress_stream(updates: DataFrame) -> DataFrame:
    """Latest state per job, for update mode."""
    return updates.groupBy("job_id").agg(
        F.expr("max(struct(updated_at, update_id, status, progress)) AS s")
    ).selectExpr("job_id", "s.status AS status", "s.progress AS progress", "s.updated_at AS updated_at")


def guard_stream(tokens: DataFrame, column: str = "content", secrets: Sequence[str] = ()) -> DataFrame:
    """Redacted and sanitised tokens."""
    safe = sanitize_html(redact_secrets(column, secrets))
    return tokens.selectExpr(*[f"{safe} AS `{c}`" if c == column else f"`{c}`" for c in tokens.columns])


def admit_batches(
    requests: DataFrame, state: str, out: str, checkpoint: str, limits: qt.Limits = qt.Limits()
) -> DataStreamWriter:
    """Quota decisions on a stream, batch by batch (T4); ``quota_state.admit_stream`` keeps the
    counters as keyed state instead.

    Each batch is decided by the batch operator, which stays even when one session holds a
    third of the requests. Session counters live in a table per batch below ``state``; a
    repeated batch starts from the same version and writes the same one. A session ends a
    fixed time after its first request; it stays in the table, so that later requests are
    refused as expired and do not open it anew.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch)
        fresh = qt.open_sessions(batch, limits)
        if batch_id:
            known = spark.read.parquet(f"{state}/v={batch_id - 1}")
            fresh = known.unionByName(fresh.join(known, "session_id", "left_anti"))
        fresh = materialize(fresh)
        decided = materialize(qt.admit(batch, fresh, limits))
        decided.write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        qt.charge(fresh, decided).write.mode("overwrite").parquet(f"{state}/v={batch_id}")

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(decide)


def dedupe_stream(records: DataFrame, event_time: str, delay: str, identity: str | None = None) -> DataFrame:
    """First record per identity within the watermark (T5); the watermark bounds the state."""
    key = identity or strip("lower(coalesce(nullif(doi, ''), nullif(arxiv_id, ''), title))")
    marked = records.withColumn("identity", F.expr(key)).withWatermark(event_time, delay)
    return marked.dropDuplicatesWithinWatermark(["identity"])


def run_once(writer: DataStreamWriter, after: Callable[[], DataFrame] | None = None) -> DataFrame | None:
    """Process everything available and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
    return after() if after else None
