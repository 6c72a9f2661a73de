"""Continuous ingest of a folder: each micro-batch of new files is one upsert.

A batch that is run again after a failure finds its blocks unchanged and writes
none twice, as blocks are told apart by fingerprint; the checkpoint of the query
takes the place of a job registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.embedding import Provider
from docloom.operators.transcribe import Transcriber
from docloom.plans import ingest
from docloom.sources import files as S

#: Finished jobs that are kept.
KEEP = 200


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, reports: str, provider: Provider | None = None, per_batch: int = 200, available_now: bool = True, transcriber: Transcriber | None = None) -> StreamingQuery:
    """Starts the query: files of ``folder`` into the snapshots at ``target``, report rows to ``reports``."""
    stream = spark.readStream.format("binaryFile").schema(S.FILES).option("maxFilesPerTrigger", per_batch).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        found = S.detected(S.with_names(rows))
        done = ingest.ingest_blocks(ingest.file_blocks(found), target, F.current_timestamp(), provider, found=found, transcriber=transcriber)
        done.withColumns({"batch": F.lit(number), "enqueued_at": F.current_timestamp()}).write.mode("overwrite").parquet(f"{reports}/batch={number:09d}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def jobs(spark: SparkSession, reports: str, keep: int = KEEP) -> DataFrame:
    """The reports, newest first, without the finished ones beyond the newest ``keep`` of them; see :func:`retained`."""
    rows = spark.read.option("basePath", reports).parquet(f"{reports}/batch=*")
    return retained(rows, F.lit(True), "enqueued_at", "source_file", keep).orderBy(F.desc("enqueued_at"), "source_file")


def retained(rows: DataFrame, finished: Column, at: str, key: str, keep: int = KEEP) -> DataFrame:
    """All jobs that have not finished, and of the finished ones the newest ``keep``.

    The limit picks them by partial sorts, so no task sees all jobs.
    """
    done = F.coalesce(finished, F.lit(False))
    return rows.where(~done).unionByName(rows.where(done).orderBy(F.desc(at), key).limit(keep))
