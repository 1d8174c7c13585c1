"""Streaming scoring (V3): a fitted model applied to a stream of documents.

Scoring is stateless per document, so no watermark or state store is
needed. Each micro-batch is scored by the same plan as batch scoring
(``foreachBatch``; for models within the broadcast limit it is map-only) and
appended to a parquet sink. Any saved model serves; it is loaded once and
its tables are read from the shared folder. The stream's
checkpoint and output live under the shared checkpoint folder, so a restart
resumes where it stopped and a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlens.operators.persist import load_model
from textlens.session import scratch_path


def score_stream(spark: SparkSession, source: DataFrame, model_path: str, out_path: str | None = None,
                 checkpoint: str | None = None, ids: list[str] = ("doc_id",), text_col: str = "text",
                 available_now: bool = True, interval: str | None = None) -> tuple[str, object]:
    """Start the scoring stream; returns ``(out_path, query)``. Output is
    parquet under ``out_path/epoch=<id>`` (read ``out_path`` as one table).

    With ``available_now`` the query processes what is there and stops
    (wait with ``query.awaitTermination()``); else it goes on, with a batch
    every ``interval`` (as soon as the last one is done, if not given).
    """
    ids = list(ids)
    model = load_model(spark, model_path)
    out_path = out_path or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")

    def score_batch(batch: DataFrame, epoch_id: int) -> None:
        # one folder per epoch, overwritten: a micro-batch re-run after a
        # failure replaces its own output instead of appending duplicates
        pred = model.predict(batch.select(*ids, text_col), ids=ids, text_col=text_col)
        pred.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch_id}")

    writer = source.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    if available_now or interval:
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return out_path, writer.start()


def document_stream(spark: SparkSession, base: str, table: str = "documents",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one parquet table of ``base``, a file or a folder of
    files (schema from the batch reader); ``max_files_per_trigger`` bounds a
    micro-batch, by default it takes whatever is new."""
    whole = f"{base.rstrip('/')}/{table}.parquet"
    known = spark.read.parquet(whole)
    reader = spark.readStream.schema(known.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = known.select("_metadata.file_path").limit(1).collect()
    if files and files[0][0].rstrip("/").endswith(f"/{table}.parquet"):  # one file
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(base)
    return reader.parquet(whole)
