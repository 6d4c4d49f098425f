"""H4: the prompt gate as an incremental stream, with progress every N prompts.

File source (new prompt files are picked up as they land, ``maxFilesPerTrigger``
bounds each micro-batch) → per micro-batch the batch gate of ``gate.py``
against the static word list → parquet sink, one directory per batch id
written with overwrite, so a replayed batch after a failure is idempotent.

Each status counts its own prompts over the whole stream: a prompt's
``position`` goes on from the totals of the batch before, and every ``every``
positions are one ``progress`` step, whatever files or batches they came in. The totals
are a table of one row per status and batch beside the sink; a replayed batch reads
those of its predecessor again, so it gives the same positions and writes nothing twice.
Positions inside a batch come from the bucketed index (E1): no status is one task.
Progress lives in the checkpoint folder and the totals, on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.operators.gate import flag_prompts
from tokenmill.operators.order import global_index
from tokenmill.session import cut_lineage

_TOTALS = "status string, total long"


def _totals_path(sink_dir: str, batch_id: int) -> str:
    return f"{sink_dir.rstrip('/')}-totals/batch_id={batch_id}"


def write_gate_batch(batch: DataFrame, batch_id: int, words: DataFrame, sink_dir: str, key: str, text: str = "text",
                     every: int = 32) -> None:
    """Flag one micro-batch and write it with its positions, then the totals after it.

    ``key`` is unique in the batch. An empty batch carries the totals on.
    """
    spark = batch.sparkSession
    before = spark.read.schema(_TOTALS).parquet(_totals_path(sink_dir, batch_id - 1)) if batch_id \
        else spark.createDataFrame([], _TOTALS)
    flagged = cut_lineage(flag_prompts(batch.select(key, text), words, key, text))     # read twice by the index
    rows = (global_index(flagged, [key], seed=batch_id, by=["status"], idx_col="position")
            .join(F.broadcast(before), "status", "left")       # one row per status
            .withColumn("position", F.col("position") + F.coalesce("total", F.lit(0))).drop("total")
            .withColumn("progress", F.floor(F.col("position") / every)))
    path = f"{sink_dir}/batch_id={batch_id}"
    rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(path)
    after = spark.read.parquet(path).groupBy("status").agg((F.max("position") + 1).alias("total"))
    (after.unionByName(before).groupBy("status").agg(F.max("total").alias("total")).coalesce(1)
     .write.mode("overwrite").parquet(_totals_path(sink_dir, batch_id)))


def start_gate_stream(spark: SparkSession, source_dir: str, schema, word_list: DataFrame,
                      sink_dir: str, checkpoint_dir: str, key: str, text: str = "text",
                      max_files_per_trigger: int = 1, available_now: bool = True, every: int = 32):
    words = word_list.select("word").distinct()

    def per_batch(batch: DataFrame, batch_id: int):
        write_gate_batch(batch, batch_id, words, sink_dir, key, text, every)

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("pathGlobFilter", "*.parquet").parquet(source_dir))
    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_gate_sink(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)


def gate_progress(sink: DataFrame, every: int = 32) -> DataFrame:
    """The progress steps of each status: prompts in it, and whether it is full."""
    return sink.groupBy("status", "progress").agg(F.count(F.lit(1)).alias("n_prompts")) \
        .withColumn("full", F.col("n_prompts") == every)
