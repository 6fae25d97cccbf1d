"""Agent heartbeats as a stream (H-1): the newest status of each agent is kept as keyed state.

The state is a streaming aggregate (the greatest beat by time and event id), so beats may come late, out of order or
repeatedly, in any cut into micro-batches, and there is no watermark: nothing is dropped as late, and state grows with the
agents, not the beats.  Each micro-batch writes the agents whose state it touched below its own number; a repeated
micro-batch rewrites what it wrote.  ``agent_states`` gives the newest row of each agent and tells which agents are silent:
those whose newest beat is more than ``silent_after`` behind the newest beat of all.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.operators.ranking import latest_per_key

BEAT = "agent_id string, status string, created_at timestamp_ntz, event_id long"
SILENT_AFTER = dt.timedelta(days=1)


def run_heartbeats(spark: SparkSession, landing: str, out: str, checkpoint: str, max_files_per_trigger: int = 10_000) -> None:
    """Drains the landing folder (Parquet files of ``BEAT``); state and progress live in the checkpoint, in the shared folder."""
    beats = spark.readStream.schema(BEAT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_trigger).parquet(landing)
    newest = F.max(F.struct("created_at", "event_id", "status")).alias("newest")
    states = beats.filter("agent_id IS NOT NULL AND created_at IS NOT NULL").groupBy("agent_id").agg(newest)

    def put(changed: DataFrame, batch_id: int) -> None:
        changed.select("agent_id", "newest.*").write.mode("overwrite").parquet(f"{out.rstrip('/')}/step={batch_id}")

    q = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def agent_states(spark: SparkSession, out: str, silent_after: dt.timedelta = SILENT_AFTER) -> DataFrame:
    """(agent_id, status, created_at, silent), one row for each agent."""
    changes = spark.read.schema(BEAT).parquet(out)
    clock = F.lit(changes.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    newest = latest_per_key(changes, ["agent_id"], ["created_at", "event_id"])
    return newest.select("agent_id", "status", "created_at", (clock - F.col("created_at") > F.lit(silent_after)).alias("silent"))
