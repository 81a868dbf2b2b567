"""Streaming ingest and delivery: a micro-batch checkpoint is the acknowledgement.

Records land as files; each micro-batch is cut into sub-batches per shard and committed to a sink.  Outcomes are
written before anything is decided by them, so a lost executor never sends a batch again whose outcome is known.  What
fails for now is sent again after a wait, without what is already through; what still fails after the last attempt
ends the query, and the micro-batch is delivered again in full: at least once, as a whole.  It is entered in a ledger
when, and only when, all its outcomes are stored, and a replayed one that the ledger holds does nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drain import RETRY_CEILING_MS, batch_bytes
from ..sources.sinks import Sink

RECORDS = "seq long, conn_id long, shard_id long, tier string, payload binary"


class DeadLettersFull(RuntimeError):
    """A micro-batch is blocked: its dead letters would exceed the cap."""


@dataclass
class Delivery:
    """folder: a shared folder for the tables ledger, delivered and dead_letter, one partition per micro-batch.

    A micro-batch has 1 + ``max_retries`` attempts.  The wait after a failed one is what the sink asked for, or else
    ``base_ms`` doubled each time, and at most five minutes.  Rejected records are dead letters; where those of a
    micro-batch would bring all of them over ``dead_letter_cap`` bytes, it blocks, unless they alone exceed the cap.
    """

    sink: Sink
    folder: str
    max_retries: int = 3
    base_ms: int = 250
    dead_letter_cap: int | None = None
    sleep: Callable[[float], None] = time.sleep

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:  # not written yet
            if "PATH_NOT_FOUND" in str(e):
                return spark.createDataFrame([], schema)
            raise

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "ledger", "shard_id long, records long, batch_size int, epoch long")

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "dead_letter", "shard_id long, seq long, payload binary, reason string, epoch long")

    def _delete(self, spark: SparkSession, path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    def _attempts(self, rows: DataFrame, work: str) -> DataFrame:
        """The final outcome of each record; raises if some are still to be retried after the last attempt."""
        spark, columns = rows.sparkSession, rows.columns
        pending, final = rows, []
        for attempt in range(self.max_retries + 1):
            out = self.sink.commit(pending)
            if "retry_after" not in out.columns:
                out = out.withColumn("retry_after", F.lit(None).cast("int"))
            out.write.parquet(f"{work}/attempt-{attempt}")
            out = spark.read.schema(out.schema).parquet(f"{work}/attempt-{attempt}")
            final.append(out.filter("outcome <> 'retry'"))
            again = out.filter("outcome = 'retry'")
            found = again.agg(F.count("*").alias("n"), F.max("retry_after").alias("hint")).first()
            if not found["n"]:
                done = final[0]
                for more in final[1:]:
                    done = done.unionByName(more)
                return done
            wait = found["hint"] * 1000 if found["hint"] is not None else self.base_ms * 2 ** min(attempt, 30)
            self.sleep(min(wait, RETRY_CEILING_MS) / 1000)
            pending = again.select(*columns)
        raise RuntimeError("the sink failed for now; the micro-batch will be delivered again")

    def _gate(self, dead: DataFrame, epoch: int) -> None:
        if self.dead_letter_cap is None:
            return
        size = lambda df: df.agg(F.coalesce(batch_bytes(F.octet_length("payload")), F.lit(0)).alias("n")).first()["n"]
        new, before = size(dead), size(self.dead_letters(dead.sparkSession).filter(F.col("epoch") != epoch))
        if before + new > self.dead_letter_cap >= new > 0:
            raise DeadLettersFull(f"{before} bytes of dead letters and {new} more exceed {self.dead_letter_cap}; drop or requeue some")

    def process(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = self.ledger(spark).filter(F.col("epoch") == epoch).select("batch_size").limit(1).collect()
        if known:
            if known[0]["batch_size"] != self.sink.max_batch_size:
                raise ValueError("the batch size changed since this micro-batch was delivered: its dedup tokens would differ")
            return
        order = Window.partitionBy("shard_id").orderBy("seq")
        numbered = batch.withColumn("batch_no", F.floor((F.row_number().over(order) - 1) / self.sink.max_batch_size).cast("long"))
        numbered = numbered.withColumn("epoch", F.lit(epoch).cast("long"))
        work = f"{self.folder}/_work/{epoch}-{uuid.uuid4().hex[:12]}"
        numbered.write.parquet(f"{work}/batch")
        try:
            outcome = self._attempts(spark.read.schema(numbered.schema).parquet(f"{work}/batch"), work)
            dead = outcome.filter("outcome = 'rejected'").select("shard_id", "seq", "payload", "reason")
            self._gate(dead, epoch)
            done = outcome.groupBy("shard_id").agg(F.count("*").alias("records")).withColumn("batch_size", F.lit(self.sink.max_batch_size))
            delivered = outcome.filter("outcome = 'committed'").select("shard_id", "batch_no", "seq")
            for name, table in (("delivered", delivered), ("dead_letter", dead), ("ledger", done)):  # the ledger is last
                table.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")
        finally:
            self._delete(spark, work)

    def drop_dead_letters(self, spark: SparkSession, *, before_epoch: int, dry_run: bool = True) -> list[int]:
        """The epochs below a bound whose dead letters go; nothing is deleted in a dry run, and only what the ledger
        holds goes."""
        held = self.ledger(spark).filter(F.col("epoch") < before_epoch).select("epoch").distinct()
        epochs = [r["epoch"] for r in self.dead_letters(spark).select("epoch").distinct().join(held, "epoch").orderBy("epoch").collect()]  # one per micro-batch
        for epoch in [] if dry_run else epochs:
            self._delete(spark, f"{self.folder}/dead_letter/epoch={epoch}")
        return epochs

    def start(self, spark: SparkSession, landing: str, checkpoint: str, *, files_per_trigger: int = 100, available_now: bool = False, before: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
        """Deliver what lands in a folder of record files; files_per_trigger is the back-pressure."""
        stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
        writer = (before(stream) if before else stream).writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def recover_then_deliver(spark: SparkSession, sealed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Segments that a restart has to replay before the stream goes on: the checkpoint doesn't know outside files."""
    from ..operators.recovery import unconfirmed

    return unconfirmed(sealed, confirmed).orderBy("shard_id", "seg_no")


def windowed_acks(records: DataFrame, time_col: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Records per tier and event-time window, for streams with a time column; late rows are dropped by watermark."""
    timed = records.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, window).alias("w"), "tier").agg(F.count("*").alias("n")).select("w.start", "w.end", "tier", "n")
