"""A codebook that follows a stream: one step of the running update for each micro-batch, each step a version of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators import vq
from helixframe.sources import sinks


def stepped(state: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, decay: float) -> DataFrame:
    """The state (code, dim, ema_count, ema_sum, value, hit) after one batch of vectors, which get the codes of the state's book."""
    book = state.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector"))
    codes = book.count()
    assigned = vectors.join(vq.nearest_code(vectors, book, id_col, vector_col).select(F.col(id_col).alias("__id"), "code"), F.col(id_col).eqNullSafe(F.col("__id")))
    counts = vq.code_histogram(assigned.select("code"), codes)
    return vq.ema_update(state.drop("value"), counts, vq.vector_sums(assigned, vector_col), decay).select("code", "dim", "ema_count", "ema_sum", "value", "hit")


def follow(stream: DataFrame, first: DataFrame, path: str, checkpoint: str, id_col: str, vector_col: str, decay: float, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Runs the stream's batches through stepped(), from the last version under path, or from first where there is none.

    Version n + 1 is the state after batch n and appears in one piece. A batch that comes again after a failure finds its version there
    and changes nothing; one that failed before that starts from the version before it. after: called once a batch's version stands.
    """
    spark = stream.sparkSession
    if sinks.last_step(spark, path) is None:
        sinks.write_state(first, path, 0)

    def one(batch: DataFrame, batch_id: int) -> None:
        session: SparkSession = batch.sparkSession
        sinks.drop_incomplete(session, path)
        if (sinks.last_step(session, path) or 0) <= batch_id:
            state = sinks.read_step(session, path, batch_id)
            rows = batch.select(id_col, vector_col).persist()
            try:
                sinks.write_state(stepped(state, rows, id_col, vector_col, decay), path, batch_id + 1)
            finally:
                rows.unpersist()
        if after:
            after(batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
