"""Questions as a stream against the static index: guard, retrieval and answer for every micro-batch.

Ranking needs windows, which a streaming DataFrame does not allow, so it runs inside foreachBatch. Each batch asks for the
index anew, so an index that was replaced meanwhile is used from the next batch on. A batch that is run again after a
failure overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def serve(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that writes answer(batch) below ``out``, a folder for each batch. once: what is there now, then end."""
    def each(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
