"""An extension: the same findings over texts as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prosewell.operators import lint


def watch(texts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs all rules over each micro-batch of (doc_id, text); ``sink`` gets the findings and the batch's number."""

    def batch(docs: DataFrame, number: int) -> None:
        sink(lint.lint(docs), number)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
