"""Beyond batch: chunks that arrive as a stream go into the vector table, document by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import write_index


def follow(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Embeds each micro-batch and replaces its documents in the table; a batch that is repeated changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write_index(embed(batch), path)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
