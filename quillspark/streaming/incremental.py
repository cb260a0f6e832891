"""Incremental build: each micro-batch of a stream of documents becomes a shard of the index. Statistics are sums over shards, so BM25 stays global."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.index import Field, shards, write


def index_stream(docs: DataFrame, root: str, fields: list[Field], checkpoint: str, **trigger) -> StreamingQuery:
    """docs: a streaming frame (doc_id, columns of fields). Batch ids name shards, so a batch that is run again after it was published is passed over, and one that failed before left nothing."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        name = f"b{batch_id}"
        if not rows.isEmpty() and name not in shards(rows.sparkSession, root):
            write(rows, root, fields, name)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
