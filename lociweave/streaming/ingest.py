"""Genomes that arrive as a stream: each micro-batch adds to the stored members and edges, which are unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, matrix


def start(genes: DataFrame, members_path: str, edges_path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of (genome, contig, ix, cluster) rows; a contig arrives whole. A batch that is tried again overwrites its own part."""

    def add(batch: DataFrame, batch_id: int) -> None:
        matrix.presence(batch).write.mode("overwrite").parquet(f"{members_path}/batch={batch_id}")
        graph.edge_members(batch).write.mode("overwrite").parquet(f"{edges_path}/batch={batch_id}")

    return genes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, members_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """The graph so far: equal memberships of several batches count once."""
    m = spark.read.parquet(members_path).select("cluster", "genome").distinct()
    return m, spark.read.parquet(edges_path).select("a", "b", "genome").distinct()
