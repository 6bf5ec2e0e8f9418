"""New genes assigned to known groups as they come: a stream of sequences against a profile index, merged by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cladeforge.operators import profiles, similarity


def assign_batch(genes: DataFrame, index: DataFrame, pieces, least: int = 3) -> DataFrame:
    """(gene, og, hit_sp) of the closest profile gene's group. ``genes``: gene, seq; ``index``: ``profiles.profile_index``."""
    return similarity.assign(profiles.profile_hits(genes, index, pieces, least))


def assign_stream(genes: DataFrame, index: DataFrame, pieces, path: str, checkpoint: str, least: int = 3) -> StreamingQuery:
    """Append each batch's assignments to ``path``/batch=<n>; a batch that runs again replaces its own folder. A gene's rows must come in one batch."""

    def put(batch: DataFrame, n: int) -> None:
        assign_batch(batch, index, pieces, least).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return genes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
