"""Chromosome density over a stream of variants: the batch operator's plan, kept up to date as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import chrom_density


def stream_density(variants: DataFrame, name: str, checkpoint: str, step: int = 1_000_000) -> StreamingQuery:
    """Starts a query that keeps counts in the in-memory table of this name; state lives in the checkpoint folder."""
    return chrom_density(variants, step=step).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
