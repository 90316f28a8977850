"""Continuous intake of N-Quads files: new files of a directory become rows of the quad table of their graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.sources.store import parse_lines
from weftgraph.sources.turtle import QUAD


def quads_of(table_path: str, spark: SparkSession) -> DataFrame:
    """The quads taken in so far. Batches append; a graph is a set, so repeats are dropped on reading."""
    return spark.read.schema(QUAD).parquet(table_path).select(*[c.split()[0] for c in QUAD.split(", ")]).dropDuplicates()


def start(spark: SparkSession, directory: str, table_path: str, checkpoint: str, graph: str, once: bool = False) -> StreamingQuery:
    """Take in the files of ``directory``, those there and, unless ``once``, those to come.

    A batch that runs again after a failure overwrites what it had written: its part of the
    table is named after it. Assembly stays a batch job over the table.
    """
    lines = spark.readStream.text(directory)
    quads = parse_lines(lines, graph)

    def keep(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = quads.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def counts_by_graph(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count("*").alias("n"))
