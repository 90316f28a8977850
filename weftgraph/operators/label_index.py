"""A dictionary of labels for search by prefix: files sorted by label, of which a search reads those whose bounds fit.

The labels of each type, once, are dealt by ranges of (folded label, type, label), so a label that many nodes have is one
row and a prefix that many labels have lies in files next to each other. Beside them is a table of bounds, a row for each
file. A search reads the bounds, then the files that can hold the prefix, whatever the size of the others.

Defined results: nodes without label or type are left out; the empty prefix finds all; case is folded alike in labels
and prefixes; an index of no labels finds nothing. Columns but element_type and label aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "folded string, element_type string, label string"
BOUNDS = "file string, low string, high string, n long"


def build(nodes: DataFrame, path: str, files: int | None = None) -> LabelIndex:
    """The index of ``nodes`` at ``path``, in some ``files`` (as many as the session shuffles to, if not told)."""
    spark, order = nodes.sparkSession, ["folded", "element_type", "label"]
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.where("label IS NOT NULL AND element_type IS NOT NULL").select(F.lower("label").alias("folded"), "element_type", "label").distinct()
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/labels")
    written = spark.read.schema(ROWS).parquet(f"{path}/labels")
    bounds = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("folded").alias("low"), F.max("folded").alias("high"), F.count("*").alias("n"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")  # a row for each file
    return LabelIndex(spark, path)


class LabelIndex:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def files(self, prefix: str) -> list[str]:
        """The files that can hold labels with this prefix."""
        start = F.lower(F.lit(prefix))
        fits = (F.col("high") >= start) & ((F.col("low") <= start) | F.startswith("low", start))
        return sorted(r["file"] for r in self.spark.read.schema(BOUNDS).parquet(f"{self.path}/bounds").where(fits).select("file").collect())

    def find(self, prefix: str) -> DataFrame:
        """element_type, label: the labels that begin so, whatever their case."""
        files = self.files(prefix)
        if not files:
            return self.spark.createDataFrame([], ROWS).drop("folded")
        return self.spark.read.schema(ROWS).parquet(*files).where(F.startswith("folded", F.lower(F.lit(prefix)))).select("element_type", "label")

    def search(self, prefix: str) -> DataFrame:
        """The labels that begin so by element type, as ``facets.search`` gives them."""
        return self.find(prefix).groupBy("element_type").agg(F.array_sort(F.collect_set("label")).alias("labels"))
