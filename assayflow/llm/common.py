"""What the operators of this package share: word rules, written tables, and input guards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

#: White space of the word rule, as a character class and as the characters themselves.
BLANK = "[ \\t-\\r]"
BLANKS = " \t\n\x0b\x0c\r"
#: Spark's setting by which a query deletes its shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters that are no white space, in order."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; plain ASCII takes the quick way, which gives the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class Written:
    """Tables written once in the shared folder and read again; they cut lineage and outlive executors.

    With ``tidy`` the shuffle files of a step go when its table is written, not when the driver next collects its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark, self.folder, self.tidy = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}", tidy

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and return the written table; the schema is taken over, not read from the files."""
        path = f"{self.folder}/{name}"
        before = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            frame.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
