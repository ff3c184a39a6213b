"""The Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Setting: partitions into which ``dealt`` shuffles tables. Unset, which it is unless someone sets it, nothing is shuffled.
DEAL = "tidemark.deal"


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for costly work on each row, read where they lie, whatever their size.

    Files of one row group make one task each. Where all data are a few such files, as in a bench, the setting DEAL deals their rows out.
    """
    found = table(spark, sf_dir, name).select(*columns)
    parts = spark.conf.get(DEAL, None)
    return found.repartition(int(parts)) if parts else found


def stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """The same as a stream of its files."""
    # A pattern, as the source takes a folder or a pattern, and the table may be a single file.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).options(**options).parquet(f"{sf_dir}/{name}.parque[t]")
