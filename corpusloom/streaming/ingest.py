"""Ingest stages: the status machine as columns, and a stream that runs arriving files through replace-all writes by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses in order; those that end a source stand apart.
PAPER = ("fetched", "converted", "classified", "extracted", "indexed")
POST = ("fetched", "converted", "classified", "extracted", "indexed")
REPO = ("resolved", "repo_fetched", "classified")
ENDED = ("failed_html", "failed_fetch", "failed_parse", "orphaned")


def ordinal(status: Column, order: tuple[str, ...]) -> Column:
    """Place of a status, -1 for one that ends a source, null for null."""
    return F.when(status.isin(*ENDED), -1).otherwise(F.when(status.isNotNull(), F.array_position(F.array(*map(F.lit, order)), status) - 1))


def can_run(status: Column, target: Column, order: tuple[str, ...]) -> Column:
    """A stage may run where there is no status yet, or one the same or just before; never after one that ends a source."""
    step = ordinal(target, order) - ordinal(status, order)
    return F.when(status.isNull(), True).when(ordinal(status, order) < 0, False).otherwise(step.between(0, 1))


def remaining(status: Column, order: tuple[str, ...]) -> Column:
    """Stages still to run, in order; none after a status that ends a source."""
    place = F.coalesce(ordinal(status, order), F.lit(-2))
    rest = F.slice(F.array(*map(F.lit, order)), F.greatest(place + 2, F.lit(1)).cast("int"), len(order))
    return F.when(place == -1, F.array().cast("array<string>")).otherwise(rest)


def useful(markdown: Column, least: int = 200) -> Column:
    return F.length(F.trim(F.coalesce(markdown, F.lit("")))) >= least


def run_stream(spark: SparkSession, folder: str, schema: str, key: str, transform, out: str, checkpoint: str) -> None:
    """Run all files that have arrived through `transform`, each micro-batch replacing its keys' rows in `out`; call again for later files.

    A batch that is run twice writes the same rows, so a restart after a crash repeats without harm: out/<batch> folders are
    written over, and latest() takes each key's newest batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Rows of each key's newest batch."""
    rows = spark.read.parquet(out).drop("n")
    newest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [key, "batch"]).drop("batch")
