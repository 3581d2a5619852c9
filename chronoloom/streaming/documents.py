"""Documents as a stream: the stages that look at one document at a time, on unbounded input.

A document is one row, so no state is kept across rows. Stages over the tag table run a
batch at a time with the batch's documents, each whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotate import annotate
from ..plans.pipeline import Options, run

DOCUMENTS = "doc_id long, text string, dct date"


def read(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """JSON documents that appear in a folder."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def annotated(stream: DataFrame) -> DataFrame:
    """Tags of a stream of documents, as a stream."""
    return annotate(stream)


def write_linked(stream: DataFrame, path: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Run the whole pipeline on each batch and write its tags under `path/batch=n`, so that a batch done again replaces itself."""

    def one(batch: DataFrame, n: int) -> None:
        run(batch, options).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
