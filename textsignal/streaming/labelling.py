"""The label job on new files as they arrive.

All of its steps work row by row, so the batch functions run unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textsignal.operators import label
from textsignal.sources.tables import COMMENTS


def label_new_files(spark: SparkSession, comments: str, out: str, progress: str) -> StreamingQuery:
    """Label every comment file that ``progress`` does not list yet, then stop."""
    stream = spark.readStream.schema(COMMENTS).parquet(comments)
    labelled = label.weak_label(label.candidates(stream)).withColumn(
        "subreddit_type", label.community_type(F.col("subreddit"))
    )
    return (
        labelled.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
