"""Files that arrive: each batch goes through the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tamarack.plans.corpus import Corpus, Options, analyse


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Corpus, int], None], options: Options = Options()) -> StreamingQuery:
    """Analyses each batch of Parquet rows ``path, text`` that arrive in ``folder`` and gives the result to ``sink``."""

    def batch(sources: DataFrame, number: int) -> None:
        sink(analyse(sources, options), number)

    stream = spark.readStream.schema("path string, text string").parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
