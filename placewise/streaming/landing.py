"""Published snapshots that arrive as files are landed by one stream.

A manifest file names a layer's version, its number of rows and the folder of its table. A version older than or equal
to the current one changes nothing, and a folder with fewer rows than its manifest says replaces nothing (the next
manifest of the version tries again). Of a batch's manifests of a layer, the newest complete version is landed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layers import KeyedTable, current_version, replace_snapshot

MANIFEST = "layer string, version string, rows long, folder string"


def land_published(spark: SparkSession, manifests: str, store: str, checkpoint: str, then: Callable[[], object] | None = None) -> None:
    """Land what has been published since the last call; ``store/<layer>`` holds the versions.

    Versions compare as text, so name them by edit time. The stream's checkpoint remembers manifests that were seen. ``then``
    (such as ``versions.derive_landed``) is part of the batch: if it fails, the next call takes the batch again, in which
    what was landed is left alone and ``then`` is run anew.
    """

    def land(batch: DataFrame, _: int) -> None:
        manifests_of = batch.groupBy("layer").agg(F.sort_array(F.collect_set(F.struct("version", "rows", "folder")), asc=False).alias("m"))
        for layer, found in manifests_of.collect():  # a row per layer, of the manifests since the last call
            have = current_version(spark, f"{store}/{layer}")
            for m in found:  # from new to old
                if have is not None and m["version"] <= have:
                    break
                rows = spark.read.parquet(m["folder"])
                if rows.count() >= m["rows"]:
                    replace_snapshot(spark, rows, f"{store}/{layer}", m["version"])
                    break
        if then is not None:
            then()

    stream = spark.readStream.schema(MANIFEST).json(manifests)
    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_published(spark: SparkSession, deltas: str, held: KeyedTable, checkpoint: str) -> None:
    """Merge the delta files (Parquet, below ``deltas``) that have been published since the last call into the table.

    A batch that was cut short is taken again by the next call; merging it twice is merging it once.
    """
    stream = spark.readStream.schema(held.schema).option("recursiveFileLookup", True).parquet(deltas)
    batches = stream.writeStream.foreachBatch(lambda batch, _: held.merge(batch)).option("checkpointLocation", checkpoint)
    batches.trigger(availableNow=True).start().awaitTermination()
