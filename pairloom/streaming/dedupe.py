"""Evidence de-duplication across the batches of a stream.

The state holds one key per (record, content). A record that comes again with the same
content is dropped in whatever batch it comes; other content under the same key passes
once, so that ``collisions`` finds it in the table that the stream wrote, as the batch
operator would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.keys import UNIT_SEPARATOR

CONTENT = "content_sha256"

#: Keys are kept in RocksDB, on disk, and a batch writes what it changed. The default store has
#: all of them in memory and copies them at every batch.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def with_content(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add a digest of the named columns; null, blank and shifted cells all differ."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    cells = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]
    return rows.withColumn(CONTENT, F.sha2(F.concat_ws(UNIT_SEPARATOR, *cells), 256))


def first_sightings(
    rows: DataFrame, key: Sequence[str], columns: Sequence[str], event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """The rows of a stream whose (key, content) was not seen before.

    With ``event_time`` and ``delay`` a repeat is looked for within that time, and the
    state forgets older keys; without, the state grows with the distinct records.
    """
    marked = with_content(rows, columns)
    if event_time is None:
        return marked.dropDuplicates([*key, CONTENT])
    return marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([*key, CONTENT])


def collisions(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, contents): keys that the stream has seen with more than one content."""
    found = table.groupBy(*key).agg(F.count_distinct(CONTENT).alias("contents"))
    return found.where(F.col("contents") > 1)
