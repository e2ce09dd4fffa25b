"""A landed log archive: lines parsed once, in folders by namespace and event day, and searched where they lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import logs

SCHEMA = """ns bigint, layout int, day string, file_digest string, line_index bigint, pod string, container string, stage string,
component string, domain string, product string, run_id string, stream string, stamp string, message string, level string,
dedup_key string, rest string, landing string, namespace string, event_day date"""


@dataclass(frozen=True)
class Archive:
    """Landings of log records. A landing written again replaces its own lines, so a run that died can be repeated; the others'
    files are not touched. Replays are kept as they come: a search removes them, as they may lie in another landing.

    A search reads the folders of its namespace and days only; pods, levels and times are filtered by the Parquet scan.
    """

    spark: SparkSession
    root: str

    def land(self, records: DataFrame, landing: str) -> None:
        """Parse `records` of either layout and write them as the landing of that name."""
        lines = logs.parsed(records)
        # Rebalanced by folder: small days share a task, a large one is several files.
        dealt = lines.hint("rebalance", F.col("namespace"), F.col(logs.DAY))
        dealt.write.mode("overwrite").partitionBy("namespace", logs.DAY).parquet(f"{self.root}/landing={landing}")

    def lines(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.root).select(*logs.COLUMNS)

    def search(self, search: logs.Search) -> DataFrame:
        """Every line the search wants, each once, in no order; `plans.logs.page` cuts pages from it."""
        return logs.merged(self.lines(), search)
