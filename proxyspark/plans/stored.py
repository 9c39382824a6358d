"""Dashboards from stored tables: a scope becomes filters on folders and row groups."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyspark.functions import net
from proxyspark.operators import dashboard, sketches
from proxyspark.operators.scope import Scope, apply_scope
from proxyspark.sources import versions


class StoredDashboards:
    """Questions over the tables of one root, as the newest generation shows them.

    Figures come from rollups: the grain is a folder, the time and the organization are
    pushed down to row groups. Rows are read for exact percentiles only, in the scope's
    months; ``sketched`` answers with merged sketches and reads no rows at all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._read = lambda kind, uploads=None: versions.read_committed(spark, root, kind, uploads)
        self._spark = spark

    def rollups(self, grain: str) -> DataFrame:
        return self._read("entry_rollups").where(F.col("grain") == grain)

    def uploads(self) -> DataFrame:
        return self._read("uploads").withColumnRenamed("id", "upload_id")

    def summary(self, scope: Scope) -> DataFrame:
        return dashboard.dashboard_summary(self.rollups("hour"), self._read("entries"), self.uploads(), scope)

    def series(self, scope: Scope, grain: str = "hour") -> DataFrame:
        return dashboard.dashboard_series(self.rollups(grain), self._read("entries"), scope, grain)

    def status(self, scope: Scope) -> DataFrame:
        return dashboard.status_breakdown(self._read("status_rollups"), scope)

    def span(self, scope: Scope) -> DataFrame:
        return dashboard.data_span(self.rollups("hour"), scope)

    def sketched(self, scope: Scope, by: list[str]) -> DataFrame:
        return sketches.sketched_latency(self._read("latency_sketches"), scope, by)

    def in_subnet(self, scope: Scope, cidr: str) -> DataFrame:
        """Entries from a subnet: a range of the stored address key."""
        return apply_scope(self._read("entries"), scope).where(net.key_in_cidr(F.col("ip_key"), cidr))

    def page(self, upload_id: str, flagged: DataFrame, **paging) -> DataFrame:
        """A page of one upload (see ``dashboard.entry_page``), from the folders of its
        bucket and version only. ``flagged`` (upload_id, entry_id) names the cited rows."""
        mine = self._spark.createDataFrame([(upload_id,)], "upload_id string")
        return dashboard.entry_page(self._read("entries", mine), flagged, upload_id, **paging)
