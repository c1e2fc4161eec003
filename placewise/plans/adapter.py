"""The engine's input shapes over a star schema: incidents, their attributes, polygons, logs.

The texts below are plain SQL that Spark and DuckDB both run, so a query and its SQL twin read the same rows.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from ..operators import geo, select
from ..sources import layers

#: Tables that are landed bucketed, by their key, and what they are made of.
STORED = {"calls": "request_id", "fields": "request_id"}
#: Rows of a landed table in memory, where a task sorts a bucket of them, by bytes of the compressed tables that they are made of.
IN_MEMORY = 8
SOURCES = ("region", "nation", "customer", "part", "orders", "lineitem")
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "conversations")

VIEWS: dict[str, str] = {
    "calls": """
SELECT o_orderkey AS object_id, o_orderkey AS request_id,
  o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400) AS date_initiated,
  CASE WHEN o_orderstatus = 'O' THEN NULL
       ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400 + o_orderkey * 37 % 20000) END AS date_closed,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL
       ELSE concat(cast(c_custkey % 40 + 1 AS string), ' ', replace(lower(n_name), '_', '  '), ' st,  ', r_name,
                   CASE WHEN o_orderkey % 2 = 0 THEN ',  B3K 3K3' ELSE '' END) END AS address,
  n_name AS community,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE cast(n_regionkey AS string) END AS district,
  cast(n_regionkey AS double) * 10 + cast(c_custkey % 40 AS double) / 5 + cast(o_orderkey % 3 AS double) / 1024 AS latitude,
  CASE WHEN o_orderkey % 13 = 0 THEN 0
       ELSE cast(n_nationkey - n_nationkey % 5 AS double) * 2 + cast(c_custkey % 40 AS double) / 5 END AS longitude,
  CASE WHEN o_orderkey % 10 < 8 THEN 'INTERNAL' WHEN o_orderkey % 10 = 8 THEN '311 Online' ELSE NULL END AS initiated_by,
  concat('Call of ', lower(o_orderpriority)) AS description, substring(o_orderpriority, 1, 1) AS priority, c_mktsegment AS request_category,
  CASE o_orderstatus WHEN 'F' THEN 'Resolved' WHEN 'P' THEN 'Partly resolved' ELSE NULL END AS resolution, o_orderstatus AS status,
  r_name AS dept_responsibility, CASE WHEN o_orderkey % 6 = 0 THEN concat('W', cast(o_orderkey AS string)) ELSE NULL END AS work_order
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "order_part": """
SELECT l_orderkey AS request_id, p_brand, p_type, p_size
FROM (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) x JOIN part ON p_partkey = pk""",
    "fields": """
SELECT o_orderkey * 10 + i AS object_id, o_orderkey AS request_id, i + 1 AS field_id,
  CASE i WHEN 0 THEN 'Alleged Violation' WHEN 1 THEN 'Vehicle Was Towed' ELSE 'Property Ownership' END AS name,
  CASE WHEN i = 0 THEN o_orderpriority WHEN i = 1 THEN CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' ELSE NULL END
       WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS value
FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (VALUES (0), (1), (2)) AS v(i)
UNION ALL SELECT request_id * 10 + i, request_id, i + 1,
  CASE i WHEN 3 THEN 'Vehicle Make' WHEN 4 THEN 'Vehicle Model' ELSE 'Vehicle Colour' END,
  CASE i WHEN 3 THEN p_brand WHEN 4 THEN p_type ELSE cast(p_size % 4 AS string) END
FROM order_part CROSS JOIN (VALUES (3), (4), (5)) AS v(i)""",
    "squares": """
SELECT cast(n_nationkey AS string) AS dauid, cast(n_nationkey - n_nationkey % 5 AS double) * 2 AS x0, cast(n_regionkey AS double) * 10 AS y0,
  cast(CASE hole WHEN 0 THEN 0 ELSE 2.015625 END AS double) AS off, cast(CASE hole WHEN 0 THEN 7.03125 ELSE 2 END AS double) AS side
FROM nation CROSS JOIN (VALUES (0), (1)) AS v(hole) WHERE hole = 0 OR n_nationkey % 6 = 0""",
    "edges": """
SELECT dauid, x0 + off + CASE WHEN i IN (1, 2) THEN side ELSE 0 END AS x1, y0 + off + CASE WHEN i IN (2, 3) THEN side ELSE 0 END AS y1,
  x0 + off + CASE WHEN i IN (0, 1) THEN side ELSE 0 END AS x2, y0 + off + CASE WHEN i IN (1, 2) THEN side ELSE 0 END AS y2
FROM squares CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i)""",
    "areas": """
SELECT dauid, CASE WHEN n_nationkey % 9 = 0 THEN 0 ELSE 100 + 37 * n_nationkey END AS dwellings,
  min(x1) AS min_lon, min(y1) AS min_lat, max(x1) AS max_lon, max(y1) AS max_lat
FROM edges JOIN nation ON dauid = cast(n_nationkey AS string) GROUP BY dauid, n_nationkey""",
    "dim": """
SELECT o_orderpriority AS raw_label,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Urgent or high' WHEN '2' THEN 'Urgent or high' WHEN '4' THEN NULL ELSE 'Medium or low' END AS canonical_type,
  CASE WHEN substring(o_orderpriority, 1, 1) = '4' THEN 'excluded' ELSE 'assigned' END AS status
FROM (SELECT DISTINCT o_orderpriority FROM orders) x""",
    "runs": """
SELECT event_id AS run_id, event_type AS layer,
  CASE event_id % 3 WHEN 0 THEN 'full_load' WHEN 1 THEN 'reload' ELSE 'poll' END AS kind,
  ts AS started_at, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + INTERVAL '90' SECOND END AS finished_at,
  CASE WHEN event_id % 7 = 0 THEN 'failed' END AS error,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS reconciled,
  date_trunc('day', ts) AS source_edit FROM events""",
    "layer_state": """
SELECT concat('store', cast(user_id % 7 AS string)) AS store, event_type AS layer, event_type = min(event_type) OVER () AS static,
  max(ts) AS source_last_edit, min(CASE WHEN event_id % 5 <> 0 THEN ts END) AS last_success_at, max(ts) AS last_attempt_at,
  max(ts) + INTERVAL '20' HOUR AS next_due_at,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 AND event_type = 'click' THEN NULL ELSE min(ts) END AS full_load_completed_at
FROM events GROUP BY user_id % 7, event_type""",
    "decisions": """
SELECT CASE WHEN conv_id % 2 = 0 THEN 'Urgent or high' ELSE 'Medium or low' END AS violation_type,
  CASE conv_id % 5 WHEN 0 THEN 'block' WHEN 4 THEN 'street' ELSE 'doorway' END AS scope, cast(conv_id % 97 AS string) AS item_key,
  CASE WHEN turn % 6 = 5 THEN '' ELSE substring(text, 1, 12) END AS decision, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS role,
  CASE WHEN turn % 2 = 0 THEN '' ELSE 'seen' END AS note, conv_id * 1000 + turn AS changed_at
FROM conversations""",
}


class Inputs:
    """The tables and views as DataFrames, by attribute; each is made when it is first asked for.

    Views are registered under names of their folder, so that several folders can be used in one session.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._prefix = f"v{zlib.crc32(sf_dir.encode()):08x}_"

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED or name == "covered":
            df = self._stored(name)
            setattr(self, name, df)
            return df
        if name == "busy":
            found = self._stored(name)
            self.busy = None if found.isEmpty() else found
            return self.busy
        if name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        return self._view(name)

    def _stored(self, name: str) -> DataFrame:
        """The landed table of a name: calls and attributes bucketed by request, the areas' cover, and busy doorways (None without any). A folder's tables are
        landed once a session, again if their files have changed."""
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file
        size, newest = layers.size_and_time(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in SOURCES])
        table = f"{self._prefix}{name}_{size:x}_{newest:x}"
        if not self.spark.catalog.tableExists(table):
            if name in ("covered", "busy"):
                rows = geo.cover(self.areas, self.edges, ["dwellings"]) if name == "covered" else select.busy_doors(self.calls)
                rows.write.option("path", layers.work_folder(self.spark, table)).saveAsTable(table)
            else:
                layers.store_bucketed(self._view(name), table, STORED[name], layers.buckets_for(size * IN_MEMORY))
        return self.spark.table(table)

    def _view(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            sql = VIEWS[name]
            for used in sorted(set(re.findall(r"(?:FROM|JOIN) ([a-z_]+)", sql))):
                getattr(self, used)
            df = self.spark.sql(re.sub(r"(?<=FROM |JOIN )([a-z_]+)", rf"{self._prefix}\1", sql))
        df.createOrReplaceTempView(self._prefix + name)
        if name not in STORED:
            setattr(self, name, df)
        return df


def with_views(sql: str, *ctes: str) -> str:
    """A DuckDB statement with the views in front."""
    views = ",\n".join(f"{n} AS ({b})" for n, b in VIEWS.items())
    return "WITH " + ",\n".join([views, *ctes]) + "\n" + sql
