"""Storage set-up and tear-down (A13): folders and catalog tables for a site.

"Already exists" is not an error; tear-down removes the edge site before HQ,
since the edge mirrors and replicates from HQ.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fieldlink.schemas import DOCUMENT_CHANGE, TOPIC_LOG
from fieldlink.sources import fs


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def init_catalog(spark: SparkSession, layout, database: str = "fieldlink", topic_names: list[str] = ()) -> list[str]:
    """Create a site's folders and register its tables; returns what was created or found."""
    folders = [layout.topics, layout.replica, layout.documents, layout.deadletter, layout.asset_state,
               layout.clicks, layout.publications, layout.copies, layout.sites.hq_files,
               layout.sites.download_dir, layout.sites.edge_files]
    folders += [f"{layout.topics}/{t}" for t in topic_names]
    fs.mkdirs(*folders)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.documents ({_ddl(DOCUMENT_CHANGE)}) "
              f"USING parquet LOCATION '{layout.documents}' OPTIONS (recursiveFileLookup 'true')")
    for t in topic_names:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.topic_{t.lower()} "
                  f"({_ddl(TOPIC_LOG)}) USING parquet "
                  f"LOCATION '{layout.topics}/{t}' OPTIONS (recursiveFileLookup 'true')")
    return folders


def drop_catalog(spark: SparkSession, layouts: list, database: str = "fieldlink", hq_volumes: bool = False) -> None:
    """Drop tables and delete the sites' folders, in the order given (edge first).

    With a site go its pipeline folder, its services' positions, wherever they
    are kept, and the edge's mirror; ``hq_volumes`` also deletes HQ's files and
    downloads. The source images are not the pipeline's and stay.
    """
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    for layout in layouts:
        s = layout.sites
        for f in (layout.base, layout.positions, s.edge_files, *([s.hq_files, s.download_dir] if hq_volumes else [])):
            fs.delete_dir(f)
