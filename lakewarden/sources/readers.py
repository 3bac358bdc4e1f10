"""Reading: source registry, reader options, lake tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import vocab

LAKE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Connection:
    """What a source needs; defaults follow the profiled platforms."""

    source_type: str
    host: str = ""
    port: int = 0
    database: str = ""
    username: str = ""
    password: str = ""
    schema_filter: tuple[str, ...] = ()
    table_filter: tuple[str, ...] = ()
    enable_profiling: bool = True
    profile_sample_pct: float = 10.0
    connect_timeout_secs: int = 30
    extra: dict = field(default_factory=dict)


# URL shape and driver class of each JDBC source.
_JDBC = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "teradata": ("jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}", "com.teradata.jdbc.TeraDriver"),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC"),
}

# Catalog statements answered by the remote system.
_SCHEMA_QUERY = {
    "postgresql": "SELECT schema_name FROM information_schema.schemata",
    "mssql": "SELECT SCHEMA_NAME AS schema_name FROM INFORMATION_SCHEMA.SCHEMATA",
    "teradata": "SELECT TRIM(DatabaseName) AS schema_name FROM DBC.DatabasesV WHERE DBKind = 'D'",
}
_TABLE_QUERY = {
    "postgresql": "SELECT table_schema AS schema_name, table_name FROM information_schema.tables WHERE table_type IN ('BASE TABLE', 'VIEW')",
    "mssql": "SELECT TABLE_SCHEMA AS schema_name, TABLE_NAME AS table_name FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_TYPE IN ('BASE TABLE', 'VIEW')",
    "teradata": "SELECT TRIM(DataBaseName) AS schema_name, TRIM(TableName) AS table_name FROM DBC.TablesV WHERE TableKind IN ('T', 'V', 'O')",
}


def reader_options(conn: Connection, table: str | None = None, query: str | None = None, split: tuple[str, int, int, int] | None = None) -> tuple[str, dict[str, str]]:
    """(format, options) for spark.read.

    ``split`` = (column, lower, upper, partitions) turns one remote table into
    parallel range reads instead of a single connection.
    """
    if conn.source_type not in vocab.SOURCE_TYPES:
        raise ValueError(f"unknown source type: {conn.source_type}")
    if conn.source_type not in vocab.READABLE_SOURCES:
        raise ValueError(f"no reader for source type: {conn.source_type}")
    if conn.source_type == "bigquery":
        options = {"parentProject": conn.host}
        options["query" if query else "table"] = query or f"{conn.host}.{table}"
        return "bigquery", options
    url, driver = _JDBC[conn.source_type]
    options = {
        "url": url.format(host=conn.host, port=conn.port, database=conn.extra.get("db_path", conn.database)),
        "driver": driver,
        "user": conn.username,
        "password": conn.password,
        "queryTimeout": str(conn.connect_timeout_secs),
        "fetchsize": "10000",
        "pushDownPredicate": "true",
        "pushDownAggregate": "true",
    }
    if query:
        options["query"] = query
    else:
        options["dbtable"] = table or ""
    if split and not query:
        column, lower, upper, partitions = split
        options.update(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return "jdbc", options


def read_source(spark: SparkSession, conn: Connection, **kwargs) -> DataFrame:
    fmt, options = reader_options(conn, **kwargs)
    return spark.read.format(fmt).options(**options).load()


def schema_query(source_type: str) -> str:
    return _SCHEMA_QUERY[source_type]


def table_query(source_type: str) -> str:
    return _TABLE_QUERY[source_type]


def lake_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def lake(spark: SparkSession, root: str, names=LAKE_TABLES) -> dict[str, DataFrame]:
    return {name: lake_table(spark, root, name) for name in names}
