"""Database tables through Spark's JDBC reader; the caller supplies the driver."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions.names import names, ref


# JDBC driver class and default port by kind of database.
DRIVERS = {
    "postgresql": ("org.postgresql.Driver", 5432),
    "mysql": ("com.mysql.cj.jdbc.Driver", 3306),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
}
KINDS = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mssql": "sqlserver", "sqlserver": "sqlserver"}


def connection(dsn: str) -> dict[str, str]:
    """JDBC url, user, password and driver from `kind://user:password@host:port/database?setting=value`.

    A `jdbc:` URL is kept as it is; its driver is added where it is known.
    """
    if not dsn or not dsn.strip():
        raise ValueError("connection: a DSN or JDBC URL is required")
    dsn = dsn.strip()
    if dsn.startswith("jdbc:"):
        known = DRIVERS.get(dsn.split(":")[1])
        return {"url": dsn, **({"driver": known[0]} if known else {})}
    parts = urlsplit(dsn)
    kind = KINDS.get(parts.scheme)
    if kind is None or not parts.hostname:
        raise ValueError(f"connection: unsupported DSN scheme {parts.scheme!r}")
    driver, port = DRIVERS[kind]
    settings = parse_qsl(parts.query)
    database = parts.path.strip("/")
    where = f"jdbc:{kind}://{parts.hostname}:{parts.port or port}"
    if kind == "sqlserver":
        pairs = ([("databaseName", database)] if database else []) + [
            ("databaseName" if k == "database" else k, v) for k, v in settings]
        url = where + "".join(f";{k}={v}" for k, v in pairs)
    else:
        url = f"{where}/{database}" + ("?" + "&".join(f"{k}={v}" for k, v in settings) if settings else "")
    found = {"url": url, "driver": driver}
    if parts.username:
        found["user"] = unquote(parts.username)
    if parts.password:
        found["password"] = unquote(parts.password)
    return found


def query_options(url: str, query: str, partition_column: str | None = None, lower=None, upper=None,
                  partitions: int | None = None, fetch_size: int = 1000, **extra) -> dict[str, str]:
    """Reader options for a query; with a partition column it is read in parallel ranges."""
    if not url or not query or not query.strip():
        raise ValueError("read_query: url and query are required")
    options = {**connection(url), "fetchsize": str(fetch_size), **{k: str(v) for k, v in extra.items()}}
    query = query.strip().rstrip(";")
    if partition_column is None:
        options["query"] = query
        return options
    if lower is None or upper is None or not partitions:
        raise ValueError("read_query: a partition column needs lower, upper and partitions")
    options.update(dbtable=f"({query}) t", partitionColumn=partition_column, lowerBound=str(lower),
                   upperBound=str(upper), numPartitions=str(partitions))
    return options


def _reader(spark: SparkSession, options: dict[str, str]) -> DataFrameReader:
    return spark.read.format("jdbc").options(**options)


def read_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a SQL query; `url` is a JDBC URL or a DSN for PostgreSQL, MySQL or SQL Server."""
    return _reader(spark, query_options(url, query, **options)).load()


def read_table(spark: SparkSession, url: str, table: str, schema: str | None = None, columns=None,
               where: str | None = None, fetch_size: int = 1000, **extra) -> DataFrame:
    """Columns and rows of a table; Spark pushes both selections down to the database."""
    if not url or not table:
        raise ValueError("read_table: url and table are required")
    options = {**connection(url), "dbtable": f"{schema}.{table}" if schema else table, "fetchsize": str(fetch_size),
               **{k: str(v) for k, v in extra.items()}}
    df = _reader(spark, options).load()
    if where:
        df = df.filter(F.expr(where))
    wanted = names(columns)
    return df.select(*[ref(c) for c in wanted]) if wanted else df
