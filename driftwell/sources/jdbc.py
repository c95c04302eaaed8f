"""A live database as a source or sink, through Spark's JDBC reader and writer."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Endpoint:
    """Where a database is. The session pins no search path and no statement timeout."""

    host: str
    port: int = 5432
    user: str = ""
    password: str = field(default="", repr=False)
    dbname: str = ""
    sslmode: str = "prefer"
    url: str = ""
    driver: str = "org.postgresql.Driver"
    session_init: str = "SET search_path = ''; SET statement_timeout = 0; SET idle_in_transaction_session_timeout = 0"

    def options(self, dbname: str = "") -> dict[str, str]:
        url = self.url or f"jdbc:postgresql://{self.host}:{self.port}/{quote(dbname or self.dbname, safe='')}?sslmode={self.sslmode}"
        out = {"url": url, "driver": self.driver}
        out |= {k: v for k, v in (("user", self.user), ("password", self.password), ("sessionInitStatement", self.session_init)) if v}
        return out

    def masked(self) -> dict[str, str | int]:
        return {"host": self.host, "port": self.port, "user": self.user, "password": "****" if self.password else "", "dbname": self.dbname}


LOOPBACK = ("localhost", "127.0.0.1", "::1", "0.0.0.0")  # noqa: S104  names that another machine can't use


def is_unstable_host(host: str) -> bool:
    """Whether the other server would find another machine, or none, under this name."""
    return host.strip().lower() in LOOPBACK


def read_query(spark: SparkSession, endpoint: Endpoint, query: str) -> DataFrame:
    return spark.read.format("jdbc").options(**endpoint.options()).option("query", query).load()


def read_ranges(spark: SparkSession, endpoint: Endpoint, table: str, key: str, low: int, high: int, chunks: int) -> DataFrame:
    """A table in parallel by ranges of a numeric key; the first and last range have no outer bound."""
    options = endpoint.options() | {"dbtable": table, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(chunks)}
    return spark.read.format("jdbc").options(**options).load()


def write_table(rows: DataFrame, endpoint: Endpoint, table: str, mode: str = "append") -> None:
    rows.write.format("jdbc").options(**endpoint.options(), dbtable=table).mode(mode).save()
