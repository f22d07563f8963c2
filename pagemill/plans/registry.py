"""Names the queries: an operator applied to bound tables, with its DuckDB twin where SQL has one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import bound, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return bound(self.spark, self.sf_dir, name)

    def as_of(self, name: str = "ocr_events", column: str = "recorded_at"):
        """The newest timestamp of a table: a fixed stand-in for the wall clock."""
        return self[name].agg(F.max(column)).first()[0]


def scratch(spark, name: str) -> str:
    """A new path in the folder that all executors share. Only a local master gets a temporary folder where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pagemill-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(name: str, *tables: str, oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = with_bindings(oracle, tables)
        return f

    return add
