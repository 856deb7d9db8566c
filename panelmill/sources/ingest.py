"""Typed ingest of CSV and parquet files into catalog tables, built universes and a result cache."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.dates import strptime_pattern


def lower_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def alter_types(df: DataFrame, types: dict) -> DataFrame:
    """Cast columns; ['timestamp', format] parses a strptime format, numbers included (20240131)."""
    out = {}
    for c, t in types.items():
        out[c] = F.to_timestamp(F.col(c).cast("string"), strptime_pattern(t[1])) if isinstance(t, (list, tuple)) else F.col(c).cast(t)
    return df.withColumns(out)


def read_csv(spark: SparkSession, path: str, rows_to_interpret: int = 5000, schema: str | None = None) -> DataFrame:
    """A CSV file with header; types from a schema or inferred from the first rows, never by a scan of the whole file.

    A later row that does not fit the inferred types is an error: more rows_to_interpret or a schema then takes it in.
    """
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    # the header is repeated in the sample, so that inference sees a complete file
    sample = spark.read.text(path).limit(rows_to_interpret + 1)
    inferred = spark.read.csv(sample.rdd.map(lambda r: r[0]), header=True, inferSchema=True).schema
    return spark.read.csv(path, header=True, schema=inferred, mode="FAILFAST")


def shape(spark: SparkSession, spec: dict, rows_to_interpret: int = 5000) -> DataFrame:
    """One spec as a lazy DataFrame: read, join (from), filter (where), custom, rename, alter_type, lower-case.

    spec keys: schema, table, file_path; optional where (SQL), from (SQL with {table} for the file), custom (a
    DataFrame -> DataFrame callable or {column: SQL expression}), rename, alter_type, csv_schema, rows_to_interpret, index.
    """
    path = spec["file_path"]
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, spec.get("rows_to_interpret", rows_to_interpret), spec.get("csv_schema"))
    if spec.get("from"):
        df = spark.sql(spec["from"], table=df)
    if spec.get("where"):
        df = df.where(spec["where"])
    custom = spec.get("custom")
    if isinstance(custom, Callable):
        df = custom(df)
    elif custom:
        df = df.withColumns({c: F.expr(e) for c, e in custom.items()})
    if spec.get("rename"):
        df = df.withColumnsRenamed(spec["rename"])
    if spec.get("alter_type"):
        df = alter_types(df, spec["alter_type"])
    return lower_case(df)


def ingest(spark: SparkSession, specs: list[dict], overwrite: bool = False, rows_to_interpret: int = 5000, partitions: int = 64, folder: str | None = None) -> list[str]:
    """Write every spec as schema.table (parquet) and return the names. With index, rows are bucketed and sorted by it, in
    `partitions` buckets (a spec may have its own), to be chosen by the size of the table.

    An existing table is an error unless overwrite. Tables lie in the warehouse, or in `folder` where one is given.
    """
    names = []
    for spec in specs:
        name = f"{spec['schema']}.{spec['table']}"
        _create_schema(spark, spec["schema"], folder)
        w = shape(spark, spec, rows_to_interpret).write.format("parquet").mode("overwrite" if overwrite else "errorifexists")
        keys = spec.get("index")
        if keys:
            keys = [keys] if isinstance(keys, str) else list(keys)
            w = w.bucketBy(spec.get("partitions", partitions), *keys).sortBy(*keys)
        if folder:
            w = w.option("path", f"{folder.rstrip('/')}/{name}")
        w.saveAsTable(name)
        names.append(name)
    return names


def _create_schema(spark: SparkSession, schema: str, folder: str | None) -> None:
    at = f" LOCATION '{folder.rstrip('/')}/{schema}.db'" if folder else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}{at}")


def drop_schema(spark: SparkSession, schema: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")


def table_info(spark: SparkSession, table: str) -> DataFrame:
    """(column, type) of a table."""
    return spark.createDataFrame([(c.name, c.dataType) for c in spark.catalog.listColumns(table)], "column string, type string")


def db_tables(spark: SparkSession) -> DataFrame:
    """(schema, table) of all catalog tables."""
    rows = [(d.name, t.name) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) if t.tableType != "TEMPORARY"]
    return spark.createDataFrame(rows, "schema string, table string")


def sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Any SQL text, with named parameters."""
    return spark.sql(text, args=args or {})


class Connection:
    """SQL on the shared session: execute, set_threads, close. Closing ends this object, not the session others use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.closed = spark, False

    def execute(self, text: str, args: dict | None = None) -> DataFrame:
        if self.closed:
            raise ValueError("The connection is closed")
        return sql(self.spark, text, args)

    def set_threads(self, threads: int) -> None:
        """How many tasks a shuffle is split into at most; the cluster's cores are set where the session is made."""
        if threads < 1:
            raise ValueError("threads must be positive")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(threads))

    def close(self) -> None:
        self.closed = True


class Store:
    """Named parquet results under one folder of ours: built universes, fund universes and cached queries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self, kind: str, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"{name!r} can't be a file name")
        return f"{self.folder}/{kind}/{name}.parquet"

    def exists(self, kind: str, name: str) -> bool:
        fs, p = self._fs(self.path(kind, name))
        return fs.exists(p)

    def write(self, kind: str, name: str, df: DataFrame, cluster_by: str | None = None) -> DataFrame:
        """Write, clustered by a column so that its ranges can be skipped on reading."""
        if cluster_by:
            df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
        df.write.mode("overwrite").parquet(self.path(kind, name))
        return self.read(kind, name)

    def read(self, kind: str, name: str) -> DataFrame:
        if not self.exists(kind, name):
            raise ValueError(f"{kind} {name} does not exist")
        return self.spark.read.parquet(self.path(kind, name))

    def clear(self, kind: str) -> None:
        """Delete this kind of results, and only files of this folder."""
        fs, p = self._fs(f"{self.folder}/{kind}")
        fs.delete(p, True)

    # ---- universes -------------------------------------------------------------------------------------------

    @staticmethod
    def universe_name(source: str, max_rank: int, min_rank: int = 1) -> str:
        return f"{source}_US_{max_rank}".upper() if min_rank == 1 else f"{source}_US_{min_rank}_{max_rank}".upper()

    def built_universe(self, name: str) -> DataFrame:
        return self.read("universe", name.upper())

    def fund_universe(self, portno: int, start_date: str, end_date: str) -> DataFrame:
        """A fund's cached holdings between two dates, both excluded."""
        return self.read("fund", f"ETF_{portno}").where((F.col("date") > start_date) & (F.col("date") < end_date))

    # ---- query cache -----------------------------------------------------------------------------------------

    @staticmethod
    def key(df: DataFrame) -> str | None:
        """SHA-224 of what decides the result: the canonical optimised plan in full, the result's names and types, and path,
        length and time of every file that is read.

        None where that can't be told: a plan over other sources than files, ranges and literal rows (an RDD, a
        persisted frame), one that calls functions of the user's or is not deterministic.
        """
        qe = df._jdf.queryExecution()
        with _whole_plan_strings(df.sparkSession):
            plan = qe.optimizedPlan()
            parts, text = [plan, *_seq(plan.subqueriesAll())], [df.schema.json()]
            for p in parts:
                if not p.deterministic() or re.search(r"expressions\.(PythonUDF|PythonUDAF|ScalaUDF|PythonUDTF)\b|\.ObjectProducer|\.MapElements", p.toJSON()):
                    return None
                text.append(p.canonicalized().toString())
                for leaf in _seq(p.collectLeaves()):
                    source = _source(leaf)
                    if source is None:
                        return None
                    text.append(source)
        return hashlib.sha224("\n".join(text).encode()).hexdigest()

    def cached(self, df: DataFrame, max_age_days: float | None = None) -> DataFrame:
        """The stored result of the same query over the same files, or the query's result, stored. Too old an entry is made
        anew. A query without a key is returned as it is."""
        name = self.key(df)
        if name is None:
            return df
        if self.exists("cache", name):
            fs, p = self._fs(self.path("cache", name))
            age = (time.time() * 1000 - fs.getFileStatus(p).getModificationTime()) / 86_400_000
            if max_age_days is None or age <= max_age_days:
                return self.read("cache", name)
        return self.write("cache", name, df)


@contextmanager
def _whole_plan_strings(spark: SparkSession):
    """Plans print 25 fields of a list by default; a key needs all."""
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _source(leaf) -> str | None:
    """What a leaf of a plan reads, as text; None if that is not to be seen."""
    kind = leaf.getClass().getSimpleName()
    if kind in ("Range", "OneRowRelation"):
        return leaf.toString()
    if kind == "LocalRelation":
        return leaf.data().toString()
    if kind != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    at = leaf.relation().location()
    if "allFiles" not in {m.getName() for m in at.getClass().getMethods()}:
        return None
    at.refresh()
    options = leaf.relation().options().toString()
    return leaf.relation().fileFormat().toString() + options + re.sub(r"access_time=\d+", "", at.allFiles().mkString("\n"))


def save_ranks(spark: SparkSession, ranks: DataFrame, schema: str, table: str, folder: str | None = None) -> str:
    """Persist a ranking as a catalog table, clustered by date so that date ranges skip files."""
    _create_schema(spark, schema, folder)
    w = ranks.repartitionByRange("date").sortWithinPartitions("date").write.format("parquet").mode("overwrite")
    if folder:
        w = w.option("path", f"{folder.rstrip('/')}/{schema}.{table}")
    w.saveAsTable(f"{schema}.{table}")
    return f"{schema}.{table}"


def build_universe(
    store: Store, ranks: DataFrame, source: str, max_rank: int, min_rank: int = 1, start_date: str = "1980-01-01", link: Callable | None = None
) -> DataFrame:
    """Cut a ranking to a rank range after a date, optionally link it (DataFrame -> DataFrame), and persist it by name."""
    from panelmill.operators.membership import ranked_universe

    u = ranked_universe(ranks, max_rank, min_rank, start_date)
    return store.write("universe", store.universe_name(source, max_rank, min_rank), link(u) if link else u, "date")


def build_fund_universe(store: Store, holdings: DataFrame, days: DataFrame, portno: int, link: Callable | None = None) -> DataFrame:
    """Persist one fund's holdings on every calendar day; they are read back by Store.fund_universe."""
    from panelmill.operators.membership import holdings_universe

    u = holdings_universe(holdings.where(F.col("crsp_portno") == portno), days, "crsp_portno", "permno")
    return store.write("fund", f"ETF_{portno}", link(u) if link else u, "date")
