"""Queries of ingest, catalog and stored results: each writes into the shared folder and reads back, with the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators.membership import fund_id, link_permno, parse_fund_name
from panelmill.plans import reference as ref
from panelmill.session import read, table_path
from panelmill.sources.ingest import Connection, Store, build_fund_universe, build_universe, db_tables, ingest, save_ranks, table_info

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return keep


def _schema_name() -> str:
    """A catalog schema of this call alone."""
    return f"mill_{uuid.uuid4().hex[:12]}"


def _ingested(s, d) -> str:
    """The orders as a delivered CSV file with numbers for dates and a sentinel, taken in by a spec; the table's name."""
    raw = table_path(s, "delivered")
    o = read(s, d, "orders").select(
        F.col("o_orderkey").alias("ORDERKEY"), F.col("o_custkey").alias("CUSTKEY"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("Date"),
        F.when(F.col("o_orderstatus") == "O", "E").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("thru"), F.col("o_totalprice").alias("PRICE"), F.col("o_orderstatus").alias("STATUS"),
    )
    o.write.csv(raw, header=True)
    c = read(s, d, "customer").select("c_custkey", "c_nationkey").write
    c.parquet(side := table_path(s, "customers"))
    s.read.parquet(side).createOrReplaceTempView("mill_customers")
    spec = {
        "schema": _schema_name(), "table": "orders", "file_path": raw, "where": "STATUS <> 'P'", "from": "SELECT t.*, c.c_nationkey AS NATION FROM {table} t LEFT JOIN mill_customers c ON c.c_custkey = t.CUSTKEY",
        "custom": {"thru": "CASE WHEN thru = 'E' THEN '29991231' ELSE thru END"}, "rename": {"PRICE": "TotalPrice"},
        "alter_type": {"Date": ["timestamp", "%Y%m%d"], "thru": ["timestamp", "%Y%m%d"], "ORDERKEY": "long", "CUSTKEY": "long", "TotalPrice": "double"}, "index": "custkey", "partitions": 8,
    }
    # the sentinel sits among the numbers: all texts, so that no row fails a type taken from the first rows
    spec["csv_schema"] = ", ".join(f"{c} string" for c in o.columns)
    (name,) = ingest(s, [spec], folder=table_path(s, "warehouse"))
    return name


@query("""SELECT o_orderkey AS orderkey, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'O' THEN DATE '2999-12-31' ELSE CAST(o_orderdate AS DATE) END AS thru,
 o_totalprice AS totalprice, o_orderstatus AS status, c_nationkey AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""")
def sc8_sk1_to_sk8_ingest(s, d):
    t = s.table(_ingested(s, d))
    return t.withColumns({"date": F.to_date("date"), "thru": F.to_date("thru")})


@query("""SELECT unnest(['orderkey', 'custkey', 'date', 'thru', 'totalprice', 'status', 'nation']) AS "column", unnest(['bigint', 'bigint', 'timestamp', 'timestamp', 'double', 'string', 'int']) AS type""")
def sc14_table_columns(s, d):
    return table_info(s, _ingested(s, d)).withColumn("type", F.replace("type", F.lit("_ntz"), F.lit("")))


@query("SELECT 'orders' AS \"table\", 1 AS tables")
def sc14_tables_of_a_schema(s, d):
    schema = _ingested(s, d).split(".")[0]
    return db_tables(s).where(F.col("schema") == schema).groupBy("table").agg(F.count("*").cast("int").alias("tables"))


@query("SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def sc15_sql_with_parameters(s, d):
    read(s, d, "orders").createOrReplaceTempView("mill_orders")
    return Connection(s).execute("SELECT o_orderstatus, count(*) AS orders FROM mill_orders WHERE o_totalprice > :least GROUP BY 1", {"least": 1000})


@query(f"WITH {ref._STC} SELECT permno, count(*) AS days, max(prc) AS prc FROM st WHERE NOT isnan(prc) GROUP BY 1")
def sc10_sk14_cached_query(s, d):
    """Made by the first call, read from the store by the second."""
    store = Store(s, table_path(s, "store"))
    x = ref.crsp(s, d, "prc").where("prc IS NOT NULL AND NOT isnan(prc)").groupBy("permno").agg(F.count("*").alias("days"), F.max("prc").alias("prc"))
    store.cached(x)
    return store.cached(x)


@query(f"WITH {ref._RANK} SELECT date, permno, ttm_min_prc, ttm_mc, ttm_mc_rank FROM rk")
def sk11_o3_ranking_table(s, d):
    """The ranking as a catalog table, clustered by date."""
    return s.table(save_ranks(s, ref._ranks(s, d), _schema_name(), "rank_crsp_mc", table_path(s, "warehouse")))


_LINKED = ref._SQL["sk10_j7_linked_universe"].replace("ttm_mc_rank <= 30", "ttm_mc_rank BETWEEN 5 AND 40")


@query(_LINKED)
def sc9_sk10_built_universe(s, d):
    """Ranks 5 to 40 with their links, built, stored by name and read back in another spelling."""
    store = Store(s, table_path(s, "store"))
    ranks = ref._ranks(s, d).select("date", "permno", "ttm_mc_rank")
    build_universe(store, ranks, "crsp", 40, 5, "2024-01-15", lambda u: link_permno(u, read(s, d, "crsp_cstat_link"), read(s, d, "crsp_ibes_link")))
    return store.built_universe("crsp_us_5_40")


_FUND = ref._SQL["j8_sk13_holdings_universe"]


@query(f"""WITH u AS ({_FUND}) SELECT date, ascii(fund) AS crsp_portno, id AS permno FROM u WHERE fund = 'R' AND date > '1995-06-30' AND date < '2001-06-29'""")
def sc11_sc12_sc13_sk13_fund_universe(s, d):
    """A fund by the name of its ticker: looked up, its holdings stored for every day, and read between two days, both excluded."""
    x = read(s, d, "lineitem")
    funds = x.select(F.ascii("l_returnflag").alias("crsp_portno"), F.col("l_returnflag").alias("ticker"), F.concat(F.lit("Fund "), F.col("l_returnflag")).alias("fund_name"))
    portno = fund_id(funds, **parse_fund_name("ETF_R"))
    held = x.select(ref.to_period("l_shipdate", "Q").alias("date"), F.ascii("l_returnflag").alias("crsp_portno"), F.col("l_suppkey").alias("permno"))
    store = Store(s, table_path(s, "store"))
    build_fund_universe(store, held, ref._days_of(s, d, x, "l_shipdate"), portno)
    return store.fund_universe(portno, "1995-06-30", "2001-06-29")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
