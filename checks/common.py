"""Tables, shared frames and SQL fragments of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.model import ROW_ID, with_row_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SEED = 1001
LINE = ["l_quantity", "l_discount", "l_tax"]
LABEL = "l_extendedprice"
#: What tells lines apart: an order may hold a part twice, and numbers of lines repeat.
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, three features, the label."""
    return with_row_id(table(spark, sf, "lineitem"), LINE_KEY).select(ROW_ID, *LINE, LABEL)


def whole_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same, keyed by all columns of the line."""
    return with_row_id(table(spark, sf, "lineitem")).select(ROW_ID, *LINE, LABEL)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part")
    return t.select(F.col("p_partkey").alias(ROW_ID), F.col("p_size").cast("double").alias("p_size"),
                    "p_retailprice", "p_brand", "p_type")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Joined features of orders; the customer side is read once per order row."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(F.col("o_orderkey").alias(ROW_ID), "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"),
                         "o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated numeric features of an order, one row per order."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"),
        F.count("*").cast("double").alias("items"), F.max("l_linenumber").cast("double").alias("last_line"))
    o = table(spark, sf, "orders")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_orderkey").alias(ROW_ID), "qty", "price", "items", "last_line", "o_totalprice")


# --- SQL fragments ---------------------------------------------------------

def key_sql(columns: list[str]) -> str:
    return " || ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns)


LINE_SQL = f"""SELECT {key_sql(LINE_KEY)} AS row_id, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem"""
_LINE_ALL = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus "
             "l_shipdate").split()
WHOLE_LINE_SQL = f"""SELECT md5({key_sql(_LINE_ALL)}) AS row_id, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem"""
PART_SQL = "SELECT p_partkey AS row_id, p_size::DOUBLE AS p_size, p_retailprice, p_brand, p_type FROM part"
ORDER_SQL = """SELECT o_orderkey AS row_id, c_acctbal, c_nationkey::DOUBLE AS c_nationkey, o_orderstatus, o_orderpriority,
  c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"""
WIDE_SQL = """SELECT o_orderkey AS row_id, qty, price, items, last_line, o_totalprice FROM orders JOIN (
  SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, count(*)::DOUBLE AS items,
  max(l_linenumber)::DOUBLE AS last_line FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


def u_sql(salt: str, column: str, row_id: str = "row_id", seed: int = SEED) -> str:
    text = f"concat_ws('|', '{seed}', '{salt}', '{column}', {row_id})"
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def mcar_sql(columns: list[str], p: float, source: str, rest: list[str] = (), seed: int = SEED) -> str:
    cells = [f"CASE WHEN NOT ({u_sql('mcar', c, seed=seed)} < {p}) THEN {c} END AS {c}" for c in columns]
    return f"SELECT row_id, {', '.join([*cells, *rest])} FROM {source}"


def mean_sql(columns: list[str], source: str, rest: list[str] = (), train: str | None = None) -> str:
    cells = [f"coalesce({c}, (SELECT avg({c}) FROM {train or source})) AS {c}" for c in columns]
    return f"SELECT row_id, {', '.join([*cells, *rest])} FROM {source}"
