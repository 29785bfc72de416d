"""Sources and sinks."""

from pyspark.sql import functions as F

from checks.common import LABEL, LINE, PART_SQL, SEED, lines, parts, query, table, u_sql
from gapweave.functions.rng import hash_uniform
from gapweave.model import Descriptor
from gapweave.session import new_folder
from gapweave.sources.files import coerce_numeric, decode_bytes, read_arff, read_csv, union_results, write_arff
from gapweave.sources.profile import profile
from gapweave.sources.registry import Registry, complete_cases, project, summary
from gapweave.sources.synthetic import LEVELS, generate

CATALOG = [
    {"name": "lineitem", "kind": "table", "source": "tpch", "numeric_columns": LINE,
     "catagorical_columns": ["l_returnflag", "l_linestatus"], "label_column": LABEL},
    {"name": "part", "kind": "table", "source": "tpch", "numeric_columns": ["p_size"],
     "categorical_columns": ["p_brand", "p_type"], "text_columns": ["p_retailprice"]},
    {"name": "supplier", "kind": "table", "source": "tpch", "numeric_columns": ["s_acctbal"],
     "text_columns": ["s_nationkey"], "disabled": "true"},
    {"name": "events", "kind": "table", "source": "stream", "numeric_columns": ["value"],
     "categorical_columns": ["event_type"], "label_column": "value"},
]


@query("registry_lookup", """
SELECT 'lineitem' AS ds_name, count(*) AS rows, 5 AS features FROM lineitem UNION ALL
SELECT 'part', count(*), 3 FROM part""")
def registry_lookup(spark, sf):
    reg = Registry(CATALOG)
    opened = [reg.open(spark, n, f"{sf}/{n}.parquet") for n in reg.names("tpch")]
    frames = [summary(df, d) for d, df in opened]
    return frames[0].unionByName(frames[1])


@query("csv_source", PART_SQL)
def csv_source(spark, sf):
    path = new_folder(spark, "csv")
    src = parts(spark, sf)
    src.write.option("header", True).csv(path)
    return read_csv(spark, path, src.schema)


@query("arff_source", """SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_brand, CASE WHEN p_size > 25 THEN p_size::DOUBLE END AS p_size,
  p_retailprice FROM part""")
def arff_source(spark, sf):
    path = new_folder(spark, "arff")
    src = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", F.expr("CASE WHEN p_size > 25 THEN p_size END").alias("p_size"),
                                          "p_retailprice")
    write_arff(src, path, "part")
    return read_arff(spark, path)


@query("numeric_coercion", """SELECT l_orderkey, l_linenumber, l_quantity, TRY_CAST(l_returnflag AS DOUBLE) AS flag
  FROM lineitem""")
def numeric_coercion(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("l_quantity"),
                                            F.col("l_returnflag").alias("flag"))
    return coerce_numeric(coerce_numeric(t, ["l_quantity"]), ["flag"], strict=False)


@query("byte_decode", "SELECT event_id, event_type FROM events")
def byte_decode(spark, sf):
    t = table(spark, sf, "events").select("event_id", F.encode("event_type", "UTF-8").alias("event_type"))
    return decode_bytes(t, ["event_type"])


@query("complete_cases", f"""WITH t AS (SELECT event_id, CASE WHEN NOT ({u_sql('mcar', 'value', 'event_id')} < 0.3) THEN value END AS value,
  event_type FROM events) SELECT * FROM t WHERE value IS NOT NULL""")
def complete(spark, sf):
    u = hash_uniform(SEED, "mcar", "value", "event_id")
    t = table(spark, sf, "events").select("event_id", F.when(~(u < 0.3), F.col("value")).alias("value"), "event_type")
    return complete_cases(t)


def _enum_sql(column, levels):
    items = ", ".join(f"'{v}'" for v in levels)
    return f"([{items}])[floor({u_sql('enum', column, 'i')} * {len(levels)})::INT + 1] AS {column}"


@query("synthetic_dataset", f"""WITH n AS (SELECT unnest(range(count(*))) AS i FROM orders)
SELECT i AS row_id, i + 1 AS n0, i + 10 AS n1, i + 100 AS n2, {_enum_sql('c0', LEVELS[0])}, {_enum_sql('c1', LEVELS[1])},
  i + 1000 AS label FROM n""")
def synthetic(spark, sf):
    return generate(spark, ["n0", "n1", "n2"], ["c0", "c1"], "label", table(spark, sf, "orders").count())


def _profile_sql(t, columns):
    one = """SELECT '{c}' AS "column", count(DISTINCT {c}::VARCHAR) AS n_unique,
      CASE WHEN count(DISTINCT {c}::VARCHAR) < 100 THEN array_to_string(list_sort(list(DISTINCT {c}::VARCHAR) FILTER (WHERE {c} IS NOT NULL)), ',') END AS "values",
      (count(*) - count({c}))::BIGINT AS n_missing FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, t=t) for c in columns)


PROFILED = ["l_quantity", "l_discount", "l_returnflag", "l_extendedprice", "l_linenumber"]


@query("column_profile", f"""WITH t AS (SELECT CASE WHEN l_discount > 0.02 THEN l_discount END AS l_discount, l_quantity, l_returnflag,
  l_extendedprice, l_linenumber FROM lineitem) {_profile_sql('t', PROFILED)}""")
def column_profile(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") > 0.02, F.col("l_discount")))
    return profile(t, PROFILED)


@query("result_union", """SELECT 'lineitem' AS ds_name, count(*) AS n_rows, max(l_quantity) AS top_quantity, NULL::DOUBLE AS top_price FROM lineitem
UNION ALL SELECT 'part', count(*), NULL, max(p_retailprice) FROM part""")
def result_union(spark, sf):
    a = lines(spark, sf).agg(F.lit("lineitem").alias("ds_name"), F.count("*").alias("n_rows"), F.max("l_quantity").alias("top_quantity"))
    b = parts(spark, sf).agg(F.lit("part").alias("ds_name"), F.count("*").alias("n_rows"), F.max("p_retailprice").alias("top_price"))
    return union_results([a, b])


@query("dataset_projection", "SELECT p_partkey, p_size, p_retailprice FROM part")
def dataset_projection(spark, sf):
    return project(table(spark, sf, "part"), Descriptor.from_dict(CATALOG[1]), "p_partkey")
