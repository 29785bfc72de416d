"""Query op12: periodic runs of words, after repetitions are planted in a tenth of the documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm import periods


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text. With h = crc32 of the id and g = h / 10, in documents with h mod 10 = 0 each word from a = g mod n on becomes
    word a + (i - a) mod p, p = 1 + (n - a) / (3 + g mod 8); words are then one space apart. A null id plants nothing."""
    own = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    own = own.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    own = own.select("doc_id", "text", "w", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).alias("a"))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda i: F.element_at("w", (F.col("a") + i % F.col("p") + 1).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return own.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periods(spark, sf_dir):
    return periods.report(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op12_periods": op12_periods}
SQL = {"op12_periods": r"""
WITH c AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
  lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
g AS MATERIALIZED (SELECT doc_id, i, hash(array_to_string(w[i + 1:i + 5], ' ')) AS gram, n FROM (SELECT doc_id, w, n, unnest(range(0, n - 4)) AS i FROM d WHERE n >= 5)),
m AS MATERIALIZED (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 5 + q - min(i) AS len FROM s GROUP BY doc_id, q, island),
ok AS (SELECT * FROM stretch WHERE len >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT * FROM ok WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.doc_id = ok.doc_id AND o.q < ok.q AND o.s <= ok.s AND o.s + o.len >= ok.s + ok.len)),
best AS (SELECT doc_id, s, len, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) = 1),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
left_ AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS words FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d) t
  ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.len // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(per.lines, '')) AS runs_sha256, sha256(coalesce(left_.words, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_ USING (doc_id)"""}
