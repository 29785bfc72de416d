"""Query op3: pages written as WARC records and read back."""

from gapweave.llm import warc
from gapweave.session import new_folder


def op3_warc(spark, sf_dir):
    return warc.digests(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))


QUERIES = {"op3_warc": op3_warc}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hex digits are four base32 characters.
_BASE32 = " || ".join(f"'{ALPHABET}'[1 + ((('0x' || substr(hex, {5 * g + 1}, 5))::INT >> {s}) & 31)]" for g in range(8) for s in (15, 10, 5, 0))
SQL = {"op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM h"""}
