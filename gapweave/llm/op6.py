"""Query op6: quality rules with certified cutoffs."""

from gapweave.llm import quality


def op6_quality(spark, sf_dir):
    return quality.verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_quality": op6_quality}

_TESTS = [(r, i, c) for r, (_, cuts) in quality.RULES.items() for i, c in enumerate(cuts)]
_SHARE = quality.RISK / len(quality.RULES)
_COUNTS = " UNION ALL ".join(
    f"SELECT stratum, '{r}' AS rule, {c}::DOUBLE AS cut, n, k{i}_{r} AS k FROM held" for r, i, c in _TESTS)
_HELD = ", ".join(f"count(*) FILTER ({quality.RULES[r][0]} >= {c}) AS k{i}_{r}" for r, i, c in _TESTS)
_REJECTED = " OR ".join(
    f"coalesce({score} >= (SELECT cut FROM cuts WHERE cuts.stratum = m.stratum AND rule = '{r}'), false)" for r, (score, _) in quality.RULES.items())
SQL = {"op6_quality": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
m0 AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts FROM d LEFT JOIN rep USING (doc_id)),
m AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m0),
held AS (SELECT stratum, count(*) AS n, {_HELD} FROM m JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE NOT base_failed GROUP BY 1),
tests AS ({_COUNTS}),
cuts AS MATERIALIZED (SELECT stratum, rule, min(cut) AS cut FROM tests WHERE k < n * {_SHARE} AND
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))))
  <= {quality.ERROR} / ({len(_TESTS)} * (SELECT count(DISTINCT stratum) FROM d)) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_shouts,
  CASE WHEN base_failed THEN false ELSE NOT ({_REJECTED}) END AS kept FROM m"""}
