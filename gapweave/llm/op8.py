"""Query op8: masked pseudo-likelihood of every document."""

from gapweave.llm import masked


def op8_lm_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return masked.score(docs, masked.train(docs))


QUERIES = {"op8_lm_score": op8_lm_score}
