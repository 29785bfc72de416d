"""Query op2: the language of every document."""

from gapweave.llm import langid


def op2_language(spark, sf_dir):
    return langid.predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_language": op2_language}
