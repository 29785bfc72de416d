"""The corpus pipeline: stages that turn documents into a training corpus.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last one adds their
token ids. Between stages the documents are a table: the caller may write each result and read
it again, ``run`` does so in the shared folder.
"""

from pathlib import Path

import public_tokenizers

from gapweave.llm import lines, nearcopies, phrases, pieces, quality
from gapweave.session import settle_table

#: Percent of shingles that near copies share.
NEAR = 80
MODEL = "piece_bpe_32k.model"


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules and the certified cutoffs reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark, docs, sf_dir):
    """Later occurrences of three-line windows go; a document of which nothing stays goes too."""
    return lines.clean(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return nearcopies.one_of_each(docs, NEAR)


def decontaminate(spark, docs, sf_dir):
    """Documents holding a benchmark window go."""
    return phrases.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark, docs, sf_dir):
    """Adds ids, n_tokens, and whether decoding gives the text back."""
    model = Path(public_tokenizers.path(MODEL)).read_bytes()
    return pieces.tokenized(docs, model)


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("near_copies", near_dedup), ("benchmark", decontaminate), ("pieces", tokenize)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
