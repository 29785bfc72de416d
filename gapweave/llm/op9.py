"""Query op9: SentencePiece ids and decoded text of every document."""

from pathlib import Path

import public_tokenizers

from gapweave.llm import pieces


def op9_sentencepiece(spark, sf_dir):
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return pieces.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
