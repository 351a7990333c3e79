"""Query op1: tokens of every document, by line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import table

#: Folder of the public vocabularies; the rank file and its pattern are one choice.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{VOCABULARY}", PATTERN, fields=("text",), rule="start")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
