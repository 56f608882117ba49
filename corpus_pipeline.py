"""The training-data pipeline: quality rules, line dedup, near-dedup, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last returns doc_id,
n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the bytes that they decode to. A document
that the mix takes twice has two rows.

Cases, stage by stage:
- quality rules: null, empty and very short texts fail the base rule and go; repeated rows are judged alike; a very long text
  is judged whole.
- line dedup: no row goes; null texts stay null, a text whose lines all go becomes empty; rows with equal id and text
  keep equal texts; n_chars is made right.
- near dedup: texts without words stand alone and stay; of a group the smallest id stays, with all of its equal rows; a group without any id stays whole.
- mixing: a document without words takes no part and goes; a null source is a source of its own; of rows that are equal in id,
  source and text one is cut; a part of a document holds its whole words, joined by line ends where words between are left out.
- encoding: a null text would be an empty one; a text of any length is encoded whole.
All stages return an empty table for an empty one, break ties by id and then by text, and keep extra columns of any name up to the last stage,
which leaves them out.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import IDS, encoded
from tidemark.llm.common import alone, table
from tidemark.llm.line_dedup import line_deduped
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import one_of_each
from tidemark.llm.quality_rules import quality_filter

TOKENIZER, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document that becomes empty stays, as an empty one."""
    return line_deduped(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or parts of them, as often as the sources' targets take them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, TOKENIZER, PATTERN, IDS)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]

#: The first stage's rules are learned and the mix is pseudorandom, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:  # a stage's own tables go as soon as its result is stored
        docs = alone(spark, partial(stage, spark, docs, sf_dir))
    return docs
