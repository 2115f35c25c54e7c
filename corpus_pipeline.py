"""Corpus pipeline: from documents to tokens, in stages that each work on all that the one before kept.

quality    documents that fail the base rules, or whose source fails as a whole, go
near_dups  of each class of similar texts (five-word shingles, 0.8 or more) the document of the least id stays; candidates share keys of
           minima and have near fingerprints, links are exact (simhash.keep_one; the README says why 64 bits can't do this)
repeats    every byte of a passage of LENGTH bytes that also starts elsewhere goes, and what it leaves of a cut character
mix        documents are taken as often as their source's target asks: once, twice, in part or not at all; a file for each shard
tokens     texts become token ids, and these texts again

Defined results: null and empty texts fail the quality rules; texts that lose all their bytes stay as empty ones until mix, which has no
words to take of them; n_chars follows the text; an empty table gives an empty result; further columns, of any name, are carried along
up to mix as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, mixing, quality, simhash, suffix
from gridloom.llm._support import carried, store, table
from gridloom.llm.queries import vocabulary

#: Token ids have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = docs.select(carried(docs.columns), "text", "source")
    return quality.judge(whole, ["row"], scratch=False).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(docs.select(carried(docs.columns), "doc_id", "text"), ["row"], characters=True)
    left, cut = F.col("kept").cast("string"), F.size("spans") > 0
    changes = {"text": F.when(F.col("row")["text"].isNotNull(), left)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(cut, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return done.select(*[changes.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: Rows of a shard of the mix, about: what a task of the next stage reads at once.
SHARD_ROWS = 4096


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.texts(docs, shards=1 << max(4, (docs.count() // SHARD_ROWS).bit_length()))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary(), ["doc_id", "lang", "source"])


STAGES = [("quality", keep_good), ("near_dups", drop_near_duplicates), ("repeats", cut_repeats), ("mix", mix_sources), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
