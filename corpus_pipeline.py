"""documents -> toxic ones rejected -> one of each group of near-duplicates -> sources mixed -> packed into sequences.

Defined cases, stage by stage: texts that are null or empty are not toxic, are no one's duplicate, and have no words, so mixing takes them as its rate says
and packing gives them the end id alone; rows with a null doc_id stay as others do; repeated rows are copies, of which near_dedup keeps one; a text of any length goes
through whole; columns beside those of documents are kept by all stages but the last, whatever their names; an empty table gives an empty result. Without usable labels
nothing is toxic."""

from pyspark.sql import DataFrame, SparkSession

from cellqtl.llm.minhash import keep_one
from cellqtl.llm.mixing import mix
from cellqtl.llm.packing import pack, pieces
from cellqtl.llm.shared import save, table
from cellqtl.llm.toxicity import reject_toxic

#: Similarity in percent from which the corpus keeps one of two documents (op4 has its own, 85).
SIMILAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, SIMILAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pack(pieces(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Scores, MinHash links and the packing are beyond SQL; tests/llm runs all stages and holds each against brute force on planted documents instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
