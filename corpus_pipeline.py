"""From raw documents to packed training sequences: five stages over the operators of ``parley.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from parley.llm.best_fit import best_fit_pack, token_pieces
from parley.llm.common import prepare
from parley.llm.exact_dedup import drop_copies
from parley.llm.jaccard_join import Rule, drop_near_copies
from parley.llm.lang_unigram import UNKNOWN, identify, lang_model
from parley.llm.pu_quality import quality_model, score_quality
from parley.llm.registry import query, table
from parley.session import shared_dir

#: A document is rejected below these: quality score, share of the likeliest language, and log
#: probability per letter (real text has about -2.5, letters of no learned language about -14).
MIN_QUALITY, MIN_LANG_SCORE, MIN_LANG_FIT = 0.3, 0.5, -7.0

#: Chunks that a task of the last stage remembers: executors that have run four stages have less room left than fresh ones.
REMEMBERED = 250_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepare(spark)
    model = quality_model(spark, sf_dir, docs)
    score = _free(docs, "_quality")
    return score_quality(docs, model, out_col=score).where(F.col(score) >= MIN_QUALITY).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    prepare(spark)
    lang, score, fit = (_free(docs, n) for n in ("_lang", "_score", "_fit"))
    found = identify(docs, lang_model(docs), lang_col=lang, score_col=score, fit_col=fit)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_LANG_SCORE) & (F.col(fit) >= MIN_LANG_FIT)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles and a similarity of 0.8 or more."""
    prepare(spark)
    return drop_near_copies(docs, Rule(words=5, percent=80), once=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    prepare(spark)
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, remembered=REMEMBERED)
    return best_fit_pack(pieces)


#: Every stage returns no rows for none, keeps extra columns of any name, and takes a null text as empty: such
#: a text has no letter, so the language stage rejects it. Rows that repeat an id are one document each.
STAGES = [("quality", quality), ("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("packing", packing)]

#: Three stages are learned or tokenised and have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
        if k:  # the stage before is no longer needed
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs


query("pipeline", ORACLE_SQL)(run)
