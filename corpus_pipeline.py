"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language: texts in which no language is found go, those without a letter; any other text has a nearest language and stays.
2. exact duplicates: of texts equal without white space one stays, the longest.
3. near duplicates: of texts linked by 80 % of their five-word shingles one stays, the one with the smallest id.
4. mixing: rates bounded by 1 aim at all expected tokens of the good domain, a tenth of the poor and none of the toxic. Texts that nothing
   tells from good ones hold expected poor and toxic tokens too and stay with them, so the targets are met only as far as
   the posteriors tell domains apart; the README gives the measured gap.
5. encoding: token ids of every text, and whether they decode to it.

A stage learns from and decides on all rows its predecessor kept; stages 1 to 4 return the columns of ``documents``. An empty
table passes through all stages; null texts go in stage 1, for no language is found in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.bloom_dedup import keep_one
from threadlens.llm.bpe import encoded
from threadlens.llm.common import arrow_limits
from threadlens.llm.langid import identified, prototypes
from threadlens.llm.minhash import one_of_each
from threadlens.llm.mixing import labelled, thinned
from threadlens.llm.places import unused
from threadlens.session import table
from threadlens.work import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    names, protos = prototypes(docs.select("text", "lang"), "text", "lang")
    pred, score = unused(docs.columns, "lang_pred", "score")
    return identified(docs, names, protos, out=(pred, score)).where(F.col(pred) != "und").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shares = {"good": 1.0, "poor": 0.1, "toxic": 0.0}
    return thinned(docs, labelled(spark, sf_dir), shares)[0]


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "round_trip")]  # columns of these names are replaced
    ids, decoded = unused(kept, "__ids", "__decoded")
    out = encoded(docs.select(*kept), out=(ids, decoded))
    whole = (F.col(decoded) == F.coalesce("text", F.lit(""))).alias("round_trip")
    return out.select(*kept, F.col(ids).alias("ids"), F.expr(f"cast(length({ids}) / 4 AS bigint)").alias("n_tokens"), whole)


STAGES = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicate_groups),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Language, signatures, rates and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to encoded texts."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = work.keep(stage(spark, docs, sf_dir), name)
        work.drop(docs)
        docs = after
    return docs
