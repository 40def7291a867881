"""The corpus pipeline: quality rules, exact and near duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm import bbit_minhash, content_sort, mixing, packing, quality_ledger
from tabsense.llm.common import word_count
from tabsense.llm.queries import DOMAIN, MIXTURE
from tabsense.storage import load, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule of the policy rejects.

    A null or empty text has too few words and goes; a null in any other column decides nothing. Repeated rows share
    their fate, other columns pass through, an empty table gives an empty one.
    """
    return quality_ledger.keep_good(docs, "v2")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, the one with the largest id.

    A null text is the empty one. A null id loses against any other; of rows with the same id and text exactly one
    stays. Other columns pass through, an empty table gives an empty one.
    """
    return content_sort.drop_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near copies, the one with the smallest id.

    Rows without words or without an id stay. An id with several texts links as each of them; rows that repeat id and
    text stay or go together. Other columns pass through, an empty table gives an empty one.
    """
    return bbit_minhash.drop_near_copies(docs, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to four fifths of the words, shared by the production weights, each read at most once.

    Sources that run short are used up and the hub fills what is left; the document in which
    a budget ends stays whole. A null text has no words, a null source or language is a node of its own; rows
    without words come along where their place falls inside the budget, ties of the order go by id and content. Other
    columns pass through, an empty table gives an empty one.
    """
    tree = docs.withColumn("_domain", F.expr(DOMAIN))
    chosen = mixing.mix(tree, ["_domain", "lang", "source"], MIXTURE, word_count("text"), F.expr("total * 4 div 5"), epochs=1)
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is its end alone. Repeated rows and null ids are packed each, other columns are left
    out, an empty table gives none.
    """
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixture", mixture),
    ("best-fit packing", best_fit_packing),
]

# Near-duplicate groups and tokens have no SQL form; a test runs all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
