"""Queries over the corpus tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import load, store
from . import bbit_minhash, content_sort, filter_audit, interpolation, latent_neighbours, licenses, mixing, packing, preferences, quality_ledger, skip_chain, turn_repair, warc
from .common import word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op2_quality_rules", quality_ledger.SQL)
def quality_rules(spark, folder):
    rows = quality_ledger.apply_policy(quality_ledger.ledger(load(spark, folder, "documents")), "v2")
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_ledger.mask_of(quality_ledger.POLICIES["base"])).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


@query("op9_exact_dedup", content_sort.SQL)
def exact_dedup(spark, folder):
    return content_sort.duplicate_groups(load(spark, folder, "documents"), keep="largest")


@query("op7_near_dedup")
def near_dedup(spark, folder):
    return bbit_minhash.near_duplicates(load(spark, folder, "documents"), percent=85)


# Production weights of the corpus: four domains by source, languages inside them, the hub held down.
MIXTURE = {
    ("hub",): 2, ("web",): 4, ("forum",): 3, ("reference",): 3,
    ("hub", "en"): 4, ("web", "en"): 5, ("forum", "en"): 5, ("reference", "en"): 6, ("reference", "de"): 2,
    ("web", "en", "src1"): 2, ("forum", "en", "src7"): 3, ("reference", "en", "src13"): 2,
}
DOMAIN = "case when source = 'src0' then 'hub' when source rlike '^src[1-6]$' then 'web' when source rlike '^src([7-9]|1[0-2])$' then 'forum' else 'reference' end"
PATH = ["domain", "lang", "source"]


@query("op1_mixing")
def mixing_sources(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", word_count("text").alias("tokens"))
    slim = store(docs, "mixing")
    return mixing.mix(slim, PATH, MIXTURE, F.col("tokens"), F.expr("total div 2"), epochs=4)


@query("op6_packing")
def best_fit_packing(spark, folder):
    return packing.pack(load(spark, folder, "documents"), added_tokens=True)


@query("op4_lm_scoring")
def lm_scoring(spark, folder):
    return interpolation.score(load(spark, folder, "documents"))


@query("op3_license_scan")
def license_scan(spark, folder):
    return licenses.scan(load(spark, folder, "documents"))


@query("op10_personal_data")
def personal_data(spark, folder):
    return skip_chain.find(load(spark, folder, "documents"))


@query("op5_warc_derivatives", warc.SQL)
def warc_derivatives(spark, folder):
    return warc.derive(warc.responses_of_pages(load(spark, folder, "pages")))


@query("op8_preference_formatting", preferences.SQL)
def preference_formatting(spark, folder):
    return preferences.format_pairs(preferences.swapped_replies(load(spark, folder, "conversations")))


@query("op11_quality_votes")
def quality_votes(spark, folder):
    return latent_neighbours.score(load(spark, folder, "documents"), load(spark, folder, "labels"))


@query("op12_conversation_repair", turn_repair.SQL)
def conversation_repair(spark, folder):
    return turn_repair.repair(load(spark, folder, "conversations"))


@query("op13_filter_audit", filter_audit.SQL)
def filter_interactions(spark, folder):
    return filter_audit.audit(load(spark, folder, "documents"), load(spark, folder, "labels"))
