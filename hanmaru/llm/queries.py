"""Queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, decontaminate, htmltext, langid, lmscore, mixing, negatives, packing, secrets, simhash, substrings, topk, toxicity


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_mixing": mixing.query,
    "op2_substrings": substrings.query,
    "op3_topk": topk.query,
    "op4_htmltext": htmltext.query,
    "op5_secrets": secrets.query,
    "op6_langid": langid.query,
    "op7_lmscore": lmscore.query,
    "op8_decontaminate": decontaminate.query,
    "op9_toxicity": toxicity.query,
    "op10_simhash": op10_simhash,
    "op11_negatives": negatives.query,
    "op12_codebooks": codebooks.query,
    "op13_packing": packing.query,
}
ORACLE = {"op11_negatives": negatives.ORACLE_SQL, "op12_codebooks": codebooks.ORACLE_SQL, "op1_mixing": mixing.ORACLE_SQL, "op2_substrings": substrings.ORACLE_SQL, "op3_topk": topk.ORACLE_SQL, "op5_secrets": secrets.ORACLE_SQL}
