"""One registered query per operator: the operator with its production
parameters over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.llm import bitplane, conversation_repair, embed_dedup, minhash_cps, mixing, packing, pii, quality_rules, ranked_search, rendezvous, sql, toxicity, url_reputation, warc
from keepwise.llm.common import read_table
from keepwise.llm.files import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


@query("op1_quality_rules", sql.QUALITY_RULES)
def op1(spark, sf_dir):
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op5_block_mixing")
def op5(spark, sf_dir):
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"))


@query("op6_naive_bayes_grams")
def op6(spark, sf_dir):
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_int8_tiles")
def op7(spark, sf_dir):
    return embed_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


@query("op8_context_bootstrap")
def op8(spark, sf_dir):
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


@query("op9_url_reputation", sql.URL_REPUTATION)
def op9(spark, sf_dir):
    return url_reputation.url_filter(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


@query("op2_chosen_path")
def op2(spark, sf_dir):
    return minhash_cps.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op3_seekable_warc", sql.WARC)
def op3(spark, sf_dir):
    index = warc.write_archive(read_table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return warc.read_archive(index).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                           "record_type", "refers_to")


@query("op4_concat_and_cut")
def op4(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents")).drop("ids")


@query("op10_bit_planes")
def op10(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return bitplane.token_files(docs, shared_folder(spark, "token-planes")).drop("ids")


@query("op11_range_maximum", sql.RANKED_SEARCH)
def op11(spark, sf_dir):
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op12_rendezvous", sql.RENDEZVOUS)
def op12(spark, sf_dir):
    return rendezvous.sharded(read_table(spark, sf_dir, "documents"), shared_folder(spark, "shards"))


@query("op13_deepening_repair", sql.CONVERSATION_REPAIR)
def op13(spark, sf_dir):
    return conversation_repair.repair_conversations(read_table(spark, sf_dir, "conversations"))
