"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motorgrid.llm import (
    bpe, exact_dedup, id_files, lattice, mixing, negatives, ordinal, page_text, prefix_trie,
    quality_rules, simhash, tool_calls, warc,
)
from motorgrid.llm.common import LOWER, UPPER, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n
           FROM pages),
k AS (SELECT html, max(page_id) AS first_id FROM p WHERE n >= {warc.LEAST_REVISIT} GROUP BY html)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
    CASE WHEN k.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN k.first_id <> p.page_id THEN k.first_id END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html AND p.n >= {warc.LEAST_REVISIT}
""")
def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op2_simhash_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op3_mixing", mixing.sql())
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op4_id_files")
def id_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return id_files.read_documents(id_files.write_ids(docs, VOCABULARY))


@query("op5_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_scores(table(spark, sf_dir, "documents"))


@query("op6_page_text")
def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


@query("op7_tool_calls", tool_calls.SQL)
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_conversations(table(spark, sf_dir, "conversations"))


@query("op8_bpe")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


@query("op9_exact_dedup", f"""
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
""")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_ordinal")
def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    grades = labels.select(
        "doc_id", ordinal.grade(labels["quality"], labels["toxic"]).alias("grade"))
    return ordinal.rate(docs, ordinal.fit_on(docs, grades))


@query("op11_prefix_trie", prefix_trie.SQL)
def trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_lattice_near_dedup")
def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", negatives.SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))
