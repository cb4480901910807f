"""The thin `opN_*` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, pii, repeats, secrets, simhash, spans, tokens, topk, toxicity, warc
from quire.llm.store import shared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, least_bytes=0)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = warc.read_warc(spark, path, payload=False, verify=True, where={"record_type": ["response"]})  # payloads are read, and checked
    heads = warc.read_warc(spark, path, payload=False, where={"record_type": ["revisit"]})  # responses are skipped by their length
    return whole.select(columns).unionByName(heads.select(columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")), tuple(r.kind for r in secrets.BASE))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), _file("word_bpe_49k.json"), path, width=2)
    return tokens.positions(tokens.read_tokens(spark, path))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(pii.find_pii(_table(spark, sf_dir, "documents")), pii.BASE, scores=True)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(_table(spark, sf_dir, "documents"), _file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.drop("ids")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}
