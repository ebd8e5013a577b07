"""The queries on text by name, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import credentials, docpairs, encode, pack, pii
from codelattice.llm.syntax import check
from codelattice.session import stored, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "definitions"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves: code and documentation."""
    return docpairs.documented_functions(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "definitions"), with_text=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check_files(table(spark, sf_dir, "source_files"), "file_id", "file_path", "source_code").select("file_id").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid files by cause, and their share, per repository and language."""
    return check.invalid_rates(table(spark, sf_dir, "source_files"), "file_id", "file_path", "source_code", "repo")


def p4_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invalid files with cause, cost of repair (the sum of its units' least costs) and the line of the first edit."""
    checked = check.check_files(table(spark, sf_dir, "source_files"), "file_id", "file_path", "source_code", details=True)
    return checked.where("invalid").select("file_id", "language", "cause", "cost", "line")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "source_files"), "file_id", "source_code").select("file_id", "line").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with its credentials redacted; repeated rows count once."""
    return credentials.redact_credentials(table(spark, sf_dir, "source_files"), "file_id", "source_code").dropDuplicates(["file_id"])


def p5_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with credentials, and credentials by kind, per repository."""
    found = credentials.find_credentials(table(spark, sf_dir, "source_files"), "file_id", "source_code")
    repos = table(spark, sf_dir, "source_files").select("file_id", "repo").distinct()
    return repos.join(found, "file_id").groupBy("repo", "kind").agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("credentials"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(encode.token_lengths(table(spark, sf_dir, "documents"), ["doc_id"], "text"), "token-lengths")
    return pack.pack(sizes, "doc_id", "n_tokens", table(spark, sf_dir, "context_windows"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir)


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: containers in use, the least number that could do, and the share of space in use."""
    each = packed_documents(spark, sf_dir).groupBy("window_id", "container").agg(F.sum("n_tokens").alias("used"))
    by = each.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    caps = table(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens")
    return by.join(F.broadcast(caps), "window_id").select(
        "window_id", "capacity_tokens", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("share_used"),
    )


def p7_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window what must hold of a packing: no container above the capacity, no text cut that fits, every document in it, all pieces of it."""
    packed = packed_documents(spark, sf_dir)
    used = packed.groupBy("window_id", "container").agg(F.sum("n_tokens").alias("used")).groupBy("window_id").agg(F.max("used").alias("fullest"))
    docs = packed.groupBy("window_id", "doc_id").agg(F.countDistinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"))
    caps = F.broadcast(table(spark, sf_dir, "context_windows").select("window_id", F.col("capacity_tokens").cast("bigint").alias("c")).distinct())  # five rows
    whole = docs.join(caps, "window_id").withColumn("whole", (F.col("pieces") == F.greatest(F.ceil(F.col("tokens") / F.col("c")), F.lit(1))) & (F.col("pieces") == F.col("last") + 1))
    per = whole.groupBy("window_id").agg(F.count("*").alias("documents"), F.count_if(~F.col("whole")).alias("wrongly_cut"), F.sum("tokens").alias("_t"))
    return per.join(used, "window_id").join(caps, "window_id").select("window_id", "documents", "wrongly_cut", (F.col("fullest") <= F.col("c")).alias("holds"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pii_type", "start_pos").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its mentions replaced by typed placeholders."""
    return pii.redact_pii(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_rates": p4_rates, "p4_repairs": p4_repairs, "p5_found": p5_found, "p5_redacted": p5_redacted, "p5_by_repo": p5_by_repo, "p6_ids": p6_ids, "p7_pack": p7_pack, "p7_usage": p7_usage, "p7_holds": p7_holds}
ORACLES: dict[str, str] = {
    "p7_holds": "SELECT CAST(window_id AS INTEGER) AS window_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS wrongly_cut, true AS holds FROM (SELECT DISTINCT window_id FROM context_windows)",
}
