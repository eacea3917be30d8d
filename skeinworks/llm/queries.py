"""Registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import funcdoc, mixing, packing, provenance, sentences, syntax
from .sources import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return funcdoc.documented_functions(table(spark, folder, "nodes"), table(spark, folder, "source_texts")).select("id")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return funcdoc.documented_functions(table(spark, folder, "nodes"), table(spark, folder, "source_texts"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.parsed_files(table(spark, folder, "files"), table(spark, folder, "source_texts")).where("NOT valid").select("path")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.invalid_rates(syntax.parsed_files(table(spark, folder, "files"), table(spark, folder, "source_texts")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.classified(table(spark, folder, "files"), table(spark, folder, "source_texts")).where("size(reasons) > 0").select("path")


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.classified(table(spark, folder, "files"), table(spark, folder, "source_texts"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), table(spark, folder, "container_sizes"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_report(table(spark, folder, "documents"), table(spark, folder, "container_sizes"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "source_targets")
    return mixing.share_report(mixing.mixed(table(spark, folder, "documents"), targets), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents")).select("doc_id", "end_char").distinct()


def p8_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents"))


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods read, and among the pairs ids that occur twice, that are no function, or that have no code though
    their file has the lines."""
    functions, texts = funcdoc.current_functions(table(spark, folder, "nodes")), table(spark, folder, "source_texts")
    pairs = funcdoc.documented_functions(table(spark, folder, "nodes"), texts).groupBy("id").agg(F.count("*").alias("times"), F.count("code").alias("coded"))
    lines = texts.select(F.col("path").alias("file_path"), F.lit(1).alias("has_text"))
    known = functions.select("id", "file_path", F.lit(1).alias("function")).join(lines, "file_path", "left")
    joined = known.join(pairs, "id", "full")
    return joined.agg(F.count("function").alias("functions"), F.count_if(F.expr("times > 1")).alias("repeated"), F.count_if(F.col("function").isNull()).alias("strangers"), F.count_if(F.col("has_text").isNotNull() & (F.col("coded") < F.col("times"))).alias("uncoded"))


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per language, current files with a text, and how many of these could not be judged."""
    parsed = syntax.parsed_files(table(spark, folder, "files"), table(spark, folder, "source_texts"))
    text = table(spark, folder, "source_texts").where("text IS NOT NULL").select("path")
    return parsed.join(text, "path", "left_semi").groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.col("valid").isNull()).alias("unjudged"), F.count_if(~F.col("valid") & F.col("error_line").isNull()).alias("unplaced"))


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per language, current files with a text, and how many have a reason without a sign or a sign without a reason."""
    c = provenance.classified(table(spark, folder, "files"), table(spark, folder, "source_texts"))
    return c.groupBy("language").agg(F.count("*").alias("files"), F.count_if((F.size("reasons") > 0) != (F.size("signs") > 0)).alias("unsigned"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of container, texts placed, containers over the capacity, texts cut though they fit, and numbers left out."""
    kinds = table(spark, folder, "container_sizes")
    placed = cut_lineage(packing.packed(table(spark, folder, "documents"), kinds))
    capacity = kinds.select("container", "capacity_tokens")
    texts = placed.groupBy("container", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).join(capacity, "container").groupBy("container").agg(F.count("*").alias("texts"), F.count_if(F.expr("pieces > 1 AND n <= capacity_tokens")).alias("cut"))
    filled = placed.where("container_no > 0").groupBy("container", "container_no").agg(F.sum("n_tokens").alias("n")).join(capacity, "container").groupBy("container").agg(F.count_if(F.expr("n > capacity_tokens")).alias("overfull"), (F.max("container_no") - F.count("*")).alias("skipped"))
    return texts.join(filled, "container").select("container", "texts", "cut", "overfull", "skipped")


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per target, whether no text is used too often and the tokens are those asked for, but for the last text of each source."""
    targets = table(spark, folder, "source_targets")
    mix = cut_lineage(mixing.mixed(table(spark, folder, "documents"), targets))
    one = mix.agg(F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("whole"), F.count_distinct("source").alias("sources"), F.lit(1).alias("one"))
    shares = mixing.share_report(mix, targets).withColumn("one", F.lit(1)).join(one, "one")
    off = F.abs(F.col("tokens") - F.col("target_share") * F.col("whole"))
    return shares.select("source", "target_share", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (off <= F.col("longest") * F.col("sources")).alias("share_kept"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with sentences, and how many of them have sentences out of order, or signs behind the last one."""
    documents = table(spark, folder, "documents")
    s = sentences.sentences(documents).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("end_char").alias("ends"), F.max("end_char").alias("last"), F.count_if(F.expr("end_char <= start_char")).alias("empty"))
    whole = F.length(F.regexp_replace("text", r"[\s\p{Z}]+$", ""))
    j = s.join(documents.select("doc_id", whole.alias("whole")), "doc_id")
    return j.agg(F.count("*").alias("texts"), F.count_if(F.expr("ends <> n OR empty > 0")).alias("disordered"), F.count_if(F.expr("last <> whole")).alias("unfinished"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p4_found, p4_rates, p5_found, p5_reasons, p6_containers, p6_report, p7_mix, p7_shares, p8_found, p8_sentences, p1_checks, p4_checks, p5_checks, p6_checks, p7_checks, p8_checks)}
