"""Queries and oracle SQL of the training-text problems 2, 3 and 5 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.garbled import find_garbled
from pagemill.llm.leaks import find_leaks, leak_report
from pagemill.llm.mixing import mix_sources
from pagemill.llm.residue import RULE_NAMES, find_residue, fit_model, without_residue
from pagemill.llm.splitting import split_pieces
from pagemill.llm.visual import print_classes, same_print_pairs, with_forms
from pagemill.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "spans"), "span_id", ["text", "font"]).select(F.col("id").alias("span_id"), "field")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "spans"), "span_id", ["text", "font"]).withColumnRenamed("id", "span_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_pieces(table(spark, d, "page_markdown"), table(spark, d, "split_limits"), oversized_only=True)
    return pieces.filter("piece_no = 0").select(F.col("id").alias("md_id"), "cut_kind")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_pieces(table(spark, d, "page_markdown"), table(spark, d, "split_limits")).withColumnRenamed("id", "md_id")


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: the new parts of the pieces of a text put together again, the longest piece
    against the limit, and whether every repeated part is what the piece before ended with."""
    pieces = p3_pieces(spark, d)
    one = pieces.groupBy("md_id", "profile").agg(F.sort_array(F.collect_list(F.struct("piece_no", "overlap", "piece"))).alias("p"))  # the pieces of one text
    lim = table(spark, d, "split_limits").select("profile", "max_chars")
    new = F.concat_ws("", F.transform("p", lambda x: F.substring(x["piece"], x["overlap"] + 1, F.length(x["piece"]))))
    again = F.forall(F.sequence(F.lit(1), F.size("p")), lambda k: (k == 1) | (F.substring(F.get("p", k - 1)["piece"], F.lit(1), F.get("p", k - 1)["overlap"]) == F.right(F.get("p", k - 2)["piece"], F.get("p", k - 1)["overlap"])))
    return one.join(F.broadcast(lim), "profile").select("md_id", F.md5(new.cast("binary")).alias("text_md5"), (F.array_max(F.transform("p", lambda x: F.length(x["piece"]))) <= F.col("max_chars")).alias("fits"), again.alias("repeats_end"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return same_print_pairs(table(spark, d, "spans"), "span_id", "doc_id", "text", "loaded_at").toDF("span_id_a", "span_id_b")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return print_classes(table(spark, d, "spans"), "span_id", "doc_id", "text", "loaded_at").withColumnRenamed("id", "span_id")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return with_forms(table(spark, d, "spans").select("span_id", "text"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(p6_leaks(spark, d))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pages(spark, d).select("doc_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return without_residue(documents, find_residue(documents)).select("doc_id", "lang", "source", "n_chars", "text")


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    """Figures of windows of unseen newspapers against their weak labels: with all rules, and
    with the first third of the rules left out."""
    documents = table(spark, d, "documents")
    rows = [("all rules", *fit_model(documents)[1].values())]
    rows.append(("without a third", *fit_model(documents, skip=frozenset(RULE_NAMES[::3]))[1].values()))
    return spark.createDataFrame(rows, "rules string, train_windows double, held_windows double, held_positive double, held_unlisted double, precision double, recall double, recall_unlisted double")


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_cover": p3_cover, "p5_found": p5_found, "p5_classes": p5_classes, "p5_forms": p5_forms, "p6_found": p6_found, "p6_items": p6_items, "p7_selection": p7_selection, "p7_shares": p7_shares, "p8_found": p8_found, "p8_pages": p8_pages, "p8_clean": p8_clean, "p8_validation": p8_validation}

ORACLES = {
    "p3_cover": """
WITH m AS (SELECT md_id, arg_max(md_string, made_at) AS s, arg_max(profile, made_at) AS profile FROM page_markdown WHERE md_string IS NOT NULL GROUP BY md_id)
SELECT md_id, md5(s) AS text_md5, true AS fits, true AS repeats_end FROM m JOIN split_limits USING (profile) WHERE s <> ''""",
    "p3_found": r"""
WITH m AS (SELECT md_id, arg_max(md_string, made_at) AS s, arg_max(profile, made_at) AS profile FROM page_markdown WHERE md_string IS NOT NULL GROUP BY md_id)
SELECT md_id, CASE WHEN list_max(list_transform(regexp_split_to_array(s, '[ \t\r\n]'), lambda x: length(x))) > max_chars THEN 'forced' ELSE 'natural' END AS cut_kind
FROM m JOIN split_limits USING (profile) WHERE length(s) > max_chars""",
}
