"""Quality rules with cross-document line frequency, in DataFrame functions only.

A document first has to pass two base rules on its own words. Then its lines are normalised (ASCII lower
case, white-space runs as one space, trimmed) and hashed, and for every host the documents with each line
are counted. A line is above the limits when at least ``min_docs`` documents of the host have it and they
are more than one in ``share_of`` of the host's documents. Such lines are removed, and a document that
loses more than ``max_removed`` percent of its words is rejected as depleted.

Copies of one text on one host count as one document, so a group of copies does not reject itself.

Size: rows are combined per (host, text, line) before the first shuffle and per (host, line) before the
second. A line, a host or a text with a third of all rows is one key only in sums with map-side
combining and in joins that adaptive execution splits. No table is forced to broadcast.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own;
equal rows give equal rows; null ids are kept; other columns of the input are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptscore.llm.words import ascii_lower, split_join, whole, words_of

WINDOW = 8


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words inside windows whose hash in _hashes occurs twice or more.

    Sorting (hash, position) puts equal windows side by side; the words of the chosen windows are
    counted from the gaps between their positions. Each array is a column of its own, because an
    expression inside a lambda would be computed again for every element.
    """
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    df = df.withColumn("_pairs", F.sort_array(F.when(repeated, pairs)))
    last = F.size("_pairs") - 1
    chosen = F.filter(
        "_pairs",
        lambda pair, i: ((i > 0) & (F.get("_pairs", i - 1)["h"] == pair["h"]))
        | ((i < last) & (F.get("_pairs", i + 1)["h"] == pair["h"])),
    )
    df = df.withColumn("_positions", F.sort_array(F.transform(chosen, lambda pair: pair["p"])))
    gaps = F.transform(
        "_positions", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_positions", i + 1) - p, F.lit(WINDOW)))
    )
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda so_far, gap: so_far + gap)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def base_rules(
    docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = whole(F.col(text))
    counted = docs.withColumn("_body", body).withColumn("_words", words_of(F.col("_body")))
    counted = counted.withColumn("_lines", _lines(F.col("_body"))).withColumn(
        "_hashes",
        F.when(
            F.size("_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)),
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    counted = _with_repeats(counted).select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_body") - F.length(F.regexp_replace("_body", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent),
    )


def line_units(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(_host, _text, line, words): words under each normalised line, combined over copies of a text on a host."""
    lines = docs.select(
        F.xxhash64(F.col(host)).alias("_host"),
        F.xxhash64(whole(F.col(text))).alias("_text"),
        F.explode(F.transform(_lines(whole(F.col(text))), lambda line: words_of(ascii_lower(line)))).alias("_line"),
    )
    return (
        lines.select("_host", "_text", F.xxhash64(F.array_join("_line", " ")).alias("line"), F.size("_line").alias("n"))
        .groupBy("_host", "_text", "line")
        .agg(F.sum("n").alias("words"))
    )


def depletion(
    docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = 8, share_of: int = 50
) -> DataFrame:
    """(_host, _text, lost, of): words under lines above the limits and all words, for each text of each host."""
    units = line_units(docs, text, host)
    hosts = (
        docs.select(F.xxhash64(F.col(host)).alias("_host"), F.xxhash64(whole(F.col(text))).alias("_text"))
        .groupBy("_host")
        .agg(F.count_distinct("_text").alias("host_docs"))
    )
    common = (
        units.groupBy("_host", "line")
        .agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= min_docs)
        .join(hosts, "_host")
        .where(F.col("docs") * share_of > F.col("host_docs"))
        .select("_host", "line", F.lit(True).alias("above"))
    )
    return (
        units.join(common, ["_host", "line"], "left")
        .groupBy("_host", "_text")
        .agg(F.sum(F.when(F.col("above"), F.col("words")).otherwise(0)).alias("lost"), F.sum("words").alias("of"))
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = 8,
    share_of: int = 50,
    max_removed: int = 70,
) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and lost_percent of words under removed lines."""
    own = docs.select(F.col(id_col), F.col(text).alias("_source_text"), F.col(host).alias("_source_host"))
    base = base_rules(
        own.select(
            id_col,
            "_source_text",
            F.xxhash64("_source_host").alias("_host"),
            F.xxhash64(whole(F.col("_source_text"))).alias("_text"),
        ),
        "_source_text",
    ).drop("_source_text")
    worn = depletion(own, "_source_text", "_source_host", min_docs, share_of)
    joined = split_join(base, worn, ["_host", "_text"], "left")
    return joined.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("lost", F.lit(0)) * 100 <= F.coalesce("of", F.lit(0)) * max_removed)).alias(
            "kept"
        ),
        F.floor(F.coalesce("lost", F.lit(0)) * 100 / F.greatest(F.coalesce("of", F.lit(1)), F.lit(1))).alias(
            "lost_percent"
        ),
    )
