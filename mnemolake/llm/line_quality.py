"""Quality rules: lines that too many documents of a host share, and documents that are little else.

Lines are normalised (lower case, digits as 0, runs of other characters as one space) and hashed. Per host and line,
the different texts that hold it are counted, texts being equal if their normalised lines are, so that a group of copies
counts once. A line is taken out if ``MIN_TEXTS`` texts or more and more than ``HOST_PERCENT`` percent of the host's texts
hold it, or if more than ``MANY_TEXTS`` do, whatever their share; a document is rejected when too little of it is left. Word counts of the document itself come first (too short, or mostly repeated three-word
runs). All of it is column expressions.

Defined results: a missing text has no word; rows without source form one host; a line counts once per
text however often it stands there; repeated rows are judged one by one and count as one text; lines without letters or digits
are neither counted nor removed; an empty table gives no row. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import SPACES, WORD, keyed, let, saved, text_of

MIN_WORDS = 50
REPEAT_SHARE = 50
#: A line goes when this many different texts or more, and more than this percentage of its host's, hold it.
MIN_TEXTS = 5
HOST_PERCENT = 2
#: It also goes when more different texts than this hold it.
MANY_TEXTS = 100
#: A document is depleted when less than this share of its words stands outside such lines.
LEFT_SHARE = 0.5
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more.

    Windows are sorted by hash with their place; those with an equal neighbour are repeated. Their places in
    order, each covers three words less what the next one covers again.
    """
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.cast("int").alias("at"))))

    def places(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["at"]))

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda at, i: F.coalesce(F.least(F.get(p, i + 1) - at, F.lit(3)), F.lit(3)))
        return F.aggregate(widths, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return F.coalesce(let(let(F.sort_array(windows), places), covered), F.lit(0).cast("bigint"))


def line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d", "0"), r"[^\p{L}\p{N}]+", " "))


def document_measures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, host, words and the four counts, base_failed, lines): lines as (hash, words), one entry per line."""
    rows, key = keyed(docs)
    text = text_of(rows)
    lines = F.split(text, "\n", -1)
    wordy = F.filter(lines, lambda x: x.rlike(WORD))
    measured = rows.select(
        F.col(key).alias("row"),
        rows["doc_id"].alias("doc_id"),
        rows["source"].cast("string").alias("host"),
        let(F.filter(F.split(text, SPACES + "+", -1), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("repeat"))).alias("words"),
        F.length(F.regexp_replace(text, SPACES + "+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(wordy, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
        F.filter(
            F.transform(wordy, lambda x: let(normal_line(x), lambda y: F.struct(F.when(y != "", F.xxhash64(y)).alias("hash"), line_words(x).alias("words")))),
            lambda x: x["hash"].isNotNull(),
        ).alias("lines"),
    )
    n, repeat = F.col("words.n"), F.col("words.repeat")
    return measured.select(
        "row", "doc_id", "host", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (repeat * 100 > n * REPEAT_SHARE)).alias("base_failed"), "lines",
    )


def judged(docs: DataFrame, *, min_texts: int = MIN_TEXTS, host_percent: int = HOST_PERCENT, many_texts: int = MANY_TEXTS, left_share: float = LEFT_SHARE) -> DataFrame:
    """Each document with its measures, ``removed_words`` in lines above the limit, and ``kept``."""
    measured = saved(document_measures(docs).withColumn("content", F.xxhash64("lines.hash")), "measures")
    hosts = measured.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    # the same line of one document is one entry with its words added up
    lines = measured.select("row", "host", "content", F.explode("lines").alias("line")).select("row", "host", "content", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    held = lines.groupBy("row", "host", "hash").agg(F.sum("words").alias("words"))
    per_line = lines.groupBy("host", "hash", "content").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    common = per_line.where(n >= min(min_texts, many_texts + 1)).withColumnRenamed("host", "of").join(hosts, F.col("of").eqNullSafe(F.col("host")))
    common = saved(common.where(((n >= min_texts) & (n * 100 > F.col("texts") * host_percent)) | (n > many_texts)).select("of", "hash"), "common")
    removed = held.join(common, (held["hash"] == common["hash"]) & held["host"].eqNullSafe(common["of"])).groupBy("row").agg(F.sum("words").alias("removed_words"))
    found = measured.drop("lines", "content").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
    depleted = (F.col("n_words") - F.col("removed_words")) < F.col("n_words") * left_share
    return found.select(*[c for c in found.columns if c != "row"], (~F.col("base_failed") & ~depleted).alias("kept"))
