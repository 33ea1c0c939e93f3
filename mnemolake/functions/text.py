"""String helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as trimmable white space, ASCII punctuation and an English article.
WHITESPACE = " \t\n\r\f\x0b"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
ARTICLES = r"(?U)\b(a|an|the)\b"


def strip(c: Column) -> Column:
    """Trim white space of any kind on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last being an ellipsis when cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n - 1)), F.lit("…")))


def short_label(c: Column, n: int) -> Column:
    """One-line label: trimmed, newlines to blanks, truncated; '' for null."""
    return truncate(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")), n)


def fold_case(c: Column) -> Column:
    """Lower case with sharp s spelled out, so substring search ignores case."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _bare_answer(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), ARTICLES, " ")


def normalize_answer(c: Column) -> Column:
    """Lower-case, drop punctuation and articles, squeeze blanks."""
    return strip(F.regexp_replace(_bare_answer(c), r"(?U)\s+", " "))


def answer_tokens(c: Column) -> Column:
    """Words of the normalised answer."""
    return F.filter(F.split(_bare_answer(c), r"(?U)\s+"), lambda t: t != "")


def token_estimate(c: Column) -> Column:
    """About four characters a token, never less than one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("bigint")


def message_tokens(messages: Column) -> Column:
    """Token estimate of an ARRAY<STRUCT<role, content>>."""
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda acc, m: acc + token_estimate(m["content"]))


def usd(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Cost in dollars; prices are per million tokens."""
    return input_tokens / F.lit(1e6) * price_in + output_tokens / F.lit(1e6) * price_out


def split_system(label: Column) -> tuple[Column, Column]:
    """``A@R=3`` gives ('A', 3); an unreadable round count gives -1."""
    parts = F.split(label, "@R=", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(-1))


def safe_time(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


# Short prefixes of node identifiers in exported graphs.
UID_PREFIX = {"semantic": "sem", "tag": "tag", "procedural": "proc", "subgoal": "sg", "episodic": "epis"}


def node_uid(node_type: Column, node_id: Column) -> Column:
    prefix = F.element_at(
        F.create_map(*[F.lit(x) for pair in UID_PREFIX.items() for x in pair]), node_type
    )
    return F.concat_ws("-", prefix, node_id.cast("string"))


def edge_uid(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws("__", src, kind, dst)


def encode_list(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.array()))


def decode_ids(c: Column) -> Column:
    """JSON list of ids; blank or broken text is an empty list."""
    return F.coalesce(F.from_json(c, "array<bigint>"), F.array().cast("array<bigint>"))


def decode_strings(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def cited_ids(c: Column) -> Column:
    """All n of ``Sem Node n`` in a text."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)Sem\s*Node\s*(\d+)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("bigint"))


# Fixed value: characters stripped off a tag as written by a text model.
TAG_TRIM = "[]\"'`,:;"


def clean_tags(c: Column) -> Column:
    """Comma-separated tag text to a list of distinct clean tags."""
    return F.array_distinct(
        F.transform(F.split(c, ","), lambda t: F.btrim(strip(t), F.lit(TAG_TRIM)))
    )


def tag_input(c: Column) -> Column:
    """User-typed tag list: split on commas, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def ordered_join(order: Column, text: Column, sep: str) -> Column:
    """Aggregate: texts of a group joined in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)
