"""HTML structure features and page text by pattern, inside Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions.text import bind, flag, text_or_empty

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TAG = rf"</?[a-zA-Z]{_ATTRS}>|<[!?][^>]*>"
_OPEN_TAG = rf"<[a-zA-Z]{_ATTRS}>"
_UNSEEN = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
_EDGE_BLANKS = rf"^[{fv.BLANKS}]+|[{fv.BLANKS}]+$"
_VALUES = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
_BLOCK_END = r"(?i)<br\b[^>]*>|</(?:p|div|h[1-6]|li|tr|article|main|section|blockquote)\s*>"


def decode_entities(col: Column) -> Column:
    """Character references as one character each (the blank ones as a blank)."""
    value = F.regexp_replace(col, r"&(?:nbsp|#160|#[xX][aA]0);", "\u00a0")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'")):
        value = F.replace(value, F.lit(f"&{name};"), F.lit(char))
    value = F.regexp_replace(value, r"&(?!amp;)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", "\u00b7")
    return F.replace(value, F.lit("&amp;"), F.lit("&"))


def strip_blanks(col: Column) -> Column:
    return F.regexp_replace(col, _EDGE_BLANKS, "")


def without_unseen(html: Column) -> Column:
    """HTML without script, style, template and comment parts."""
    return F.regexp_replace(html, _UNSEEN, "<!>")


def visible_pieces(seen: Column) -> Column:
    """Texts between the tags, trimmed, empty ones dropped."""
    pieces = F.transform(F.split(seen, _TAG), lambda p: strip_blanks(decode_entities(p)))
    return F.filter(pieces, lambda p: p != "")


def visible_text(seen: Column) -> Column:
    return F.array_join(visible_pieces(seen), " ")


def hidden_elements(seen: Column) -> Column:
    tags = F.regexp_extract_all(seen, F.lit(_OPEN_TAG), F.lit(0))

    def is_hidden(tag: Column) -> Column:
        names = F.regexp_replace(tag, _VALUES, "=")
        return (
            names.rlike(r"(?i)\shidden[\s=/>]")
            | tag.rlike(r"""(?i:\saria-hidden\s*=\s*)["']?true["'\s/>]""")
            | tag.rlike(r"""(?i)^<input\b.*\stype\s*=\s*["']?hidden["'\s/>]""")
            | tag.rlike(r"""(?i:\sstyle\s*=\s*)(?:"[^"]*|'[^']*)(?:display: ?none|visibility:hidden)""")
        )

    return F.size(F.filter(tags, is_hidden))


def add_structure(df: DataFrame, html: str = "html", body: str = "body_text") -> DataFrame:
    """Ratio of markup to text, form presence and hidden-element count; 0 without HTML."""
    page = F.col(html)
    has_html = F.coalesce(page != "", F.lit(False))
    staged = df.withColumn("_seen", F.when(has_html, without_unseen(page)))
    staged = staged.withColumn("_shown", F.length(visible_text(F.col("_seen"))))
    text_length = F.when(F.col("_shown") > 0, F.col("_shown")).otherwise(F.length(text_or_empty(F.col(body))))
    ratio = F.round(F.length(page) / F.greatest(text_length, F.lit(1)), 4)
    return staged.withColumns(
        {
            "html_to_text_ratio": F.when(has_html, ratio).otherwise(F.lit(0.0)),
            "form_tag_presence": flag(F.col("_seen").rlike(r"(?i)<form[\s/>]")),
            "hidden_element_count": F.when(has_html, hidden_elements(F.col("_seen"))).otherwise(F.lit(0)).cast("double"),
        }
    ).drop("_seen", "_shown")


def main_part(html: Column) -> Column:
    """The first article or main element, else the body, else everything."""

    def first_filled(value: Column, fallback: Column) -> Column:
        return bind(value, lambda v: F.when(v != "", v).otherwise(fallback))

    def pick(seen: Column) -> Column:
        root = F.regexp_extract(seen, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
        body = F.regexp_extract(seen, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
        return first_filled(root, first_filled(body, seen))

    return bind(without_unseen(text_or_empty(html)), pick)


def text_lines(fragment: Column) -> Column:
    """Text of a fragment, one line per block, as a browser would show it."""
    broken = F.regexp_replace(F.regexp_replace(fragment, r"\s+", " "), _BLOCK_END, "\n")
    bare = decode_entities(F.regexp_replace(broken, _TAG, ""))
    lines = F.transform(F.split(bare, "\n"), strip_blanks)
    return F.filter(lines, lambda line: line != "")
