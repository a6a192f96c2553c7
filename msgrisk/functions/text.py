"""Text features as column expressions (no shuffle, no Python)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk import fixed_values as fv

_OTHER_BLANKS = "\0" + fv.BLANK_CHARACTERS.replace(" ", "")
_NARROW_BLANKS = "[" + "".join(rf"\x{ord(c):02x}" for c in _OTHER_BLANKS if ord(c) < 0x100) + "]"
_WIDE_BLANKS = "".join(c for c in _OTHER_BLANKS if ord(c) >= 0x100)
_MAYBE_WIDE = rf"[\x{{{ord(min(_WIDE_BLANKS)):X}}}-\x{{{ord(max(_WIDE_BLANKS)):X}}}]"
_EMOJI_CLASS = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in fv.EMOJI_RANGES)

PHRASE_LISTS = {
    "urgency_keyword_count": fv.URGENCY_PHRASES,
    "credential_phrase_count": fv.CREDENTIAL_PHRASES,
    "high_risk_phrase_count": fv.HIGH_RISK_PHRASES,
    "spam_lure_keyword_count": fv.SPAM_LURE_PHRASES,
    "gambling_keyword_count": fv.GAMBLING_PHRASES,
    "hindi_spam_lure_count": fv.HINDI_LURE_PHRASES,
}


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside a lambda over an array a captured expression would be computed again
    for every element; bound like this it is a plain variable there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flag(condition: Column) -> Column:
    """A 0.0/1.0 flag; null counts as false."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def normalize_text(col: Column) -> Column:
    """Blanks collapsed to one space and trimmed.

    All blanks become spaces first: the pattern is then a plain run of spaces,
    several times faster than a class of all blanks.  Those of one byte in Latin-1,
    listed one by one, are a bit set for the matcher; the others are replaced only
    in texts that may hold one.
    """
    narrow = F.regexp_replace(text_or_empty(col), _NARROW_BLANKS, " ")
    spaced = F.when(
        narrow.rlike(_MAYBE_WIDE), F.translate(narrow, _WIDE_BLANKS, " " * len(_WIDE_BLANKS))
    ).otherwise(narrow)
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def tokens(lowered: Column) -> Column:
    """Runs of letters a-z and digits, matched as such: splitting at the gaps between them is slower.  The class with
    the two extra letters is many times slower, so it is used only for texts that contain one of them."""
    extra = [F.contains(lowered, F.lit(letter)) for letter in fv.TOKEN_EXTRA_LETTERS]
    run = fv.TOKEN_GAP.replace("^", "")
    wide = run.replace("]", fv.TOKEN_EXTRA_LETTERS + "]")
    return F.when(extra[0] | extra[1], F.regexp_extract_all(lowered, F.lit(wide), F.lit(0))).otherwise(
        F.regexp_extract_all(lowered, F.lit(run), F.lit(0))
    )


def phrase_count(lowered: str, phrases: list[str]) -> Column:
    """How many of the phrases occur in a column (each once, however often it occurs).

    A plain sum of tests, so it compiles into the generated code of the stage.
    """
    hits = " + ".join(f"cast(contains({lowered}, '{p}') as int)" for p in phrases)
    return F.expr(f"cast({hits} as double)")


def emoji_count(col: Column) -> Column:
    """Emoji of a text.  Everything below the first emoji range is removed with one
    simple class before the ten ranges are looked at."""
    rest = F.regexp_replace(col, r"[\x00-\u25FF]+", "")
    return count_kept(rest, f"[^{_EMOJI_CLASS}]+").cast("double")


def count_kept(col: Column, dropped: str) -> Column:
    """Number of characters left after deleting what ``dropped`` matches."""
    return F.length(F.regexp_replace(col, dropped, ""))


def defanged_count(col: Column) -> Column:
    """Defanged or plain URL indicators.  Texts without '://' or '[.]' skip the regex."""
    candidate = F.contains(col, F.lit("://")) | F.contains(col, F.lit("[.]"))
    hits = F.regexp_count(col, F.lit(fv.DEFANGED_PATTERN))
    return F.when(candidate, hits).otherwise(F.lit(0)).cast("double")


def promotional_score(lure: Column, gambling: Column, hindi: Column, emoji: Column) -> Column:
    total = lure * 0.16 + gambling * 0.18 + hindi * 0.16 + F.least(emoji / 8, F.lit(1.0)) * 0.18
    return F.round(F.least(total, F.lit(1.0)), 4)


def add_text_features(df: DataFrame, subject: str = "subject", body: str = "body_text") -> DataFrame:
    """Add the 13 text features and ``text`` (normalised subject and body).

    Three narrow projections: each names the expensive strings once, so the
    optimizer keeps them as columns instead of repeating them per feature.
    """
    joined = F.concat(text_or_empty(F.col(subject)), F.lit(" "), text_or_empty(F.col(body)))
    staged = (
        df.withColumn("text", normalize_text(joined))
        .withColumn("_lower", F.lower("text"))
        .withColumn("_tokens", tokens(F.col("_lower")))
    )
    counted = staged.withColumns(
        {
            "word_count": F.size("_tokens").cast("double"),
            "_distinct": F.size(F.array_distinct("_tokens")).cast("double"),
            "_length": F.greatest(F.length("text"), F.lit(1)).cast("double"),
            "_upper": count_kept(F.col("text"), r"\P{IsUppercase}+").cast("double"),
            "exclamation_count": (
                F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit("")))
            ).cast("double"),
            "emoji_count": emoji_count(F.col("text")),
            "defanged_url_count": defanged_count(F.col("text")),
            **{name: phrase_count("_lower", ps) for name, ps in PHRASE_LISTS.items()},
        }
    )
    return counted.withColumns(
        {
            "unique_word_ratio": F.when(
                F.col("word_count") > 0, F.round(F.col("_distinct") / F.col("word_count"), 4)
            ).otherwise(F.lit(0.0)),
            "uppercase_ratio": F.round(F.col("_upper") / F.col("_length"), 4),
            "promotional_spam_score": promotional_score(
                F.col("spam_lure_keyword_count"),
                F.col("gambling_keyword_count"),
                F.col("hindi_spam_lure_count"),
                F.col("emoji_count"),
            ),
        }
    ).drop("_lower", "_tokens", "_distinct", "_length", "_upper")
