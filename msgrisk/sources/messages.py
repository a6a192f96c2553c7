"""Message, page and training-set sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions import structure, urls
from msgrisk.functions.text import bind, normalize_text, text_or_empty
from msgrisk.schemas import MESSAGE, with_defaults

_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a\s*>"""
_HEADER = r"(?im)^\s*(?:from|sender|subject|to):"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON messages with the fixed schema and defaults for absent fields."""
    return with_defaults(spark.read.schema(MESSAGE).json(path))


def stream_messages(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.readStream.schema(MESSAGE).json(path))


# ------------------------------------------------------------------------ pages
def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link found on a page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^#]*", 0)
    plain = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(F.length(plain) > F.length(origin), F.regexp_extract(plain, r"^.*/", 0)).otherwise(
        F.concat(origin, F.lit("/"))
    )
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("#")), F.concat(page, href))
        .when(F.startswith(href, F.lit("?")), F.concat(plain, href))
        .when(href == "", page)
        .otherwise(F.concat(folder, href))
    )


def page_links(fragment: Column, base: Column, drop_mailto: bool = False) -> Column:
    """Anchors of a fragment; an empty anchor text falls back to the link itself."""
    tags = F.regexp_extract_all(fragment, F.lit(_ANCHOR), F.lit(0))

    def link(tag: Column) -> Column:
        raw = F.concat(*[F.regexp_extract(tag, _ANCHOR, i) for i in (1, 2, 3)])
        written = structure.decode_entities(structure.strip_blanks(raw))
        text = F.array_join(structure.text_lines(F.regexp_extract(tag, _ANCHOR, 4)), " ")
        parts = F.struct(bind(written, lambda h: resolve(h, base)).alias("href"), text.alias("text"))
        shown = lambda p: F.when(p["text"] != "", p["text"]).otherwise(p["href"])
        return bind(parts, lambda p: F.struct(p["href"].alias("href"), shown(p).alias("anchor_text")))

    found = F.transform(tags, link)
    if drop_mailto:
        found = F.filter(found, lambda l: ~F.startswith(F.lower(l["href"]), F.lit("mailto:")))
    return found


def pages_to_messages(pages: DataFrame, drop_mailto: bool = False) -> DataFrame:
    """One message per page (columns ``page_id``, ``url``, ``html``)."""
    parts = pages.withColumn("_root", structure.main_part(F.col("html"))).withColumn(
        "_lines", structure.text_lines(F.col("_root"))
    )
    parts = parts.withColumn("body_text", F.array_join("_lines", "\n"))
    body = F.col("body_text")
    mailto = urls.first_address(F.regexp_extract("html", r"""(?is)\bhref\s*=\s*["']?mailto:([^"'>\s]*)""", 1))
    from_line = F.regexp_extract(
        body, r"(?i)from:[^\n]*?([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})", 1
    )
    sender = F.when(mailto != "", mailto).otherwise(from_line)
    subject = F.regexp_extract(body, r"(?i)subject:\s*([^\n]+)", 1)
    heading = F.array_join(
        structure.text_lines(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)), " "
    )
    title = F.array_join(
        structure.text_lines(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), " "
    )
    has_heading = F.col("html").rlike(r"(?i)<h1\b")
    staged = parts.withColumns({"sender_email": sender, "_subject": subject, "_heading": heading, "_title": title})
    subject, heading, title = F.col("_subject"), F.col("_heading"), F.col("_title")
    return staged.select(
        F.col("page_id").alias("msg_id"),
        "sender_email",
        F.regexp_extract(body, r"(?i)from:\s*([^\n]+)", 1).alias("display_name"),
        F.when(subject != "", subject).when(has_heading, heading).otherwise(title).alias("subject"),
        "body_text",
        F.lit(None).cast("string").alias("html"),
        page_links(F.col("_root"), F.col("url"), drop_mailto).alias("links"),
        F.when(F.contains("sender_email", F.lit("@")), F.substring_index("sender_email", "@", -1))
        .otherwise(urls.host_of(F.col("url")))
        .alias("domain"),
        F.lit("generic").alias("source"),
    )


def looks_like_mail(html: Column, url: Column) -> Column:
    """The page shows mail header lines or has a mailto link, and is not webmail."""
    shown = F.array_join(structure.text_lines(structure.without_unseen(html)), "\n")
    host = urls.host_of(url)
    webmail = (host == "mail.google.com") | F.contains(host, F.lit("outlook."))
    mailto = html.rlike(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']?mailto:""")
    return ~webmail & (shown.rlike(_HEADER) | mailto)


def longest_block(html: Column) -> Column:
    """The longest text block of a page (the first one on ties)."""
    lines = structure.text_lines(structure.main_part(html))
    ranked = F.transform(
        lines, lambda line, i: F.struct(F.length(line).alias("n"), (-i).alias("order"), line.alias("line"))
    )
    return F.coalesce(F.array_max(ranked)["line"], F.lit(""))


# ----------------------------------------------------------------- training data
def detect_columns(columns: list[str]) -> tuple[str, str]:
    """Text and label column by priority of their names."""
    text = next((c for c in fv.TEXT_COLUMN_CANDIDATES if c in columns), None)
    label = next((c for c in fv.LABEL_COLUMN_CANDIDATES if c in columns), None)
    if not text or not label:
        raise ValueError(
            "need a text column (" + ", ".join(fv.TEXT_COLUMN_CANDIDATES) + ") and a label column ("
            + ", ".join(fv.LABEL_COLUMN_CANDIDATES) + ")"
        )
    return text, label


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )


def normalize_label(col: Column) -> Column:
    """1, 0, or null for a label that is neither."""
    value = F.lower(F.btrim(col.cast("string")))
    return F.when(value.isin(fv.LABEL_POSITIVE), 1).when(value.isin(fv.LABEL_NEGATIVE), 0)


def training_messages(rows: DataFrame, id_col: str | None = None) -> DataFrame:
    """Labelled rows as messages: links cut from the text, labels as 0/1.

    An unknown label stops the job, as a silent drop would change the training set.
    """
    text, label = detect_columns(rows.columns)
    optional = ["sender_email", "display_name", "subject", "domain", "html"]
    ident = F.col(id_col) if id_col else F.monotonically_increasing_id()
    number = normalize_label(F.col(label))
    checked = F.when(number.isNotNull(), number).otherwise(
        F.raise_error(F.concat(F.lit("unsupported label value: "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    )
    return rows.select(
        ident.alias("msg_id"),
        text_or_empty(F.col(text)).alias("body_text"),
        urls.urls_in_text(F.col(text)).alias("links"),
        checked.cast("int").alias("label"),
        *[
            (text_or_empty(F.col(c)) if c in rows.columns else F.lit("")).alias(c)
            for c in optional
        ],
    )


def deduplicate_texts(rows: DataFrame, text: str, row_id: str) -> DataFrame:
    """Keep the lowest id of each normalised text.

    Only a hash and an id are grouped; the texts never move through the grouping,
    and a text repeated very often shrinks to one row per task before the shuffle.
    """
    digest = F.sha2(F.lower(normalize_text(F.col(text))), 256)
    kept = rows.groupBy(digest.alias("_digest")).agg(F.min(row_id).alias(row_id)).select(row_id)
    return rows.join(kept, row_id, "left_semi")
