"""Message, event and feedback views over the generic test tables.

The tables hold prose, pages and click events but no mail.  The views add the
mail envelope: every document gets one of a few sender templates, some with a
host of its own, so that the number of distinct hosts grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgrisk import fixed_values as fv
from msgrisk.functions import scoring
from msgrisk.schemas import split_valid, validate_feedback

# number, sender, name, subject, lead text, link 1, anchor 1, link 2, anchor 2, html, source
# '{n}' stands for the document id.
TEMPLATES = [
    (0, "security@paypa1-secure.example", "PayPal Support", "Urgent: verify your account",
     "Sign in to verify your account immediately.", "https://paypa1-secure.example/login", "paypal.com",
     None, None, "<form action='/x'><input type='hidden' name='t' value='x'><p>Sign in</p></form>", "gmail"),
    (1, "win@yizpgeaj{n}.fusionrift.uk.net", "Unknown Sender", "Message", "Please review this message.",
     None, None, None, None, None, "outlook"),
    (2, "fun@bluechip{n}.io", "Call Service Bluechip", "Lucky Coin",
     "Lucky Coin Challenge is here. Spin the magic coin for life-changing prizes, cash, free spins, "
     "and rewards. मुफ्त इनाम नकद किस्मत घुमाएं.", None, None, None, None, None, "generic"),
    (3, "help@gοogle.com", "Google", "Password expires soon",
     "Your password expires in 15 minutes. Visit hxxps://accounts-login.cz/google[.]com now.",
     "https://accounts-login.cz/google.com/reset", "google.com", None, None, None, "gmail"),
    (4, "noreply@linkedin.com", "LinkedIn", "Profile view", "Someone viewed your profile.",
     "https://www.linkedin.com/comm/feed/update?trk=%7Bencoded%7D%252Ftracking%252Fvalue", "View profile",
     None, None, None, "gmail"),
    (5, "news@unknown{n}.example", "Unknown", "Profile view", "Someone viewed your profile.",
     "https://unknown{n}.example/track?x=%7Bencoded%7D%252Ftracking%252Fvalue%253D%2526", "View profile",
     None, None, None, "generic"),
    (6, "it@login.microsoftonline.ccisystems.us", "Microsoft", "Password expires soon", "Open the secure page now.",
     "https://accounts-login.cz/google.com/reset", "Google account", "https://bit.ly/3xYzAbC", "Reset password",
     None, "outlook"),
    (7, "alerts@paypal.com.verify{n}.top", "Account Team", "Final notice", "Act now, your account is locked.",
     "http://paypal.com.verify{n}.top/confirm", "www.paypal.com", None, None, None, "generic"),
    (8, "billing@secure-bank-verify.example", "Wells Fargo", "Payment failed", "Invoice overdue, wire transfer required.",
     "https://secure-bank-verify.example/pay", "Pay now", "http://192.168.10.{n}/a%20b", "http://wellsfargo.com",
     None, "generic"),
    (9, "team@example{n}.org", "Planning", "Minutes of the meeting", "Hello all, the minutes are attached.",
     "https://docs.example{n}.org/minutes/{n}", "minutes", None, None, "<p>Hello all</p>", "gmail"),
    (10, "support@xn--pypal-4ve.com", "Pay Pal", "Update credentials", "Login to continue, limited time.",
     "https://xn--pypal-4ve.com/?a=1", "xn--pypal-4ve.com", "https://t.co/abc", "t.co", None, "api"),
    (11, "updates@github.com", "GitHub", "Release notes", "A new release is out!",
     "https://github.com/org/repo{n}/releases", "github.com", None, None, None, "api"),
    (12, "bob@netfl1x-account{n}.com", "Netflix", "Payment failed", "Refund pending, update your password.",
     "https://netfl1x-account{n}.com/pay?id=1+2", "Netflix", None, None,
     "<div hidden>x</div><div style='display:none'>y</div><p aria-hidden='true'>z</p>", "gmail"),
    (13, "carol@mail.partner{n}.co.uk", "Carol", "Quarterly figures", "Please find the figures below.",
     None, None, None, None, None, "outlook"),
    (14, "service@amazon-support.de", "Amazon", "Your order", "Claim your reward, you are the winner of a prize.",
     "https://amazon-support.de/gift", "amazon.de", "https://tinyurl.com/{n}", "gift", None, "generic"),
    (15, "ops@drop-box{n}.click", "Storage", "Quota", "Your storage is full.", "https://drop-box{n}.click/q",
     "http://dropbox.com/q", "//{n}.relay.track.us.com/x", "x", None, "generic"),
]
TEMPLATE_SCHEMA = (
    "tid int, sender_email string, display_name string, subject string, lead string, href1 string, "
    "anchor1 string, href2 string, anchor2 string, html string, source string"
)
HMAC_KEY = "test-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, as a message."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return as_messages(documents)


def as_messages(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    templates = F.broadcast(spark.createDataFrame(TEMPLATES, TEMPLATE_SCHEMA))      # 16 rows
    joined = documents.select("doc_id", "text").withColumn(
        "tid", F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int")
    ).join(templates, "tid")

    def own(name: str):
        return F.replace(F.col(name), F.lit("{n}"), F.col("doc_id").cast("string"))

    links = F.array(
        F.struct(own("href1").alias("href"), F.col("anchor1").alias("anchor_text")),
        F.struct(own("href2").alias("href"), F.col("anchor2").alias("anchor_text")),
    )
    return joined.select(
        F.col("doc_id").alias("msg_id"),
        own("sender_email").alias("sender_email"),
        "display_name",
        "subject",
        F.concat("lead", F.lit(" "), F.col("text")).alias("body_text"),
        "html",
        F.filter(links, lambda l: l["href"].isNotNull()).alias("links"),
        F.substring_index(own("sender_email"), "@", -1).alias("domain"),
        F.lit(0.0).alias("heuristic_score"),
        F.lit(None).cast("string").alias("sender_local_category"),
        F.expr("cast(array() as array<string>)").alias("client_reasons"),
        "source",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 7).cast("int"))).alias("received_at"),
    )


def headed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message whose subject is the text's first line, whole; some are too long for one."""
    first_line = F.substring_index("body_text", "\n", 1)
    return messages(spark, sf_dir).withColumns({"subject": first_line, "client_reasons": F.array(first_line)})


def risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events as event-table rows."""
    return as_risk_events(table(spark, sf_dir, "events"))


def as_risk_events(events: DataFrame) -> DataFrame:
    risk = F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4)
    brand = (
        F.when(F.col("event_type") == "purchase", "PayPal")
        .when(F.col("event_type") == "signup", "Google")
        .when(F.col("event_type") == "error", "Microsoft")
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.sha2(F.col("props"), 256).alias("sample_hash"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("sender_hash"),
        F.sha2(F.col("event_type"), 256).alias("subject_hash"),
        F.concat(F.col("event_type"), F.lit(".example")).alias("domain"),
        F.lit("api").alias("source"),
        risk.alias("risk_score"),
        scoring.classification(risk).alias("classification"),
        scoring.confidence(risk).alias("confidence"),
        brand.alias("impersonated_brand"),
        F.filter(F.array(F.when(risk >= 0.32, F.col("event_type")), F.when(risk >= 0.72, F.lit("high value"))), lambda r: r.isNotNull()).alias("reasons"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid feedback among the events, many per message."""
    valid, _ = split_valid(validate_feedback(as_feedback(table(spark, sf_dir, "events"))))
    return valid


def as_feedback(events: DataFrame) -> DataFrame:
    """Every event as user feedback: clicks and errors are of the known kinds, other types are not; events of
    a value beyond 100 have a risk beyond 1.  Both break rules."""
    risk = F.round(F.col("value") / 100, 4)
    return events.select(
        F.col("event_id").alias("feedback_id"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("sample_hash"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".example")).alias("domain"),
        F.lit("extension").alias("source"),
        risk.alias("current_risk_score"),
        scoring.classification(risk).alias("current_classification"),
        F.when(F.col("event_type") == "click", fv.FEEDBACK_KINDS[0]).when(F.col("event_type") == "error", fv.FEEDBACK_KINDS[1])
        .otherwise(F.col("event_type")).alias("user_feedback"),
        F.array(F.col("event_type")).alias("reasons"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a client."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("client"), "event_id"
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a toxicity label: id, text, label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
