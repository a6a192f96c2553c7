import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from msgrisk import fixed_values as fv, schemas
from msgrisk.functions import domains, privacy, scoring, structure, text, urls
from msgrisk.functions.text import add_text_features
from msgrisk.operators import analytics
from msgrisk.sources import messages as source


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expression(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


MASKED = {
    "mail a.b+c@Example.COM now": "mail [email] now",
    "call +1 (555) 123-4567 now": "call [phone] now",
    "card 4111 1111 1111 1111 ok": "card [phone] ok",
    "key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff end": "key [token] end",
    "1+234567890": "1+[phone]",
    "tel ०१२३ ४५६७८९": "tel [phone]",
    "nothing 1234 here": "nothing 1234 here",
    None: "",
}


def test_masking(spark):
    assert evaluate(spark, list(MASKED), privacy.mask_pii) == list(MASKED.values())


def test_masking_twice_changes_nothing(spark):
    assert evaluate(spark, list(MASKED.values()), privacy.mask_pii) == list(MASKED.values())


def test_local_category(spark):
    given = ["no-reply@x.y", "noreply@x.y", "donotreply@x.y", "alerts@x.y", "update@x.y", "help@x.y", "customer-service@x.y", "bob@x.y", "bob"]
    expected = ["noreply"] * 3 + ["notification"] * 2 + ["support"] * 2 + ["unknown"] * 2
    assert evaluate(spark, given, privacy.local_category) == expected


@pytest.mark.parametrize("key", ["test-key", "k" * 100])
def test_keyed_hash_equals_the_standard(spark, key):
    values = ["attacker@paypa1-secure.example", "", "ünï"]
    expected = [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in values]
    assert evaluate(spark, values, lambda c: privacy.hmac_sha256(c, key)) == expected


def test_canonical_hash_is_the_hash_of_sorted_ascii_json(spark):
    rows = [("a@b.example", "Hi", "Body", "https://b.example", "b"), ("é@b", "\"q\" 😀\n", "हिन्दी \\", "x", "\t")]
    df = spark.createDataFrame(rows, "s string, t string, b string, h string, a string")
    links = F.array(F.struct(F.col("h").alias("href"), F.col("a").alias("anchor_text")))
    got = [r[0] for r in df.select(privacy.canonical_hash(F.col("s"), F.col("t"), F.col("b"), links)).collect()]
    expected = []
    for s, t, b, h, a in rows:
        record = {"sender_email": s, "subject": t, "body_text": b, "links": [{"href": h, "anchor_text": a}]}
        text = json.dumps(record, sort_keys=True, separators=(",", ":"))
        expected.append(hashlib.sha256(text.encode()).hexdigest())
    assert got == expected and expected[0] == "4ebd8b250a2f81d7d0e42dc39a3ad124e0bfea29e3674fd21002dafa829336ab"


def test_hosts(spark):
    given = {
        "https://User:p@WWW.Example.com:8080/a": "www.example.com", "example.org/x": "example.org", "/relative": "",
        "http://[2001:db8::1]/x": "2001:db8::1", "mailto:a@b.c": "b.c", "http://gοogle.com./": "gοogle.com",
        "https://a_b.example?x": "a_b.example", "javascript:void(0)": "javascript",
    }
    assert evaluate(spark, list(given), urls.host_of) == list(given.values())


def test_ip_literals(spark):
    good = ["1.2.3.4", "255.255.255.255", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "::", "fe80::1%eth0", "1::", "1:2:3:4:5:6:7::"]
    bad = ["1.2.3", "256.1.1.1", "01.2.3.4", "1.2.3.4.5", "a.b.c.d", "1:2:3", ":::", "1:2:3:4:5:6:7:8:9", "12345::", "", "1::2::3", "g::1"]
    assert evaluate(spark, good + bad, urls.is_ip_host) == [True] * len(good) + [False] * len(bad)


def test_entropy_and_encoding(spark):
    assert evaluate(spark, ["", "aaaa", "ab", "abcd"], urls.entropy) == [0.0, 0.0, 1.0, 2.0]
    given = {"a": 0, "a%20b": 3, "100%": 1, "%C3%A9": 7, "a+b%2": 1, "%7Bencoded%7D%252Ftracking%252Fvalue%253D%2526": 18}
    assert evaluate(spark, list(given), urls.encoded_characters) == list(given.values())


def test_refang(spark):
    assert evaluate(spark, ["hxxps://a[.]b( . )c", "HXXP://x{.}y"], urls.refang) == ["https://a.b.c", "http://x.y"]


def test_normalize_domain(spark):
    given = {"WWW.Example.com.": "example.com", "Bob <bob@mail.example.org>": "mail.example.org", "x@gοogle.com": "gοogle.com",
             "https://www.a.b/c": "a.b", "": "", None: ""}
    assert evaluate(spark, list(given), domains.normalize_domain) == list(given.values())


def test_random_labels(spark):
    assert evaluate(spark, ["yizpgeaj", "login", "secure", "aaaaaaaa"], domains.random_label_score) == [0.63, 0.0, 0.0, 0.0]


def test_unicode_facts(spark):
    rows = evaluate(spark, ["gοogle.com", "пример.рф", None, "ｇoogle.com"], domains.unicode_facts)
    assert [r["mixed"] if r else None for r in rows] == [True, False, None, False]
    assert rows[3]["folded"] == "google"


def test_text_features_of_odd_texts(spark):
    df = spark.createDataFrame([("", "A b\x1cc\x00 d!! 😀☀"), (None, None)], "subject string, body_text string")
    rows = add_text_features(df).collect()
    assert rows[0]["text"] == "A b c d!! 😀☀" and rows[0]["emoji_count"] == 2 and rows[0]["exclamation_count"] == 2
    assert rows[0]["word_count"] == 4 and rows[1]["word_count"] == 0 and rows[1]["unique_word_ratio"] == 0


def test_structure(spark):
    html = (
        "<!-- x --><style>p{}</style><form><input type=hidden><p hidden>a &amp; b</p>"
        "<div style=\"color:red; display: none\">c</div><b aria-hidden='true' title='hidden'>d</b><i title=\" hidden \">e</i></form>"
    )
    df = spark.createDataFrame([(html, "x"), (None, "x"), ("", "x")], "html string, body_text string")
    rows = structure.add_structure(df).collect()
    assert rows[0]["hidden_element_count"] == 4 and rows[0]["form_tag_presence"] == 1.0
    assert rows[0]["html_to_text_ratio"] == pytest.approx(round(len(html) / len("a & b c d e"), 4))
    assert all(r["html_to_text_ratio"] == 0 and r["form_tag_presence"] == 0 for r in rows[1:])


PAGE = """<html><title>T</title><body><main role="main"><article><div><p>From: PayPal Support &lt;security@paypa1-secure.click&gt;</p>
<p>To: demo@example.com</p><p>Subject: Urgent: verify your account</p></div><p>Hello,</p>
<p>Continue: <a href="/login?x=%7B">paypal.com</a> <a href='mailto:a@b.example'></a></p></article></main></body></html>"""


def test_page_to_message(spark):
    pages = spark.createDataFrame([(1, "https://host.example/a/b?c", PAGE)], "page_id long, url string, html string")
    row = source.pages_to_messages(pages).first()
    assert row["sender_email"] == "a@b.example" and row["subject"] == "Urgent: verify your account"
    assert row["links"][0]["href"] == "https://host.example/login?x=%7B" and row["links"][0]["anchor_text"] == "paypal.com"
    kept = source.pages_to_messages(pages, drop_mailto=True).first()
    assert len(kept["links"]) == 1
    assert pages.select(source.looks_like_mail(F.col("html"), F.col("url"))).first()[0] is True


def test_page_sender_from_header_line(spark):
    pages = spark.createDataFrame([(1, "https://h.example/", PAGE.replace("mailto:", "x:"))], "page_id long, url string, html string")
    row = source.pages_to_messages(pages).first()
    assert row["sender_email"] == "security@paypa1-secure.click" and row["domain"] == "paypa1-secure.click"


SCORES = [
    ((0.94, 0.9, 0.85, 0.8, 1.0, ["test"], False, "unknown"), 0.72, "phishing"),
    ((0.05, 0.0, 0.0, 0.95, 0.0, ["random sender infrastructure"], False, "unknown"), 0.32, "suspicious"),
    ((0.08, 0.0, 0.0, 0.0, 0.0, ["Message contains gambling or prize-lure spam language"], False, "unknown"), 0.34, "suspicious"),
    ((0.08, 0.0, 0.0, 0.0, 0.0, ["URL contains Lookalike brand"], False, "unknown"), 0.38, "suspicious"),
    ((0.2, 0.0, 0.1, 0.0, 0.0, [], True, "noreply"), 0.04, "safe"),
]


def test_fused_scores(spark):
    names = "ml double, imp double, heur double, rep double, reg double, reasons array<string>, trusted boolean, category string"
    df = spark.createDataFrame([s[0] for s in SCORES], names)
    score = scoring.fused_score(*[F.col(c) for c in ("ml", "imp", "heur", "rep", "reg", "reasons", "trusted", "category")])
    rows = df.select(score.alias("s")).select("s", scoring.classification(F.col("s")).alias("c"), scoring.confidence(F.col("s")).alias("f")).collect()
    for row, (_, least, name) in zip(rows, SCORES):
        assert row["s"] >= least and row["c"] == name
    assert rows[0]["f"] == "high" and rows[4]["s"] == 0.04


def test_validation(spark):
    row = dict.fromkeys([f.name for f in schemas.MESSAGE.fields])
    good = dict(row, msg_id=1, client_reasons=["r" * 240])
    long = dict(row, msg_id=3, client_reasons=["r" * 241])
    bad = dict(row, msg_id=2, sender_email="x" * 321, links=[{"href": "h", "anchor_text": "a"}] * 201, heuristic_score=1.5, source="fax", client_reasons=["r"] * 26)
    rows = [tuple(r[f.name] for f in schemas.MESSAGE.fields) for r in (good, bad, long)]
    checked = schemas.validate_messages(schemas.with_defaults(spark.createDataFrame(rows, schemas.MESSAGE)))
    valid, quarantined = schemas.split_valid(checked)
    assert [len(r) for r in valid.first()["client_reasons"]] == [240]
    found = {r["msg_id"]: r["violations"] for r in quarantined.collect()}
    assert found[3] == ["client_reason"]
    assert found[2] == ["sender_email", "links", "heuristic_score", "client_reasons", "source"]


def test_limits_are_taken_as_given(spark):
    rows = spark.range(3000).select("id", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    assert analytics.newest(rows, 2500).count() == 2500
    with pytest.raises(ValueError):
        analytics.newest(rows, -1)


def test_training_columns():
    assert source.detect_columns(["email", "text", "target"]) == ("text", "target")
    with pytest.raises(ValueError):
        source.detect_columns(["text"])


def test_unknown_label_stops_the_job(spark):
    rows = spark.createDataFrame([("t", "maybe")], "text string, label string")
    with pytest.raises(Exception, match="unsupported label"):
        source.training_messages(rows).collect()


def test_every_blank_is_a_space(spark):
    odd = ["a" + c + c + "b" + c for c in "\0" + fv.BLANK_CHARACTERS] + ["", None, "\u1681\u2010\u2fff", "\x01\x1b\x84", " \n\u3000 "]
    shown = ["a b"] * (len(odd) - 5) + ["", "", "\u1681\u2010\u2fff", "\x01\x1b\x84", ""]
    assert evaluate(spark, odd, text.normalize_text) == shown
