"""Message fixtures: each row states a message and what must come out of it."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import check
from __spark_entry__ import oracle_sql
from msgrisk import Registry, assess
from msgrisk.plans import assess as plan, catalog
from msgrisk.schemas import MESSAGE, with_defaults

FIELDS = [f.name for f in MESSAGE.fields]


def message(msg_id, sender, name, subject, body, links=(), html=None, **more):
    row = dict.fromkeys(FIELDS)
    row.update(
        msg_id=msg_id, sender_email=sender, display_name=name, subject=subject, body_text=body, html=html,
        links=[{"href": h, "anchor_text": a} for h, a in links], domain=sender.split("@")[-1], **more,
    )
    return tuple(row[f] for f in FIELDS)


BRAND_LOOKALIKE = "paypa1-secure.example"
ROWS = [
    message(1, f"attacker@{BRAND_LOOKALIKE}", "PayPal Support", "Urgent: verify your account",
            "Sign in to verify your account immediately.", [(f"https://{BRAND_LOOKALIKE}/login", "paypal.com")],
            heuristic_score=0.8, client_reasons=["Local heuristics flagged the message"]),
    message(2, f"a@{BRAND_LOOKALIKE}", "PayPal Support", "Urgent: verify your account",
            "Please verify your account immediately.", [(f"https://{BRAND_LOOKALIKE}/login", "paypal.com")],
            "<form><input type='hidden' value='x'></form>"),
    message(3, "x@yizpgeaj.fusionrift.uk.net", "Unknown Sender", "Message", "Please review this message."),
    message(4, "x@bluechip.io", "Call Service Bluechip", "Lucky Coin",
            "Are you ready to flip your fate? Lucky Coin Challenge is here. Spin the magic coin for life-changing "
            "prizes, cash, free spins, and rewards. मुफ्त इनाम नकद किस्मत घुमाएं."),
    message(5, "x@gοogle.com", "Google", "Password expires soon",
            "Your password expires in 15 minutes. Visit hxxps://accounts-login.cz/google[.]com now.",
            [("https://accounts-login.cz/google.com/reset", "google.com")]),
    message(6, "x@linkedin.com", "LinkedIn", "Profile view", "Someone viewed your profile.",
            [("https://www.linkedin.com/comm/feed/update?trk=%7Bencoded%7D%252Ftracking%252Fvalue", "View profile")]),
    message(7, "x@unknown.example", "Unknown", "Profile view", "Someone viewed your profile.",
            [("https://unknown.example/track?x=%7Bencoded%7D%252Ftracking%252Fvalue%253D%2526", "View profile")]),
    message(8, "x@login.microsoftonline.ccisystems.us", "Microsoft", "Password expires soon", "Open the secure page now.",
            [("https://accounts-login.cz/google.com/reset", "Google account"), ("https://bit.ly/3xYzAbC", "Reset password")]),
    message(9, "x@yizpgeaj.fusionrift.uk.net", "Unknown Sender", "Message", "Win an iPhone today"),
    message(10, "", "", "", ""),
]


@pytest.fixture(scope="module")
def table(spark):
    return with_defaults(spark.createDataFrame(ROWS, MESSAGE))


@pytest.fixture(scope="module")
def results(table):
    scored = plan.score_features(plan.extract_features(plan.mask_messages(table), Registry.sample()))
    return {r["msg_id"]: r for r in scored.collect()}


def test_credentials_and_mismatched_link(results):
    r = results[2]
    assert r["credential_phrase_count"] >= 1 and r["anchor_mismatch_flag"] == 1.0
    assert r["form_tag_presence"] == 1.0 and r["display_name_mismatch"] == 1.0
    assert r["impersonation_score"] > 0.3 and r["impersonated_brand"] == "PayPal"


def test_random_sender_infrastructure(results):
    r = results[3]
    assert r["random_subdomain_flag"] == 1.0 and r["suspicious_delegated_suffix_flag"] == 1.0
    assert r["domain_infrastructure_score"] == pytest.approx(0.965)
    assert r["risk_score"] == pytest.approx(0.34) and r["classification"] == "suspicious"


def test_prize_and_gambling_language(results):
    r = results[4]
    assert (r["spam_lure_keyword_count"], r["gambling_keyword_count"], r["hindi_spam_lure_count"]) == (6, 3, 5)
    assert r["promotional_spam_score"] == 1.0 and r["domain_infrastructure_score"] == 0.0


def test_homograph_and_brand_in_path(results):
    r = results[5]
    assert r["homograph_flag"] == 1.0 and r["url_brand_in_path_flag"] == 1.0 and r["defanged_url_count"] >= 1
    assert r["lookalike_score"] == pytest.approx(0.65) and r["impersonated_brand"] == "Google"


def test_trusted_sender_with_encoded_link_is_clean(results):
    r = results[6]
    assert r["link_reputation"] == 0.0 and r["link_reasons"] == [] and r["domain_reasons"] == []
    assert r["impersonation_score"] == 0.0 and r["impersonated_brand"] is None


def test_unknown_sender_with_encoded_link(results):
    assert "URL contains heavy percent encoding" in results[7]["link_reasons"]
    assert results[7]["link_reputation"] == pytest.approx(0.08)


def test_shortener_and_path_brand(results):
    r = results[8]
    assert r["link_reputation"] >= 0.35
    assert "URL path contains a trusted brand domain while the real destination is unrelated" in r["link_reasons"]
    assert "URL uses a generic shortener that hides the final destination" in r["link_reasons"]


def test_no_invented_brand(results):
    assert results[9]["impersonated_brand"] is None


def test_empty_message_is_safe(results):
    assert results[10]["classification"] == "safe" and results[10]["levenshtein_distance_to_brand"] == 1.0


def test_assess_returns_hashes_and_no_text(table):
    rows = assess(table, key="test-key")
    assert not {"body_text", "subject", "sender_email", "html"} & set(rows.columns)
    first = rows.filter("msg_id = 1").first()
    assert first["classification"] in ("suspicious", "phishing") and len(first["sample_hash"]) == 64
    assert first["sender_hash"] == "6dc7d490424f43e153e081d14e21a4cbd4aa19d850000d58e4fd361949c652e1"
    assert first["risk_score"] == pytest.approx(0.513, abs=2e-4)


def test_results_do_not_depend_on_partitioning(spark, table):
    columns = ["msg_id", "risk_score", "classification", "reasons"]
    one = sorted(assess(table.coalesce(1)).select(*columns).collect())
    many = sorted(assess(table.repartition(7)).select(*columns).collect())
    assert one == many


def test_registry_from_a_long_table_gives_the_same_result(spark, table, results):
    own = Registry.sample()
    rows = [(i, brand, domain, kind) for i, (domain, (brand, kind)) in enumerate(own.trust.items())]
    rows += [(1000 + i, f"zzq{i}qzz", f"zzq{i}qzz.invalid", "primary") for i in range(3000)]
    long = Registry.from_tables(spark.createDataFrame(rows, "position int, brand string, domain string, trust_type string"))
    with pytest.raises(ValueError, match="exceeds"):
        Registry.from_tables(spark.createDataFrame(rows, "position int, brand string, domain string, trust_type string"), most_rows=100)
    scored = plan.score_features(plan.extract_features(plan.mask_messages(table), long))
    for row in scored.collect():
        expected = results[row["msg_id"]]
        for name in ("risk_score", "lookalike_brand", "likely_brand", "impersonated_brand", "url_lookalike_score"):
            assert row[name] == expected[name], (row["msg_id"], name)


def test_invalid_messages_are_kept_apart(spark, table):
    bad = table.withColumn("subject", F.when(F.col("msg_id") == 3, F.repeat(F.lit("x"), 513)).otherwise(F.col("subject")))
    bad = bad.withColumn("msg_id", F.when(F.col("msg_id") != 4, F.col("msg_id")))
    assert sorted(r["msg_id"] for r in assess(bad).select("msg_id").collect()) == [1, 2, 5, 6, 7, 8, 9, 10]
    found = {r["msg_id"]: r["violations"] for r in plan.checked(bad)[1].collect()}
    assert found == {3: ["subject"], None: ["msg_id"]}


def test_queries_account_for_texts_of_any_length(spark, tmp_path):
    docs = [(1, "a short text"), (2, "word " * 10_050), (3, "verify your account now, " * 5_200), (8, "x" * 60_000)]
    pages = [(1, "https://a.example/", "<p>short</p>"), (2, "https://b.example/", "<p>" + "word " * 10_050 + "</p>")]
    pd.DataFrame(docs, columns=["doc_id", "text"]).to_parquet(f"{tmp_path}/documents.parquet")
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(f"{tmp_path}/pages.parquet")
    sql = duckdb.connect()
    for name in ("documents", "pages"):
        sql.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name, rows in {"assess": 4, "event_table": 4, "stream_assess": 4, "page_assess": 2, "assessed_summary": 1, "assessed_brands": None}.items():
        frame = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        verdict = check.compare(frame, check.sql_frame(sql, oracle_sql()[name]))
        assert verdict == f"ok {len(frame)}" and rows in (None, len(frame)), (name, verdict)


def test_repeated_ids_stop_the_job(table):
    with pytest.raises(Exception, match="repeated msg_id"):
        assess(table.union(table.where("msg_id = 2"))).collect()


def test_long_links_are_taken_whole(spark, table):
    href = "https://unknown.example/" + "a" * 1900 + "/google.com/" + "%41" * 40
    links = F.array(F.struct(F.lit(href).alias("href"), F.lit("b" * 500).alias("anchor_text")))
    row = plan.score_features(plan.extract_features(plan.mask_messages(table.withColumn("links", links)), Registry.sample())).first()
    assert row["encoded_character_count"] == 120 and row["url_brand_in_path_flag"] == 1.0


def test_word_mode_needs_whole_words(table):
    registry = Registry.sample(mention_mode="word")
    rows = plan.score_features(plan.extract_features(plan.mask_messages(table), registry))
    found = {r["msg_id"]: r["impersonated_brand"] for r in rows.select("msg_id", "impersonated_brand").collect()}
    assert found[7] is None and found[1] == "PayPal"


def test_adding_a_link_never_lowers_link_reputation(spark, table):
    extra = F.from_json(F.lit('[{"href": "http://10.0.0.1/x", "anchor_text": "x"}]'), "array<struct<href:string,anchor_text:string>>")
    from msgrisk.operators.links import link_features

    before = {r["msg_id"]: r["link_points"] for r in link_features(table, Registry.sample()).collect()}
    more = table.withColumn("links", F.concat("links", extra))
    after = {r["msg_id"]: r["link_points"] for r in link_features(more, Registry.sample()).collect()}
    assert all(after[k] >= before[k] for k in before)
