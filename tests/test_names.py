"""Searches for registry names against plain searches, with as many names as a registry may have."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from msgrisk import Registry
from msgrisk.operators import hosts, links, names, sender
from msgrisk.registry import Term, constant_table

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def word(draw, least=1, most=14):
    return "".join(draw.choices(LETTERS, k=draw.randint(least, most)))


def changed(draw, text, edits):
    for _ in range(edits):
        at, kind = draw.randrange(len(text) + 1), draw.randrange(3)
        text = text[:at] + ("" if kind == 0 else draw.choice(LETTERS)) + text[at + (kind != 1) :]
    return text


@pytest.fixture(scope="module")
def many():
    draw = random.Random(5)
    return [Term(t, i, f"brand {i}") for i, t in enumerate(dict.fromkeys(word(draw, 2) for _ in range(56_000)))][:50_000]


def brute_nearest(texts, terms):
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"text": texts}))
    con.register("n", pd.DataFrame({"term": [t.term for t in terms], "position": [t.position for t in terms]}))
    rows = con.execute("SELECT text, min({'d': levenshtein(text, term), 'p': position}) FROM t, n GROUP BY text").fetchall()
    return {text: (best["d"], best["p"]) for text, best in rows}


def test_nearest_of_50000_names(spark, many):
    draw = random.Random(6)
    texts = [changed(draw, draw.choice(many).term, draw.randint(0, 4)) for _ in range(150)]
    texts += [word(draw, 1, 25) for _ in range(60)] + ["", "a", "mail", "x" * 63]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "text string")
    found = names.nearest_names(df, many)
    got = {r["text"]: (r["distance"], int(r["brand"].split()[1])) for r in found.collect()}
    assert got == brute_nearest(sorted(set(texts)), many)
    plan = found._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert many[77].brand not in plan


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_nearest_of_odd_texts(spark):
    """Ties go to the first name; letters beyond ASCII count as one."""
    terms = [Term("paypal", 0, "P"), Term("päypal", 1, "Q"), Term("日本銀行", 2, "J"), Term("ab", 3, "A"), Term("ab", 4, "B")]
    texts = ["paypa1", "pbypal", "päypa", "日本銀", "ab", "", "🙂", "aypalp", "ppayall"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["distance"], r["brand"]) for r in names.nearest_names(df, terms).collect()}
    assert {t: d for t, (d, _) in got.items()} == {t: min(edits(t, n.term) for n in terms) for t in texts}
    assert got["pbypal"] == (1, "P") and got["ab"] == (0, "A") and got["日本銀"] == (1, "J")
    assert names.nearest_names(df, []).collect() == []


def test_far_names_are_bounded(many):
    """Only names that may be as near as the best one are compared."""
    far = names.FarNames(many)
    draw = random.Random(8)
    for _ in range(30):
        far.nearest(word(draw, 6, 12))
    assert far.compared < 0.6 * 30 * len(many)


def test_far_names_of_many_texts_equal_a_plain_search():
    draw = random.Random(12)
    for letters in ("ab", "abcé日", LETTERS):
        terms = [Term("".join(draw.choices(letters, k=k)), i, f"b{i}") for i, k in enumerate([0, 3, 5, 8, 8, 63, 64, 65, 90])]
        texts = ["", *("".join(draw.choices(letters + "-", k=draw.choice((1, 6, 20, 80)))) for _ in range(40))]
        distance, position = names.FarNames(terms).nearest_of(texts)
        for text, d, p in zip(texts, distance, position):
            assert (d, p) == min((plain_distance(text, t.term), t.position) for t in terms)


def plain_distance(text, name):
    above = list(range(len(name) + 1))
    for i, a in enumerate(text):
        row = [i + 1]
        for j, b in enumerate(name):
            row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (a != b)))
        above = row
    return above[-1]


def test_far_texts_are_spread_over_tasks(spark):
    texts = spark.createDataFrame([(f"zzzzzzzz{i}",) for i in range(400)], "text string")
    found = names.nearest_names(texts, [Term("paypal", 0, "P")]).select(F.spark_partition_id().alias("at"))
    assert found.distinct().count() > 1


def test_contained_names(spark, many):
    draw = random.Random(9)
    terms = [t for t in many if len(t.term) >= 4][:20_000]
    texts = [" ".join(word(draw, 1, 12) if draw.random() < 0.6 else draw.choice(terms).term for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "id long, text string")
    got = {r["id"]: (r["all"], r["first"][0]) for r in df.select("id", names.all_names(terms, F.col("text")).alias("all"), names.first_names(terms, F.col("text")).alias("first")).collect()}
    for i, text in enumerate([*texts, "", ""]):
        expected = [t.brand for t in terms if t.term in text]
        assert got[i] == (expected, expected[0] if expected else None)


def test_whole_words():
    scan = names.NameScan([Term("pay pal", 0, "P"), Term("x", 1, "X"), Term("ünion", 2, "U")], whole_words=True)
    assert scan.hits("my pay pal, and x") == {(0, "P"), (1, "X")}
    assert scan.hits("pay pals xx 1x x² ünions") == set() and scan.hits("(ünion)") == {(2, "U")}
    assert names.NameScan([]).hits("text") == set() and scan.hits(None) == set()


@pytest.fixture(scope="module")
def large(many):
    """A registry whose labels are the names, some under several suffixes and brands."""
    rows = [(t.brand, f"{t.term}.com", "primary") for t in many[:3000]] + [(t.brand, f"{t.term}.co.uk", "email") for t in many[2000:2500]]
    rows += [("weak", f"{t.term}.net", "asset") for t in many[3000:3200]]
    return Registry.build([("seed", ["mail.seed.org", "seed.org"])], rows)


def test_hosts_against_plain_lookups(spark, large, many):
    draw = random.Random(10)
    found = ["", "com", "seed.org", "www.seed.org", "mail.seed.org.evil.com", "xmail.seed.org.evil.com", "a..b", ".seed.org", "seed.org.", "www." + many[5].term + ".com"]
    for _ in range(400):
        name = draw.choice(many[:4000]).term
        found.append(draw.choice([
            f"{name}.com", f"a.{name}.co.uk", f"{name}.com.{word(draw)}.ru", f"x{name}y.{word(draw)}.net", f"{word(draw)}.{name}.net", f"{name}.seed.org.{word(draw)}.de", f"{word(draw)}.{word(draw)}",
        ]))
    rows = spark.createDataFrame([(h,) for h in sorted(set(found))], "host string")
    got = hosts.add_hidden_brands(hosts.trust_and_verified(rows, large)).collect()
    assert len(got) == rows.count()
    by_domain = large.by_domain()
    for r in got:
        host = r["host"]
        bare = host.removeprefix("www.")
        suffixes = [host.split(".", i)[-1] for i in range(host.count(".") + 1)]
        trust = next((large.trust[s] for s in [bare.split(".", i)[-1] for i in range(bare.count(".") + 1)] if s in large.trust), None)
        assert (None if r["trust"] is None else (r["trust"]["brand"], r["trust"]["trust_type"])) == trust, host
        verified = sorted({(t.position, t.brand) for s in suffixes for t in by_domain.get(s, [])})
        assert sorted({(v["position"], v["brand"]) for v in r["verified"]}) == verified, host
        inner = min(((t.position, t.brand) for t in large.domains if f".{t.term}." in f".{host}"), default=None)
        parts = [p for p in host.split(".") if p]
        labels = parts[:-2] if len(parts) > 2 else parts[:1]
        inside = min(((t.position, t.brand) for t in large.labels if len(t.term) >= 5 and any(t.term in p and t.term != p for p in labels)), default=None)
        assert r["subdomain_brand"] == (inner[1] if inner and not trust else None), host
        assert r["embedded_brand"] == (inside[1] if inside and not trust else None), host


def test_paths_and_mentions(spark, large):
    domain, brand = large.domains[7].term, large.domains[7].brand
    df = spark.createDataFrame([(f"/x/{domain}/y", f"news of {brand} here"), ("", ""), (None, None), ("/plain", "nothing")], "path string, text string")
    rows = df.select(links.path_brand(F.col("path"), large).alias("p"), sender.brand_mentions(F.col("text"), large).alias("m")).collect()
    expected = [t.brand for t in large.aliases if t.term in f"news of {brand} here"]
    assert rows[0]["p"] == min((t.position, t.brand) for t in large.domains if t.term in f"/x/{domain}/y")[1]
    assert rows[0]["m"] == list(dict.fromkeys(expected)) and [r["p"] for r in rows[1:]] == [None] * 3 and [r["m"] for r in rows[1:]] == [[]] * 3


def test_registry_tables_hold_any_text(spark):
    odd = "it's \\ \"odd\""
    rows = constant_table(spark, [(odd, [(1, odd)], None)], "a string, b array<struct<x:int,y:string>>, c boolean").collect()
    assert rows[0]["a"] == odd and rows[0]["b"][0]["y"] == odd and rows[0]["c"] is None
    registry = Registry.build([], [(odd, "o'dd.com", "primary")])
    assert registry.trust_table(spark).collect()[0]["brand"] == odd and registry.verified_table(spark).collect()[0]["brands"][0]["brand"] == odd


def test_work_on_texts_and_hosts_is_spread(spark):
    def plan(rows):
        return rows._jdf.queryExecution().executedPlan().toString()

    texts = spark.createDataFrame([("paypa1",), ("zzzz",), (None,)], "text string")
    near = plan(names.nearest_names(texts, Registry.sample().aliases))
    assert "REPARTITION_BY_NUM" in near[near.index("Generate") :]       # below the deletions
    found = hosts.host_profile(spark.createDataFrame([("a.paypal.com",), ("",)], "host string"), Registry.sample())
    pieces = plan(found)
    assert "REPARTITION_BY_NUM" in pieces[pieces.index("ObjectHashAggregate") :]
    assert found.count() == 2
