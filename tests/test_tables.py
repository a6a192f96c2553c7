"""Batch operators against brute force, sinks, streams and the model."""

import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

import check
import oracles
from msgrisk import Registry, fixed_values as fv
from msgrisk.operators import analytics, learning, ledger, links, panels
from msgrisk.plans import catalog, demo, training
from msgrisk.plans.assess import FunctionModel, assess
from msgrisk import session
from msgrisk.session import checkpoint_root
from msgrisk.sources import feeds, messages as source, tables
from msgrisk.sources.batches import BatchTable
from msgrisk.streaming import jobs


def fold(rows, wait):
    last, accepted = {}, set()
    for row_id, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or t - last[key] >= wait:
            last[key] = t
            accepted.add(row_id)
    return accepted


@pytest.mark.parametrize("seconds", [30, 300])
def test_ledger_equals_a_sequential_fold_with_one_busy_key(spark, seconds, monkeypatch):
    monkeypatch.setattr(ledger, "MAX_CHUNK_MS", seconds * 4000)
    rng = random.Random(7)
    rows = []
    for row_id in range(6000):
        key = "busy" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        rows.append((row_id, key, rng.randrange(0, 3_000_000)))
    df = spark.createDataFrame(rows, "id long, key string, t long").withColumn("ts", F.timestamp_millis("t"))
    cool = {r["id"] for r in ledger.cooldown(df, "key", "ts", "id", seconds).filter("accepted").collect()}
    assert cool == fold(rows, seconds * 1000)
    misses = {r["id"] for r in ledger.ttl_cache(df, "key", "ts", "id", seconds).filter("not is_hit").collect()}
    assert misses == fold(rows, seconds * 1000 + 1)


def hash_fold(rows, wait):
    last, accepted = {}, set()
    for row_id, key, t, payload in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or (t - last[key][0] >= wait and (payload is None or payload != last[key][1])):
            last[key] = (t, payload)
            accepted.add(row_id)
    return accepted


@pytest.mark.parametrize("fan, n_hashes", [(2, 0), (3, 1), (2, 2), (5, 6), (256, 2)])
def test_composed_chunks_equal_a_fold_when_one_key_holds_all_rows(spark, monkeypatch, fan, n_hashes):
    """Many chunks, composed over several levels; no part list is longer than ``fan``."""
    monkeypatch.setattr(ledger, "MAX_CHUNK_MS", 4)
    rng = random.Random(fan * 10 + n_hashes)
    rows = []
    for row_id in range(3000):
        # bursts, gaps of many chunks, and several rows within a millisecond
        t = rng.randrange(0, 40) * 40_000 + rng.choice([rng.randrange(0, 2000) * 5, rng.randrange(0, 20)])
        key = "busy" if row_id % 10 else f"k{row_id % 7}"
        payload = None if n_hashes == 0 or rng.random() < 0.05 else f"h{rng.randrange(n_hashes)}"
        rows.append((row_id, key, t, payload))
    df = spark.createDataFrame(rows, "id long, key string, t long, payload string").withColumn("ts", F.timestamp_millis("t"))
    name = "payload" if n_hashes else None
    got = {r["row_id"] for r in ledger.accepted_rows(df, "key", "ts", "id", 1, False, name, fan).collect()}
    assert got == hash_fold([r if n_hashes else (*r[:3], None) for r in rows], 1000)


def test_a_composed_summary_is_as_long_as_its_first_part():
    rng = random.Random(1)
    wait, width = 1000, 4000
    times = sorted(rng.sample(range(0, 64 * width), 9000))
    rows = pd.DataFrame({"key": "k", "t": times, "code": times})
    rows["chunk"] = rows["t"] // width
    parts = pd.concat(ledger._summarise(wait, width)([rows]))
    whole = parts.assign(block=parts["chunk"] // 32, begins=parts["chunk"] * width)
    sizes = parts.groupby("chunk").size()
    composed = pd.concat(ledger._compose(wait, width)([whole])).groupby("chunk").size()
    assert len(composed) == 2 and all(n <= sizes[32 * block] + 1 for block, n in composed.items())


def test_empty_ledger(spark):
    none = spark.createDataFrame([], "id long, key string, ts timestamp, payload string")
    assert ledger.cooldown(none, "key", "ts", "id", 30, "payload").collect() == [] == ledger.ttl_cache(none, "key", "ts", "id").collect()


def test_window_edges(spark):
    rows = [(1, "a", 0), (2, "a", 30_000), (3, "a", 59_999), (4, "a", 60_000)]
    df = spark.createDataFrame(rows, "id long, key string, t long").withColumn("ts", F.timestamp_millis("t"))
    cool = [r["accepted"] for r in ledger.cooldown(df, "key", "ts", "id", 30).orderBy("id").collect()]
    hit = [r["is_hit"] for r in ledger.ttl_cache(df, "key", "ts", "id", 30).orderBy("id").collect()]
    assert cool == [True, True, False, True] and hit == [False, True, False, True]


def test_auc_and_split_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    got = learning.roc_auc(df).first()
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-6)
    split = learning.stratified_split(df, "label", "id").groupBy("label").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["label"]: r["n"] for r in split} == {1: int(len(pos) * 0.25 + 0.5), 0: int(len(neg) * 0.25 + 0.5)}
    assert learning.roc_auc(df.filter("label = 1")).first()["auc"] is None


def test_hot_host_is_spread_and_nothing_is_lost(spark):
    rows = [(i, [{"href": "https://bit.ly/x" if i % 3 else f"https://h{i}.example/", "anchor_text": ""}]) for i in range(300)]
    df = spark.createDataFrame(rows, "msg_id long, links array<struct<href:string,anchor_text:string>>")
    refs = links.host_references(df, Registry.sample())
    joined = links.join_profile(refs, links.host_usage(df), Registry.sample())
    assert joined.count() == 300 and joined.select("msg_id").distinct().count() == 300


@pytest.mark.parametrize("bound", [0.0, 0.05, 0.3, 1.0])
def test_threshold_under_a_bound_of_false_positives(spark, bound):
    rng = random.Random(int(bound * 100))
    rows = [(i, int(rng.random() < 0.4), round(min(1.0, rng.random() * (1 if i % 3 else 0.3)), 3)) for i in range(800)] + [(801, 0, 1.0), (802, 1, 1.0)]
    got = learning.operating_point(spark.createDataFrame(rows, "id long, label int, score double").repartition(5), bound).first()
    n_neg, best = sum(1 - y for _, y, _ in rows), None
    for t in {s for _, _, s in rows}:
        tp, fp = (sum(s >= t and y == k for _, y, s in rows) for k in (1, 0))
        if fp <= bound * n_neg:
            best = max(best or (-1,), (tp, -fp, t))
    if best is None:
        assert got["threshold"] is None and (got["tp"], got["fp"], got["tn"]) == (0, 0, n_neg)
    else:
        assert (got["tp"], -got["fp"], got["threshold"]) == best and got["fpr"] == pytest.approx(-best[1] / n_neg, abs=1e-6)
    none = learning.operating_point(spark.createDataFrame([], "label int, score double"), bound).first()
    assert none["threshold"] is None and none["recall"] == 0.0


def test_links_known_at_their_time(spark):
    """Spans of chunks hold at every moment what single records hold, also for a domain with very many."""
    rng = random.Random(2)
    feed = [(f"h{rng.randrange(4)}.example", rng.choice("abc"), rng.randrange(0, 40 * 86400)) for _ in range(150)]
    feed += [("busy.example", "a", rng.randrange(0, 5 * 86400)) for _ in range(400)] + [("", "a", 5), (None, "b", 5), ("h1.example", "a", None)]
    links_at = [(i, f"h{rng.randrange(5)}.example" if i % 3 else "busy.example", rng.randrange(0, 50 * 86400)) for i in range(400)] + [(900, None, 5), (901, "", 5), (902, "h1.example", None)]
    days = {"a": 1, "b": 3}
    at = F.timestamp_seconds("t")
    feed_rows = spark.createDataFrame(feed, "domain string, source string, t long").select("domain", "source", at.alias("first_seen"))
    link_rows = spark.createDataFrame(links_at, "id long, host string, t long").select("id", "host", at.alias("seen_at"))
    lifetimes = spark.createDataFrame(list(days.items()), "source string, days int")
    got = {r["id"]: list(r["known_by"]) for r in feeds.known_links(link_rows, feed_rows, lifetimes, 2).collect()}
    expected = {}
    for i, host, t in links_at:
        known = sorted({s for d, s, f in feed if d and d == host and t is not None and f is not None and f <= t <= f + days.get(s, 2) * 86400})
        if known:
            expected[i] = known
    assert got == expected and len(got) > 50
    assert max(len(r["spans"]) for r in feeds.live_spans(feed_rows.where("domain = 'busy.example'"), lifetimes, 2).collect()) <= 6


def test_points_without_time_are_numbered(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id long, risk_score double")
    assert [r["label"] for r in analytics.normalized_points(rows, ["id"]).collect()] == ["Event 1", "Event 2", "Event 3"]
    assert {r["label"] for r in analytics.normalized_points(rows).collect()} == {"Event"}


def test_a_registry_table_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"b{i}", f"d{i}.com", "primary") for i in range(30)], "position int, brand string, domain string, trust_type string")
    assert len(Registry.from_tables(rows).trust) == 30
    with pytest.raises(ValueError, match="rows"):
        Registry.from_tables(rows, most_rows=29)
    monkeypatch.setattr("msgrisk.registry.MOST_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        Registry.from_tables(rows)


def test_repeated_texts_train_once(spark):
    numeric = {c: 0.0 for c in fv.NUMERIC_FEATURES}
    rows = [(i, i % 2, f"text {i % 2} word{i // 4}", *numeric.values()) for i in range(32)]
    schema = "msg_id long, label int, text string, " + ", ".join(f"{c} double" for c in numeric)
    _, _, vectors, test, n_rows = training._split_vectors(spark.createDataFrame(rows, schema), 50, 1)
    assert n_rows == 16 == vectors.count() + test.count()


def test_term_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "terms array<string>")
    got = {r["term"]: (r["n_total"], r["n_docs"]) for r in learning.term_counts(df, "terms").collect()}
    assert got == {"a": (3, 2), "b": (1, 1)}


def test_event_table_roundtrip(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/events-{uuid.uuid4().hex}"
    rows = assess(demo.messages(spark, sf_dir), key="k")
    tables.write_events(rows, path)
    stored = tables.read_events(spark, path)
    assert stored.count() == rows.count() and "event_date" in stored.columns
    from msgrisk.operators.analytics import since
    recent = since(stored, "2024-01-02 00:00:00", 0)
    assert "PartitionFilters: [isnotnull(event_date" in recent._jdf.queryExecution().toString()


def test_feedback_is_stored_once(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/feedback-{uuid.uuid4().hex}"
    rows = demo.feedback(spark, sf_dir)
    tables.append_feedback(rows, path)
    first = spark.read.parquet(path).count()
    tables.append_feedback(rows, path)
    bad = rows.withColumn("user_feedback", F.lit("other"))
    tables.append_feedback(bad, path)
    assert spark.read.parquet(path).count() == first == rows.select("sample_hash", "user_feedback").distinct().count()


def test_repeated_batches_of_a_stream_store_no_row_twice(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/events-{uuid.uuid4().hex}"
    rows = tables.event_rows(assess(demo.messages(spark, sf_dir), key="k"))
    tables.write_event_batch(rows, path, 0)
    tables.write_event_batch(rows, path, 0)
    tables.write_event_batch(rows, path, 1)
    assert tables.read_events(spark, path).count() == 2 * rows.count()


def test_batches_are_merged_and_nothing_is_lost(spark):
    """Folders grow in number with the logarithm of the batches; repeated batches add nothing."""
    table = BatchTable(spark, f"{checkpoint_root(spark)}/batches-{uuid.uuid4().hex}", ("day",), fan=3)
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    for i in range(14):
        rows = spark.createDataFrame([(i, "a"), (100 + i, "b")], "x int, day string")
        assert table.append(rows, i, {"newest": i}) and not table.append(rows, i)
        assert sorted(r["x"] for r in table.read().collect()) == sorted([*range(i + 1), *range(100, 101 + i)])
    listed = table.listed()
    assert sorted(p["level"] for p in listed["parts"]) == [0, 0, 1, 2] and listed["notes"] == {"newest": 13} and listed["last_batch"] == 13
    assert "PartitionFilters: [isnotnull(day" in table.read().where("day = 'a'")._jdf.queryExecution().toString()


def test_a_reader_sees_whole_batches_only(spark, monkeypatch):
    """A batch that breaks off before its commit isn't seen, and its repeat counts once; a reader keeps what it has begun to read."""
    table = BatchTable(spark, f"{checkpoint_root(spark)}/batches-{uuid.uuid4().hex}", fan=2)
    table.append(spark.range(5), 0)
    reading = table.read()
    monkeypatch.setattr(table, "_commit", lambda listed: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.append(spark.range(7), 1)
    assert table.read().count() == 5
    monkeypatch.undo()
    table.append(spark.range(7), 1)         # merges both folders as well
    assert table.read().count() == 12 and reading.count() == 5
    other = BatchTable(spark, table.path, fan=2)
    stale = table.listed()
    other.append(spark.range(1), 2)
    with pytest.raises(RuntimeError):
        table._commit(stale)                # a second writer is found out


def test_unused_folders_go_after_some_commits(spark):
    path = f"{checkpoint_root(spark)}/batches-{uuid.uuid4().hex}"
    table = BatchTable(spark, path, fan=2)
    for i in range(24):
        table.append(spark.range(i, i + 1), i)
    folders = [d for d in os.listdir(path.removeprefix("file://")) if d.startswith("part=")]
    assert table.read().count() == 24 and len(folders) < 24 + 8
    assert len(os.listdir(f"{path.removeprefix('file://')}/_commits")) < 40


def test_panels_of_batches_equal_panels_of_all(spark, sf_dir):
    events, feedback = store_rows(demo.risk_events(spark, sf_dir)), demo.feedback(spark, sf_dir)
    whole = panels.panels(panels.merged(panels.event_fold(events).unionByName(panels.feedback_fold(feedback))), "2024-01-31 00:00:00")
    path = f"{checkpoint_root(spark)}/panels-{uuid.uuid4().hex}"
    table = BatchTable(spark, path, reduce=panels.merged, fan=2)
    for i in range(5):
        table.append(panels.event_fold(events.where(F.col("id") % 5 == i)).unionByName(panels.feedback_fold(feedback.where(F.col("feedback_id") % 5 == i))), i)
    split = panels.panels(table.read(), "2024-01-31 00:00:00")
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    days = {r["item"]: r["n_events"] for r in whole.where("panel = 'trend'").collect()}
    direct = analytics.daily_trend(events, "2024-01-31 00:00:00").collect()
    assert days == {str(r["day"]): r["n_events"] for r in direct}


def test_a_refresh_reads_no_old_event(spark, sf_dir, tmp_path, monkeypatch):
    """The event and feedback tables are written, never read."""
    def refused(*args, **more):
        raise AssertionError("old events were read")

    rows = demo.table(spark, sf_dir, "events")
    for i in range(2):
        rows.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    monkeypatch.setattr(tables, "read_events", refused)
    monkeypatch.setattr(tables.BatchTable, "compact", lambda self: None)
    arriving = demo.as_risk_events(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    jobs.dashboard_stream(arriving, str(tmp_path / "events"), str(tmp_path / "panels"), str(tmp_path / "progress"), {"availableNow": True}).awaitTermination()
    shown = jobs.latest_panels(spark, str(tmp_path / "panels"), "2024-01-31 00:00:00")
    assert sum(r["n_events"] for r in shown.where("panel = 'classes'").collect()) == rows.count()
    assert len(tables.event_batches(spark, str(tmp_path / "events")).listed()["parts"]) == 2
    assert jobs.latest_panels(spark, str(tmp_path / "none")).collect() == []


def store_rows(df):
    return session.store(df)


def test_stored_tables_go_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_root", lambda spark: str(tmp_path))
    with session.stored_tables(spark):
        assert session.store(spark.range(5)).count() == 5
        assert len(os.listdir(tmp_path)) == 1
    assert os.listdir(tmp_path) == []
    session.store(spark.range(5))
    assert len(os.listdir(tmp_path)) == 1


@pytest.mark.parametrize("seconds", [600, 21600])
def test_hash_cooldown_of_several_batches(spark, sf_dir, arriving, tmp_path, seconds):
    payload = F.md5((F.col("event_id") % 3).cast("string"))
    rows = jobs.cooldown_stream(arriving().withColumn("payload", payload), "client", "ts", "event_id", seconds, 60 * 86400, payload="payload")
    marks = collected(spark, rows, tmp_path, jobs.WindowProcessor.OUTPUT)
    expected = ledger.cooldown(demo.requests(spark, sf_dir).withColumn("payload", payload), "client", "ts", "event_id", seconds, "payload")
    assert {(r["row_id"], r["accepted"]) for r in marks.collect()} == {(r["event_id"], r["accepted"]) for r in expected.collect()}


@pytest.fixture(scope="module")
def arriving(spark, sf_dir, tmp_path_factory):
    """Events in four files by time, and the stream that reads one file a batch."""
    folder = tmp_path_factory.mktemp("arriving")
    rows = demo.table(spark, sf_dir, "events").toPandas().sort_values(["ts", "event_id"])
    size = -(-len(rows) // 4)
    for i in range(4):
        rows.iloc[i * size : (i + 1) * size].to_parquet(folder / f"part-{i}.parquet", coerce_timestamps="us")
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(str(folder)).schema

    def stream():
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return read.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").cast("string").alias("client"))

    return stream


def collected(spark, rows, tmp_path, schema):
    writer = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("seconds", [600, 21600])
def test_stream_of_several_batches_equals_the_table(spark, sf_dir, arriving, tmp_path, seconds):
    """State goes from batch to batch; users that stay away longer than it is kept come back after its timer."""
    marks = collected(spark, jobs.ttl_stream(arriving(), "client", "ts", "event_id", seconds), tmp_path, jobs.WindowProcessor.OUTPUT)
    expected = ledger.ttl_cache(demo.requests(spark, sf_dir), "client", "ts", "event_id", seconds)
    assert {(r["row_id"], r["accepted"]) for r in marks.collect()} == {(r["event_id"], not r["is_hit"]) for r in expected.collect()}


def test_rates_of_several_batches_are_complete(spark, sf_dir, arriving, tmp_path):
    jobs.rate_stream(arriving(), str(tmp_path / "out"), str(tmp_path / "progress"), 1).awaitTermination()
    found = jobs.read_rates(spark, str(tmp_path / "out")).select("window_start", "client", "n_requests", "over_limit")
    expected = analytics.rate_counts(demo.requests(spark, sf_dir), 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_late_requests_are_left_out(spark, tmp_path):
    rows = [(0, "2024-01-01 00:00:10", "a"), (1, "2024-01-01 01:00:00", "a"), (2, "2024-01-01 01:00:10", "a"),
            (3, "2024-01-01 00:00:20", "a"), (4, "2024-01-01 01:00:30", "a")]
    for i, row in enumerate(rows):
        frame = pd.DataFrame([row], columns=["event_id", "ts", "client"])
        frame.assign(ts=pd.to_datetime(frame["ts"])).to_parquet(tmp_path / f"part-{i}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    read = spark.readStream.schema("event_id long, ts timestamp_ntz, client string").option("maxFilesPerTrigger", 1)
    read = read.parquet(f"{tmp_path}/part-*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "jobs").mkdir()
    jobs.rate_stream(read, str(tmp_path / "jobs/out"), str(tmp_path / "jobs/progress"), 1).awaitTermination()
    jobs.late_stream(read, str(tmp_path / "jobs/late"), str(tmp_path / "jobs/late_progress")).awaitTermination()
    late = jobs.read_late(spark, str(tmp_path / "jobs/late")).collect()
    assert [(r["event_id"], str(r["watermark"])) for r in late] == [(3, "2024-01-01 00:58:10")]
    found = jobs.read_rates(spark, str(tmp_path / "jobs/out")).collect()
    assert sorted((str(r["window_start"]), r["n_requests"]) for r in found) == [("2024-01-01 00:00:00", 1), ("2024-01-01 01:00:00", 3)]


def test_small_training_set_from_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "text,label\n" + "".join(f'"verify your account now {i} http://x{i}.example/",phishing\n"see you at lunch {i}",safe\n' for i in range(3))
    )
    rows = source.training_messages(source.read_training_csv(spark, str(tmp_path / "t.csv")))
    frame = training.training_frame(rows, Registry.sample())
    model, metrics, predictions = training.train_model(frame)
    assert metrics["rows"] == 6
    model.save(str(tmp_path / "model"))
    loaded = training.TrainedModel.load(spark, str(tmp_path / "model"))
    assert loaded.version == model.version
    assert training.TrainedModel.load(spark, str(tmp_path / "none")) is None
    scored = assess(rows.drop("label"), model=loaded).select("components.ml_probability").collect()
    assert all(0 <= r[0] <= 1 for r in scored) and len({r[0] for r in scored}) > 1


def test_any_function_can_be_the_model(spark, sf_dir):
    model = FunctionModel(lambda df: df.withColumn("ml_probability", F.lit(0.9)), "fixed")
    rows = assess(demo.messages(spark, sf_dir), model=model)
    assert rows.filter("components.ml_probability <> 0.9 or model_version <> 'fixed'").count() == 0


CHECKED = [
    "mask_pii", "canonical_hash", "text_stats", "domain_lookalike", "link_features", "assess", "page_assess", "triage_score",
    "cooldown_hash", "stream_cooldown_hash", "stream_late", "known_links", "threshold_fpr", "training_csv", "event_points", "name_sets",
    "trust_from_table", "links_without_href", "page_links", "daily_trend", "siem_events", "feedback_new", "ngram_vocab", "stratified_split", "eval_report",
    "stream_cooldown", "stream_ttl", "stream_rate", "stream_dedup", "stream_dashboard", "validate_feedback", "quarantined_messages", "rate_clients", "message_source", "stream_feedback", "stream_export", "stream_assess",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir).toPandas()
    verdict = check.compare(frame, check.sql_frame(check.connect(sf_dir), oracles.statements()[name]))
    assert verdict.startswith("ok"), verdict


def test_every_statement_belongs_to_a_query():
    assert set(oracles.statements()) <= set(catalog.QUERIES)


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    texts = [(i, f"Please verify account {i} at https://a{i}.example/x") for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id for r in catalog.QUERIES["stream_assess"](spark, str(tmp_path)).collect()} == set(range(12))
    events = [(i, 100 + i, f"2024-01-01 00:00:{i:02}") for i in range(12)]
    spark.createDataFrame(events, "event_id long, user_id long, ts string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id for r in catalog.QUERIES["stream_dedup"](spark, str(tmp_path)).collect()} == set(range(12))


def test_words_of_plain_and_other_texts_are_cut_alike(spark):
    texts = ["Ab a_1 x 22, don't e-mail", "\x00_ __ a\tbc\u007f", "", "Ünï ab 日本語 é x", "İab ſcd Kelvin K9 ab"]
    wide = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select(learning.words(F.col("text")).alias("w"), wide.alias("wide"))
    assert all(r.w == r.wide for r in rows.collect())
    assert "regexp_extract_all(lower(text#" in (plan := rows._jdf.queryExecution().toString()) and "[a-z0-9_]{2,}" in plan


def test_parts_of_a_tree_fit_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(training, "TREE_ROWS", 50)
    rows = spark.range(1000).coalesce(1)
    sizes = training.tree_rows(rows, 1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 100
    few = spark.range(40).coalesce(1)
    assert training.tree_rows(few, 40) is few


def test_rules_read_each_text_once(spark, sf_dir):
    plan = catalog.QUERIES["rule_hits"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("text:string>") == 1
