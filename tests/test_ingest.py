from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyrank.config import LookupConfig
from storyrank.sources import corpus as corpus_files
from storyrank.sources import news, reports, scratch
from storyrank.sources.members import MemberConfig, add_filters, hits, make_filter
from storyrank.sources.scratch import scratch_root, stored
from storyrank.streaming import ingest


def status(i, count=0, **changes):
    record = {
        "id_str": str(i), "text": f"post {i}", "created_at": "Sat Jan 14 03:25:04 +0000 2017",
        "retweet_count": count, "user": {"name": "n"},
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v != "absent"})


def land(folder, name, lines, at):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (at, at))


def kept(spark, table):
    return sorted((r["id_str"], r["rt_cnt"]) for r in news.read_news(spark, table).collect())


@pytest.mark.parametrize(
    "line, outcome",
    [
        (status(1), None),
        (status(1, user=None), None),
        (status(1, text=None), None),
        ("oops", "not a JSON object"),
        ("[1]", "not a JSON object"),
        ('{"text":"x"}', "not a status"),
        (status(1, user="absent"), "not a status"),
        (status(1, retweet_count="absent"), "missing field"),
        (status(1, id_str=None), "no id"),
    ],
)
def test_parse(spark, line, outcome):
    parsed = news.parse_status(spark.createDataFrame([(line,)], "value string")).first()
    assert parsed["reject"] == outcome
    if outcome is None:
        assert parsed["id_str"] == "1" and parsed["rt_cnt"] == 0
        assert parsed["created_at"].year == 2017


def test_parse_keeps_a_bad_count_as_null(spark):
    parsed = news.parse_status(spark.createDataFrame([(status(1, count="many"),)], "value string")).first()
    assert parsed["reject"] is None and parsed["rt_cnt"] is None


FIRST = [status(1, 10), status(2, 20), "oops", status(1, 11)]
SECOND = [status(2, 99), status(3, 30), '{"text":"x"}', status(3, 31)]


@pytest.mark.parametrize("cfg", [LookupConfig(), LookupConfig(max_broadcast_rows=0)], ids=["few", "many"])
def test_stream_keeps_first_versions_across_a_restart(spark, tmp_path, cfg):
    landing, table, rejects = (str(tmp_path / n) for n in ("landing", "news", "rejects"))

    def run():
        source = ingest.landed_stream(spark, landing, files_per_batch=1)
        ingest.ingest_stream(
            source, table, str(tmp_path / "checkpoint"), rejects, available_now=True, cfg=cfg
        ).awaitTermination()

    land(landing, "b.json", FIRST, at=1_000_000_000)
    run()
    assert kept(spark, table) == [("1", 10), ("2", 20)]
    land(landing, "a.json", SECOND, at=1_000_000_100)
    run()
    assert kept(spark, table) == [("1", 10), ("2", 20), ("3", 30)]
    run()
    assert kept(spark, table) == [("1", 10), ("2", 20), ("3", 30)]
    assert spark.read.json(rejects).count() == 2

    batch = str(tmp_path / "batch")
    ingest.ingest_batch(news.read_landed(spark, landing), batch, cfg=cfg)
    assert kept(spark, batch) == kept(spark, table)
    order = [r["id_str"] for r in news.read_news(spark, batch).orderBy("seq").collect()]
    assert order == ["1", "2", "3"]


def test_a_load_that_runs_again_adds_only_what_is_missing(spark, tmp_path):
    table = str(tmp_path / "news")
    lines = spark.createDataFrame([(status(i, i),) for i in range(20)], "value string")
    half = lines.filter(F.get_json_object("value", "$.retweet_count") < 10)
    ingest.ingest_batch(half, table, load=4, arrival=())
    ingest.ingest_batch(lines, table, load=4, arrival=())
    ingest.ingest_batch(lines, table, load=4, arrival=())
    assert len(kept(spark, table)) == 20


@pytest.mark.parametrize("cfg", [LookupConfig(), LookupConfig(max_broadcast_rows=0)], ids=["few", "many"])
def test_an_id_that_comes_back_with_another_time_is_stored_once(spark, tmp_path, cfg):
    table = str(tmp_path / "news")
    times = ["Sat Jan 14 03:25:04 +0000 2017", "Sun Jan 15 03:25:04 +0000 2017", "no time"]
    for load, time in enumerate(times):
        lines = spark.createDataFrame([(status(1, load, created_at=time),), (status(2 + load, load, created_at=time),)], "value string")
        ingest.ingest_batch(lines, table, load=load, arrival=(), cfg=cfg)
    assert kept(spark, table) == [("1", 0), ("2", 0), ("3", 1), ("4", 2)]


def opened(monkeypatch):
    """Parts of the table that the loads from here on open, a list for each load."""
    seen = []
    asked = news.may_hold
    monkeypatch.setattr(news, "may_hold", lambda *a, **b: seen.append(asked(*a, **b)) or seen[-1])
    return seen


def load(spark, table, load, ids, **more):
    lines = spark.createDataFrame([(status(i, load),) for i in ids], "value string")
    ingest.ingest_batch(lines, table, load=load, arrival=(), **more)


def test_a_small_load_opens_few_parts_however_large_the_table(spark, tmp_path, monkeypatch):
    table, seen = str(tmp_path / "news"), opened(monkeypatch)
    cfg = MemberConfig(ids_per_file=40, merge_every=8)
    files, done = [], 0
    for grown in (3, 30):
        for number in range(done, grown):
            load(spark, table, number, range(1_000 * number, 1_000 * number + 120), members=cfg)
        done = grown
        files.append(len(spark.read.parquet(table).inputFiles()))
        load(spark, table, 100 + grown, [7, 2_005, "new", f"other{grown}"], members=cfg)
        # one part for each of the two known ids, and now and then one that answers falsely
        assert 2 <= len(seen[-1]) <= 4
    assert files[1] >= 9 * files[0]
    assert kept(spark, table) == sorted(
        [(str(1_000 * n + i), n) for n in range(30) for i in range(120)] + [("new", 103), ("other3", 103), ("other30", 130)]
    )


def test_a_load_of_long_posts_is_dealt_by_bytes(spark, tmp_path):
    tables = [str(tmp_path / name) for name in ("one", "many")]
    for table, members in zip(tables, (MemberConfig(), MemberConfig(bytes_per_file=100))):
        load(spark, table, 0, range(200), members=members)
        load(spark, table, 1, range(100, 300), members=members)
    assert kept(spark, tables[0]) == kept(spark, tables[1]) and len(kept(spark, tables[0])) == 300
    files = [len(spark.read.parquet(table).inputFiles()) for table in tables]
    assert files[1] >= 3 * files[0]


def test_every_load_size_gives_the_same_table(spark, tmp_path):
    """By the index, by ids broadcast into the whole table, by a shuffle join."""
    tables = []
    for name, members, cfg in [
        ("index", MemberConfig(ids_per_file=7), LookupConfig()),
        ("broadcast", MemberConfig(ids_per_file=7, probe_ids=0), LookupConfig()),
        ("shuffle", MemberConfig(ids_per_file=7), LookupConfig(max_broadcast_rows=0)),
    ]:
        table = str(tmp_path / name)
        for number, ids in enumerate([range(0, 30), range(10, 50, 3), [], [49, 3, "x", "x"], range(0, 80)]):
            load(spark, table, number, ids, members=members, cfg=cfg)
        tables.append(kept(spark, table))
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == 81


def test_filters_written_before_a_failure_lose_nothing(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "news")
    load(spark, table, 0, range(5))
    with monkeypatch.context() as m:
        # the filters are there, the rows are not
        m.setattr(news, "add_filters", lambda *a: add_filters(*a) or (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            load(spark, table, 1, range(3, 9))
    assert len(kept(spark, table)) == 5
    load(spark, table, 1, range(3, 9))
    load(spark, table, 1, range(3, 9))
    assert kept(spark, table) == [(str(i), int(i > 4)) for i in range(9)]


def test_a_filter_finds_its_ids_and_few_others():
    draw = np.random.default_rng(5)
    inside, outside = draw.integers(-(2**63), 2**63, (2, 20_000))
    cfg = MemberConfig()
    bits = make_filter(inside, cfg)
    assert len(bits) <= 20_000 * cfg.bits_per_id // 8 + 1
    assert hits(bits, inside, cfg).all() and hits(bits, outside, cfg).mean() < 0.006


def test_an_unfinished_generation_of_the_index_is_passed_over(spark, tmp_path, monkeypatch):
    table, seen = str(tmp_path / "news"), opened(monkeypatch)
    load(spark, table, 0, range(5))
    os.makedirs(tmp_path / "news.members" / "g1")
    load(spark, table, 1, [4, 5])
    assert len(seen[-1]) == 1 and len(kept(spark, table)) == 6


def test_position_follows_arrival_without_a_sort(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "news")
    for n in range(6):
        land(landing, f"{9 - n}.json", [status(10 * n + i) for i in range(10)], at=1_000_000_000 + n)
    ingest.ingest_batch(news.read_landed(spark, landing).repartition(3, "file"), table)
    order = [int(r["id_str"]) for r in news.read_news(spark, table).orderBy("seq").collect()]
    assert order == list(range(60))


@pytest.mark.parametrize("stop", [0, 1, 2, 3])
def test_a_backfill_stopped_after_any_page_resumes(spark, tmp_path, monkeypatch, stop):
    pages, table = str(tmp_path / "pages"), str(tmp_path / "news")
    for n in range(4):
        land(pages, f"page{n}.json", [status(i, n) for i in range(5 * n, 5 * n + 7)], at=1_000_000_000 + n)

    def run():
        return ingest.backfill_pages(spark, pages, table, str(tmp_path / "done"))

    done = []
    whole = ingest.ingest_batch

    def breaking(*args, **more):
        if len(done) == stop:
            raise OSError("stopped")
        whole(*args, **more)
        done.append(args)

    with monkeypatch.context() as m:
        m.setattr(ingest, "ingest_batch", breaking)
        with pytest.raises(Exception, match="stopped"):
            run().awaitTermination()
    m = monkeypatch
    again = []
    m.setattr(ingest, "ingest_batch", lambda *a, **b: again.append(a) or whole(*a, **b))
    run().awaitTermination()
    run().awaitTermination()
    assert len(again) == 4 - stop
    want = {}
    for n in range(4):
        for i in range(5 * n, 5 * n + 7):
            want.setdefault(str(i), n)
    assert kept(spark, table) == sorted(want.items())
    order = [int(r["id_str"]) for r in news.read_news(spark, table).orderBy("seq").collect()]
    assert order == list(range(22))


def test_a_long_backlog_takes_few_micro_batches_and_keeps_its_loads(spark, tmp_path, monkeypatch):
    pages = str(tmp_path / "pages")
    for n in range(9):
        land(pages, f"page{9 - n}.json", [status(i, n) for i in range(5 * n, 5 * n + 7)], at=1_000_000_000 + n)
    whole, stop = ingest.ingest_batch, []

    def run(name, **more):
        """Micro-batches, and the ids of each load in order."""
        seen = []

        def watched(*a, **b):
            if stop and len(seen) == stop[0]:
                raise OSError("stopped")
            seen.append(whole(*a, **b)["lines"])

        monkeypatch.setattr(ingest, "ingest_batch", watched)
        table = str(tmp_path / name)
        more = {"pages_per_load": 2} | more
        query = ingest.backfill_pages(spark, pages, table, f"{table}-done", **more)
        if stop:
            with pytest.raises(Exception, match="stopped"):
                query.awaitTermination()
            return seen
        query.awaitTermination()
        loads = {}
        for r in news.read_news(spark, table).orderBy("seq").collect():
            loads.setdefault(r["seq"]["load"], []).append((int(r["id_str"]), r["rt_cnt"]))
        return seen, list(loads.values())

    each, loads = run("each")
    assert each == [14, 14, 14, 14, 7] and [len(x) for x in loads] == [12, 10, 10, 10, 5]
    assert run("few", most_batches=2) == ([42, 21], loads)
    stop.append(1)
    assert run("stopped", most_batches=2) == [42]
    stop.clear()
    # the micro-batch that was begun runs as it was planned
    assert run("stopped") == ([21], loads)


def test_bounded_stream_forgets_ids_past_the_bound(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "posts")
    hour, start = 3_600, 1_000_000_000

    def step(name, ids, at):
        land(landing, name, [status(i, at // hour) for i in ids] + ["oops"], at=start + at)
        source = ingest.landed_stream(spark, landing)
        ingest.bounded_stream(source, table, str(tmp_path / "c"), "1 hour", available_now=True).awaitTermination()
        return sorted((r["id_str"], r["rt_cnt"]) for r in spark.read.parquet(table).collect())

    assert step("a", [1, 2], 0) == [("1", 0), ("2", 0)]
    # inside the bound, over a restart: a repeat is dropped
    assert step("b", [1, 3], hour // 2) == [("1", 0), ("2", 0), ("3", 0)]
    assert step("c", [4], 4 * hour) == [("1", 0), ("2", 0), ("3", 0), ("4", 4)]
    # past it the id is forgotten and counts as new
    assert step("d", [1, 4], 4 * hour + 60) == [("1", 0), ("1", 4), ("2", 0), ("3", 0), ("4", 4)]
    assert "RocksDB" not in spark.conf.get(ingest.STORE_SETTING)


def test_a_load_counts_what_it_did(spark, tmp_path):
    table = str(tmp_path / "news")
    lines = [status(1), status(2), status(2), "oops", "[1]", '{"text":"x"}', status(1, retweet_count="absent"), status(1, id_str=None)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    want = {
        "lines": 8, "accepted": 3, "rejected: not a JSON object": 2, "rejected: not a status": 1,
        "rejected: missing field": 1, "rejected: no id": 1, "ids": 2,
    }
    assert ingest.ingest_batch(df, table, arrival=()) == {**want, "appended": 2}
    assert ingest.ingest_batch(df, table, arrival=()) == {**want, "appended": 0}


def test_backfill_and_live_in_one_query(spark, tmp_path):
    backfill, live, table = (str(tmp_path / n) for n in ("backfill", "live", "news"))
    land(backfill, "p.json", FIRST, at=1_000_000_000)
    land(live, "q.json", SECOND, at=1_000_000_100)
    both = ingest.landed_stream(spark, backfill).unionByName(ingest.landed_stream(spark, live))
    ingest.ingest_stream(both, table, str(tmp_path / "c"), available_now=True).awaitTermination()
    assert kept(spark, table) == [("1", 10), ("2", 20), ("3", 30)]


def test_create_leaves_an_existing_table_alone(spark, tmp_path):
    table = str(tmp_path / "news")
    news.create_news(spark, table)
    assert kept(spark, table) == []
    ingest.ingest_batch(spark.createDataFrame([(status(1),)], "value string"), table, arrival=())
    news.create_news(spark, table)
    assert kept(spark, table) == [("1", 0)]


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_cleaned_corpus_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1", "a b"), ("2", "")], "id_str string, clean string")
    path = str(tmp_path / "corpus")
    corpus_files.write_cleaned(df, path, fmt)
    back = corpus_files.read_cleaned(spark, path, fmt)
    assert sorted(map(tuple, back.collect())) == [("1", "a b"), ("2", "")]


def test_cleaned_corpus_line_must_have_two_parts(spark, tmp_path):
    land(str(tmp_path / "bad"), "part.txt", ["1,a b", "2,a,b"], at=1_000_000_000)
    with pytest.raises(Exception, match="id,words"):
        corpus_files.read_cleaned(spark, str(tmp_path / "bad"), "text").collect()


def test_reports(spark, tmp_path):
    posts = spark.createDataFrame(
        [(1, 'say "hi", é', "Sat", 3), (2, "two\nlines", "Sun", 4)], "event_rank int, tweet string, ctime string, rt_cnt int"
    )
    path = str(tmp_path / "final")
    reports.write_posts(posts, path, [F.col("event_rank")])
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert [tuple(r) for r in back.collect()] == [('say "hi", ', "Sat", "3"), ("two\nlines", "Sun", "4")]
    line = reports.report_lines(posts).filter("event_rank = 1").first()["line"]
    assert line == 'say "hi", , Sat, 3'

    terms = spark.createDataFrame(
        [(0, 2, "b"), (0, 1, "a"), (1, 1, "c")], "cluster int, rank int, term string"
    )
    reports.write_top_terms(terms, str(tmp_path / "terms"))
    back = spark.read.option("header", True).csv(str(tmp_path / "terms"))
    assert sorted(map(tuple, back.collect())) == [("0", "a b"), ("1", "c")]


def test_member_report_is_in_order(spark, tmp_path):
    members = spark.range(500).select(
        (F.col("id") % 2).cast("int").alias("cluster"),
        F.col("id").alias("seq"),
        ((F.col("id") * 37 % 101) / 101).alias("dist"),
    )
    path = str(tmp_path / "members")
    reports.write_cluster_members(members, path)
    files = spark.read.parquet(path).select("*", F.input_file_name().alias("f")).collect()
    assert len(files) == 500
    for c in (0, 1):
        mine = sorted((r for r in files if r["cluster"] == c), key=lambda r: r["f"])
        keys = [(-round(r["dist"], 3), r["seq"]) for r in mine]
        assert keys == sorted(keys)
    scored = members.withColumn("score", F.col("dist")).withColumn("dist_rank", F.col("seq"))
    reports.write_scored_posts(scored, str(tmp_path / "scored"))
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 500


def test_scratch_is_the_configured_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert stored(spark.range(5), "numbers").count() == 5


def test_scratch_is_dropped_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_NAMED", {})
    table = stored(spark.range(5), "numbers")
    assert scratch.drop_scratch(spark) == 1 and scratch.drop_scratch(spark) == 0
    with pytest.raises(Exception):
        table.count()


def test_whole_job_writes_every_report(spark, sf_dir, tmp_path):
    from storyrank.plans import views
    from storyrank.plans.reports import write_reports, write_side_branches
    from storyrank.sources.models import load_model

    table, out = str(tmp_path / "news"), str(tmp_path / "out")
    rows = views.news(spark, sf_dir)
    ingest.ingest_batch(views.status_lines(rows), table, arrival=())
    stored_news = news.read_news(spark, table)
    found = write_reports(stored_news, out)
    n = stored_news.count()
    assert spark.read.parquet(f"{out}/cleaned").count() == n
    members = spark.read.parquet(f"{out}/cluster_members")
    distinct = members.select("clean").distinct().count()
    assert members.count() == distinct <= n
    scored = spark.read.parquet(f"{out}/scored_posts")
    assert scored.groupBy("cluster").count().agg(F.max("count")).first()[0] <= 30
    options = {"header": True, "escape": '"', "multiLine": True}
    winners = spark.read.options(**options).csv(f"{out}/cluster_winners")
    assert winners.count() == scored.select("cluster").distinct().count()
    final = spark.read.options(**options).csv(f"{out}/final_posts")
    assert final.columns == ["tweet", "ctime", "rt_cnt"] and final.count() == 2
    assert spark.read.option("header", True).csv(f"{out}/cluster_terms").count() == 25

    write_side_branches(found, out)
    assert spark.read.option("header", True).csv(f"{out}/topic_words").count() == 25
    texts = members.count()
    for name in ("posts", "distances"):
        assert spark.read.parquet(f"{out}/map_{name}").count() == texts
    flat = spark.read.parquet(f"{out}/map_words")
    assert flat.columns == ["word", "x", "y"]
    assert flat.count() == load_model(spark, f"{out}/models/words").tables["vectors"].count()
    for name in ("words", "phrases"):
        similar = spark.read.parquet(f"{out}/similar_{name}")
        assert similar.groupBy("example").count().collect()[0]["count"] == 10
    assert load_model(spark, f"{out}/models/topics").tables["topics"].select("topic").distinct().count() == 25
    assert set(load_model(spark, f"{out}/models/lsa").tables) == {"terms", "basis"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        applicationId = "app"

        def __init__(self, master):
            self.master = master

    class Session:
        conf = {}

        def __init__(self, master):
            self.sparkContext = Context(master)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session("yarn"))
    assert scratch_root(Session("local[2]")) == scratch_root(Session("local[2]"))
