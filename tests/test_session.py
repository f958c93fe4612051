"""Published sessions, output sizing and the one-document form."""

import datetime as dt
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.session import local_path, scratch_path
from leadflow.sinks import publish as P
from leadflow.sinks import session as SS
from leadflow.sources import document as DOC

AT = dt.datetime(2024, 5, 1, 8)
LEADS = "item_id string, stage string, note string"


def some_leads(spark, n, skew=0.9, tasks=4):
    stage = F.when(F.rand(1) < skew, "won").otherwise(F.concat(F.lit("s"), (F.col("id") % 6).cast("string")))
    return spark.range(0, n, 1, tasks).select(F.col("id").cast("string").alias("item_id"), stage.alias("stage"), F.sha2(F.col("id").cast("string"), 512).alias("note"))


def files_of(path, suffix):
    return {f: os.path.getsize(f) for f in glob.glob(f"{local_path(path)}/**/*{suffix}", recursive=True)}


def test_file_sizes_follow_the_target_however_skewed(spark):
    leads = some_leads(spark, 60_000, tasks=64)
    counts = {}
    for target in (1 << 20, 1 << 18):
        root = scratch_path(spark, "sized")
        SS.publish_session(leads, root, AT, file_bytes=target)
        sizes = files_of(SS.session_path(spark, root, "stages"), ".csv")
        won = [s for f, s in sizes.items() if "stage=won" in f]
        assert max(won) < 3 * target                    # the skewed stage is split
        counts[target] = len(won)
        small = [f for f in sizes if "stage=won" not in f]
        assert len(small) <= 6 * (len(won) + 1)         # a small stage may share the skewed one's shuffle partition
    assert counts[1 << 18] > 2 * counts[1 << 20]
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true") == "true"


def test_a_session_that_dies_half_way_leaves_the_old_one(spark, monkeypatch):
    root, old, new = scratch_path(spark, "sessions"), some_leads(spark, 200), some_leads(spark, 300)
    SS.publish_session(old, root, AT)

    def dies(*a, **k):
        raise RuntimeError("executor lost for good")
    monkeypatch.setattr(SS, "write_document", dies)     # after three of the four datasets
    with pytest.raises(RuntimeError):
        SS.publish_session(new, root, AT + dt.timedelta(hours=4))
    assert len(os.listdir(local_path(f"{root}/runs"))) == 2
    for dataset in ("combined", "stages"):
        assert SS.read_session_csv(spark, root, dataset, LEADS).count() == 200
    monkeypatch.undo()
    run = SS.publish_session(new, root, AT + dt.timedelta(hours=4))     # a second try of the same time
    assert P.latest_run(spark, root) == run and P.unfinished(spark, root, run) == {}
    assert SS.read_session_csv(spark, root, "combined", LEADS).count() == 300
    assert SS.read_session_csv(spark, root, "combined", LEADS, run=P.live_runs(spark, root)[0]).count() == 200
    whole = DOC.read_document(spark, SS.session_path(spark, root, "document"), T.StructType.fromDDL("item_id string, note string"))
    assert sorted(map(tuple, whole.select("item_id", "stage", "note").collect())) == sorted(map(tuple, new.collect()))


RECORD_DDL = "id long, txt string, m map<string,string>, deep array<struct<a:array<long>>>"


def awkward(n, seed):
    r = random.Random(seed)
    doc = {}
    for stage in ("won", "lo}st", 'q"uo}te', "back\\slash\\", "", "empty", "[{"):
        doc[stage] = [] if stage == "empty" else [
            {"id": i, "txt": r.choice(["a", "}{", '"', "\\", "\\\"}", "[]}", "é\n}", None, "x" * 300 + "}"]), "m": {"k": r.choice(["1", '}"'])},
             "deep": [{"a": [1, 2]}, {"a": []}]} for i in range(n)]
    return doc


def expected(doc):
    return sorted((s, x["id"], repr(x["txt"]), repr(x["m"]), repr([d["a"] for d in x["deep"]])) for s, v in doc.items() for x in v)


def found(spark, path):
    return sorted((x.stage, x.id, repr(x.txt), repr(x.m), repr([list(d.a) for d in x.deep])) for x in DOC.read_document(spark, path, T.StructType.fromDDL(RECORD_DDL)).collect())


@pytest.fixture
def split_size(spark):
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key), spark.conf.get(cost)
    spark.conf.set(cost, "1")
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before[0])
    spark.conf.set(cost, before[1])


@pytest.mark.parametrize("indent, size, end", [(None, 90, ""), (2, 90, "\n"), (None, 700, "\n\n"), (1, 100_000, "")])
def test_one_document_is_read_by_splits(spark, split_size, indent, size, end):
    doc = awkward(25, indent or 0)
    path = local_path(scratch_path(spark, "one"))
    os.makedirs(path)
    with open(f"{path}/document.json", "w") as f:
        f.write(json.dumps(doc, indent=indent, ensure_ascii=False) + end)
    split_size(size)
    assert found(spark, path) == expected(doc)
    if size < 1000:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("text", ["", "{}", "{ }\n", '{"won": []}', '{"a": [], "b": [ ]}'])
def test_documents_without_records(spark, text):
    path = local_path(scratch_path(spark, "none"))
    os.makedirs(path)
    with open(f"{path}/document.json", "w") as f:
        f.write(text)
    assert DOC.read_document(spark, path, T.StructType.fromDDL(RECORD_DDL)).count() == 0


def test_ordered_parts_are_one_document(spark):
    rows = [(s, x["id"], x["txt"], x["m"]) for s, v in awkward(40, 1).items() for x in v] + [(None, 1, "no stage", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "stage string, id long, txt string, m map<string,string>")
    path = SS.write_document(df, scratch_path(spark, "parts"), ["id"], partitions=7)
    parts = sorted(files_of(path, ".txt"))
    assert len(parts) > 3
    doc = json.loads("".join(open(p, encoding="utf-8", newline="").read() for p in parts))
    assert list(doc) == sorted({r[0] for r in rows if r[0] is not None})
    assert all([x["id"] for x in v] == sorted(x["id"] for x in v) for v in doc.values())
    back = DOC.read_document(spark, path, T.StructType.fromDDL("id long, txt string, m map<string,string>"))
    assert sorted(map(repr, back.select("stage", "id", "txt", "m").collect())) == sorted(map(repr, df.filter("stage IS NOT NULL").collect()))
    empty = SS.write_document(df.limit(0), scratch_path(spark, "parts"), ["id"])
    assert json.loads("".join(open(p).read() for p in sorted(files_of(empty, ".txt")))) == {}


def test_one_shuffle_feeds_the_three_datasets(spark, monkeypatch):
    """Combined, stages and grouped are written from one stored deal; its row numbers are in no output."""
    dealt = []
    whole = SS.rebalanced
    monkeypatch.setattr(SS, "rebalanced", lambda df, *by: dealt.append(by) or whole(df, *by))
    leads = spark.range(500).select(F.col("id").cast("string").alias("item_id"), F.when(F.col("id") % 3 == 0, "won").otherwise("lost").alias("stage"))
    root = scratch_path(spark, "one-shuffle")
    run = SS.publish_session(leads, root, AT)
    assert len(dealt) == 1
    for name in ("combined", "stages", "grouped"):
        path = SS.session_path(spark, root, name, run)
        got = spark.read.json(path) if name == "grouped" else spark.read.option("header", True).csv(path)
        assert sorted(got.columns) == ["item_id", "stage"]
        assert sorted((str(r.item_id), r.stage) for r in got.collect()) == sorted((r.item_id, r.stage) for r in leads.collect())
    text = "".join(r.value for r in spark.read.text(SS.session_path(spark, root, "document", run)).collect())
    assert SS.ROW_ID not in text and text.count("item_id") == 500


def test_landed_board_pages_are_small_and_whole(spark):
    """Pages hold every item with its column ids, in files well below the size of their text."""
    from leadflow.plans.landing import BOARD_COLUMNS, land_board_pages
    from leadflow.sources.pages import read_board_items
    leads = spark.range(3000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("item_id"), F.concat(F.lit("Lead "), "id").alias("item_name"),
                                     F.lit("won").alias("stage"), *[F.concat(F.lit(f"{c}-"), (F.col("id") % 7).cast("string")).alias(c) for c in BOARD_COLUMNS])
    path = land_board_pages(leads, scratch_path(spark, "small-pages"))
    items = read_board_items(spark, path)
    assert {(r.page, r.pos, r.id) for r in items.collect()} == {(i // 50 + 1, i % 50 + 1, str(i)) for i in range(3000)}
    text = spark.read.text(path).agg(F.sum(F.length("value"))).first()[0]
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    assert size < text / 4
