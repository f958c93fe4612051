import datetime as dt
import json
import os
import tempfile

import pytest

from leadflow.schemas import SCHEDULED_EVENT_ROW
from leadflow.sources import pages as S
from leadflow.sources import snapshots as SN
from pyspark.sql import types as T


def _write(lines):
    d = tempfile.mkdtemp(prefix="leadflow-pages-")
    with open(os.path.join(d, "pages.json"), "w") as f:
        for x in lines:
            f.write(json.dumps(x) + "\n")
    return d


def _page(stream, page, uris, error=None, last=False):
    doc = {"stream": stream, "page": page, "collection": [{"uri": u, "status": stream} for u in uris],
           "pagination": {"next_page": None if last else f"{stream}?page={page + 1}"}}
    if error:
        doc["error"] = error
        doc["collection"] = []
    return doc


def test_prefix_until_error(spark):
    path = _write([
        _page("a", 1, ["a1"], error="HTTP 500"), _page("a", 2, ["a2"]),          # error on page 1
        _page("b", 1, ["b1"]), _page("b", 2, [], error="boom"), _page("b", 3, ["b3"]),  # mid-stream
        _page("c", 1, ["c1", "c2"]), _page("c", 2, ["c3"], last=True),            # no error
        _page("d", 1, ["d1"], last=True), _page("d", 2, ["d2"]),                  # a missing link cuts nothing
    ])
    rows = S.read_collection_rows(spark, path, SCHEDULED_EVENT_ROW)
    assert sorted(r.uri for r in rows.collect()) == ["b1", "c1", "c2", "c3", "d1", "d2"]
    assert [r.pos for r in rows.filter("stream = 'c'").orderBy("page", "pos").collect()] == [1, 2, 1]


def test_scheduled_event_defaults(spark):
    path = _write([{"stream": "active", "page": 1, "collection": [{"uri": "e1"}], "pagination": {}}])
    ev = S.scheduled_events(S.read_collection_rows(spark, path, SCHEDULED_EVENT_ROW)).collect()[0]
    assert (ev.name, ev.status, ev.location, ev.event_memberships) == ("", "", {}, [])


def test_board_pages_shapes_and_errors(spark):
    item = {"id": "1", "name": "one", "column_values": [{"id": "email__1", "text": "a@x"}]}
    first = {"stream": "topics", "page": 1, "data": {"boards": [{"groups": [
        {"id": "topics", "title": "T", "items_page": {"cursor": "c", "items": [item]}}]}]}}
    nxt = {"stream": "topics", "page": 2, "data": {"next_items_page": {"cursor": None, "items": [dict(item, id="2")]}}}
    items = S.read_board_items(spark, _write([first, nxt]))
    assert sorted(r.id for r in items.collect()) == ["1", "2"]
    bad = {"stream": "topics", "page": 3, "errors": [{"message": "m1"}, {"message": "m2"}]}
    # The check runs inside the scan: the job fails with the page's messages.
    with pytest.raises(Exception, match="m1\nm2"):
        S.read_board_items(spark, _write([first, bad])).collect()
    with pytest.raises(RuntimeError, match="m1"):
        S.assert_no_page_errors(S.read_board_page_frame(spark, _write([first, bad])))
    with pytest.raises(RuntimeError):
        S.read_board_groups(spark, _write([{"stream": "g", "page": 1, "data": {"boards": [{"groups": []}]}}]))


def test_grouped_document_reader(spark):
    d = tempfile.mkdtemp(prefix="leadflow-doc-")
    with open(os.path.join(d, "grouped.json"), "w") as f:
        json.dump({"won": [{"item_id": "1"}, {"item_id": "2"}], "lost": [{"item_id": "3"}]}, f, indent=2)
    rec = T.StructType([T.StructField("item_id", T.StringType())])
    got = sorted((r.stage, r.item_id) for r in SN.read_grouped_document(spark, d, rec).collect())
    assert got == [("lost", "3"), ("won", "1"), ("won", "2")]


def test_latest_flat_snapshot(spark):
    d = tempfile.mkdtemp(prefix="leadflow-snap-")
    for name, mtime in [("combined_output_20240101_000000.csv", 100), ("combined_output_20240102_000000.csv", 200),
                        ("won_20240101_000000.csv", 300)]:
        path = os.path.join(d, name)
        with open(path, "w") as f:
            f.write("a\n1\n")
        os.utime(path, (mtime, mtime))
    got = {r.family: (r.file_name, str(r.run_timestamp)) for r in SN.latest_flat_snapshot(spark, f"{d}/*.csv").collect()}
    assert got == {"combined_output": ("combined_output_20240102_000000.csv", "2024-01-02 00:00:00"),
                   "won": ("won_20240101_000000.csv", "2024-01-01 00:00:00")}


def test_profile_json_export_round_trip(spark):
    import datetime as dt
    from leadflow.sinks import writers as W
    prof = spark.createDataFrame([("Ann", "a@x", "users/1", "https://api.example/organizations/ORG1")],
                                 "name string, email string, uri string, current_organization string")
    base = tempfile.mkdtemp(prefix="leadflow-prof-")
    path = W.export_profile_json(prof, base, dt.datetime(2024, 1, 1))
    r = spark.read.json(path).collect()[0]
    assert (r.metadata.organization_id, r.user.email) == ("ORG1", "a@x")


def test_raw_api_pages_take_stream_and_page_from_path(spark):
    root = tempfile.mkdtemp(prefix="leadflow-raw-")
    for stream, pages in {"active": [["a1", "a2"], ["a3"]], "canceled": [["c1"]]}.items():
        os.makedirs(os.path.join(root, stream))
        for n, uris in enumerate(pages, 1):
            with open(os.path.join(root, stream, f"page-{n}.json"), "w") as f:
                json.dump({"collection": [{"uri": u} for u in uris],
                           "pagination": {"next_page": "x" if n < len(pages) else None}}, f)
    rows = S.read_collection_rows(spark, f"{root}/*/*.json", SCHEDULED_EVENT_ROW)
    got = sorted((r.stream, r.page, r.pos, r.uri) for r in rows.collect())
    assert got == [("active", 1, 1, "a1"), ("active", 1, 2, "a2"), ("active", 2, 1, "a3"), ("canceled", 1, 1, "c1")]


def test_chunked_json_files_and_numbering(spark):
    import glob
    import json

    from leadflow.sinks import writers as W
    df = spark.range(0, 50, numPartitions=3).selectExpr("id", "concat('r', lpad(cast(id AS string), 3, '0')) AS k", "map('a', id) AS m", "cast(null AS string) AS gone")
    base = tempfile.mkdtemp(prefix="leadflow-chunks-")
    data, manifest = W.write_chunked_json(df, base, "k", size=7, ts=dt.datetime(2024, 1, 31, 6))
    got = {}
    files = glob.glob(f"{data}/part-*.json")
    for f in files:
        with open(f) as fh:
            (doc,) = map(json.loads, fh)              # one document a file
        rows, meta = doc["invitees"], doc["metadata"]
        assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
        assert all(r["gone"] is None for r in rows)   # empty fields stay
        got.update({r["id"]: meta["chunk_number"] for r in rows})
        assert (meta["chunk_size"], meta["total_invitees"], meta["total_chunks"], meta["base_filename"]) == (len(rows), 50, 8, base.rsplit("/", 1)[-1])
        assert meta["extraction_timestamp"] == "2024-01-31T06:00:00"
    assert len(files) == 8 and got == {i: i // 7 + 1 for i in range(50)}
    man = sorted((r.chunk_number, r.chunk_size, r.total_chunks) for r in spark.read.json(manifest).collect())
    assert man == [(c, 7 if c < 8 else 1, 8) for c in range(1, 9)]


def test_entity_csv_exports_and_status(spark):
    from leadflow.sinks import writers as W
    base = tempfile.mkdtemp(prefix="leadflow-ent-")
    members = spark.createDataFrame([("users/1", "Ann", "a@x", "admin", "active")],
                                    "user_uri string, name string, email string, role string, status string")
    types = spark.createDataFrame([("t1", "Intro", True, ["a", "b"])], "uri string, name string, active boolean, tags array<string>")
    mp = W.export_entity_csv("members", members, base)
    tp = W.export_entity_csv("events", types.withColumnRenamed("tags", "kind"), base)
    m = spark.read.option("header", True).csv(mp).collect()[0]
    t = spark.read.option("header", True).csv(tp).collect()[0]
    assert (m.user_uri, m.role) == ("users/1", "admin")
    assert t.kind == '["a","b"]'                          # nested values leave as JSON text
    st = {r.family: r.exists for r in SN.snapshot_status(spark, f"{base}/*/*", ["members", "events", "invitees"]).collect()}
    assert st == {"members": False, "events": False, "invitees": False}   # not run-stamped: no family match
