from pyspark.sql import functions as F

from leadflow.operators import analytics as A
from leadflow.operators import joins as J
from leadflow.operators import transform as T


def test_origin_precedence_and_nulls(spark):
    leads = spark.createDataFrame([("1", "a@x"), ("2", "A@x"), ("3", None), ("4", "b@x"), ("5", "c@x")],
                                  "item_id string, email string")
    bookings = spark.createDataFrame([("a@x", "cold-calling"), ("a@x", "cold-email"), (None, "cold-email"),
                                      ("b@x", "cold-calling"), ("z@x", None)],
                                     "invitee_email string, origin string")
    got = {r["item_id"]: r["origin"] for r in J.annotate_origins(leads, bookings).collect()}
    assert got == {"1": "cold-email", "2": "LinkedIn", "3": "LinkedIn", "4": "cold-calling", "5": "LinkedIn"}
    empty = bookings.limit(0)
    assert {r["origin"] for r in J.annotate_origins(leads, empty).collect()} == {"LinkedIn"}


def test_first_invitee_status_beats_position(spark):
    inv = spark.createDataFrame([
        ("e1", 1, "canceled", "n1", "m1"), ("e1", 2, "active", "n2", "m2"),   # both: active wins
        ("e2", 1, "canceled", "n3", None),                                     # only canceled
        ("e3", 1, "other", "n4", "m4"),                                        # ignored status
    ], "event_uri string, pos int, status string, name string, email string")
    ev = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("e4",)], "uri string")
    got = {r["uri"]: (r["invitee_name"], r["invitee_email"]) for r in J.enrich_first_invitee(ev, inv).collect()}
    assert got == {"e1": ("n2", "m2"), "e2": ("n3", None), "e3": (None, None), "e4": (None, None)}


def test_semi_anti_spine(spark):
    m = spark.createDataFrame([("u1", "a", "a@"), ("u2", "b", "b@")], "user_uri string, name string, email string")
    t = spark.createDataFrame([("t1", "u1"), ("t2", "u1")], "uri string, owner_uri string")
    assert [r.user_uri for r in J.members_with_types(m, t).collect()] == ["u1"]
    assert [r.user_uri for r in J.members_without_types(m, t).collect()] == ["u2"]
    cov = J.member_type_coverage(m, t).collect()[0]
    assert (cov.total_members, cov.members_with_types, cov.success_rate) == (2, 1, 50.0)
    keys = spark.createDataFrame([("x",), ("y",)], "k string")
    agg = spark.createDataFrame([("x", 3)], "k string, n long")
    assert {r.k: r.n for r in J.on_spine(keys, agg, "k").collect()} == {"x": 3, "y": 0}


def test_items_to_wide_edge_cases(spark):
    schema = "id string, name string, page int, pos int, column_values array<struct<id:string,text:string>>"
    items = spark.createDataFrame([
        ("1", "one", 1, 1, [("a", "1a"), ("b", "1b")]),
        ("2", "two", 1, 2, [("a", "2a"), ("c", "2c"), ("a", "2a-last")]),   # extra id c, repeated a
        ("3", "three", 1, 3, [("b", "3b")]),                                 # missing a
    ], schema)
    got = {r.item_id: (r.a, r.b) for r in T.items_to_wide(items).collect()}
    assert got == {"1": ("1a", "1b"), "2": ("2a-last", None), "3": (None, "3b")}
    assert "c" not in T.items_to_wide(items).columns
    first_empty = spark.createDataFrame([("1", "one", 1, 1, [])], schema)
    assert T.items_to_wide(first_empty).count() == 0


def test_filter_by_date_missing_column_keeps_schema(spark):
    df = spark.createDataFrame([("1", "2024-01-01")], "id string, d string")
    out = T.filter_by_date(df, "nope", "2024-01-01", "2024-12-31")
    assert out.count() == 0 and out.columns == df.columns


def test_qa_wide_equals_long(spark):
    df = spark.createDataFrame([(1, [("q1", "a1"), ("q2", None)]), (2, [("q2", "b")]), (3, [])],
                               "id int, questions_and_answers array<struct<question:string,answer:string>>")
    wide = T.flatten_qa(df)
    long = T.explode_qa(df, "id")
    assert wide.columns == ["id", "question_1", "answer_1", "question_2", "answer_2"]
    from_long = {(r.id, r.position): (r.question, r.answer) for r in long.collect()}
    from_wide = {}
    for r in wide.collect():
        for j in (1, 2):
            if r[f"question_{j}"] is not None:
                from_wide[(r.id, j)] = (r[f"question_{j}"], r[f"answer_{j}"])
    assert from_long == from_wide


def test_question_analysis_lowest_position(spark):
    long = spark.createDataFrame([
        (1, 1, "Q", "x"), (2, 1, "Q", "y"), (3, 2, "Q", "z"),    # Q at positions 1 and 2: only 1 counts
        (1, 2, "R", None), (2, 3, "", "w"),                       # null answer dropped, empty question skipped
    ], "id int, position int, question string, answer string")
    counts = {r.question: (r.first_position, r["count"]) for r in A.question_counts(long).collect()}
    assert counts == {"Q": (1, 2), "R": (2, 1)}
    answers = {(r.question, r.answer): r["count"] for r in A.question_answers(long).collect()}
    assert answers == {("Q", "x"): 1, ("Q", "y"): 1}


def test_value_counts_topk_tie_break(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    got = [(r.value, r["count"]) for r in A.value_counts(df, "v", 2).collect()]
    assert got == [("c", 2), ("a", 1)]


def test_event_statistics_single_row_std_null(spark):
    t = spark.createDataFrame([("t1", True, 30, "user", "ann")], "uri string, active boolean, duration int, source string, owner_name string")
    r = A.event_statistics(t).collect()[0]
    assert (r.total_events, r.active_events, r.duration_median, r.duration_std) == (1, 1, 30.0, None)


def test_union_stages_fills_missing(spark):
    a = spark.createDataFrame([("1", "x")], "id string, deal string")
    b = spark.createDataFrame([("2",)], "id string")
    got = {r.id: r.deal for r in T.union_stages([a, b]).collect()}
    assert got == {"1": "x", "2": None}
    f = F.col("id")
    assert T.union_stages([a, b]).filter(f == "2").count() == 1


def test_items_to_wide_per_group_column_sets(spark):
    schema = ("id string, name string, group_id string, page int, pos int, "
              "column_values array<struct<id:string,text:string>>")
    items = spark.createDataFrame([
        ("1", "one", "g1", 1, 1, [("a", "1a")]),
        ("2", "two", "g1", 1, 2, [("a", "2a"), ("b", "2b")]),    # b not in g1's first item: dropped
        ("3", "three", "g2", 1, 1, [("b", "3b")]),
        ("4", "four", "g2", 2, 1, [("a", "4a"), ("b", "4b")]),   # a not in g2's first item: dropped
    ], schema)
    w = T.items_to_wide(items, keep=("group_id",))
    assert w.columns == ["item_id", "item_name", "a", "b", "group_id"]
    got = {r.item_id: (r.a, r.b) for r in w.collect()}
    assert got == {"1": ("1a", None), "2": ("2a", None), "3": (None, "3b"), "4": (None, "4b")}


def test_distributions_one_pass_nulls_and_top_n(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), ("c", "y"), (None, "y"), ("b", "z")],
                               "s string, t string")
    got = sorted((r.dimension, r.value, r["count"]) for r in
                 A.distributions(df, [("s", "s", None), ("t", "t", 2)]).collect())
    # nulls are not counted; top-2 of t: y (3) then x/z tie broken by value
    assert got == [("s", "a", 2), ("s", "b", 2), ("s", "c", 1), ("t", "x", 1), ("t", "y", 3)]
