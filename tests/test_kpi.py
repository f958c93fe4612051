import pytest

from leadflow.operators import kpi as K

COLS = "item_id string, seq long, stage string, owner string, email string, date_created string, " \
       "sales_call_date string, deal_value string, utm_source string, utm_campaign string, utm_content string, origin string"


def leads(spark, rows):
    return spark.createDataFrame(rows, COLS)


ROWS = [
    ("1", 1, "won", "ann", "a@x", "2024-01-05", "2024-01-06", "100", "google-ads", "c1", "x", "cold-email"),
    ("2", 2, "proposal", "ann", "b@x", "2024-01-07", "2024-01-08", "50", "google-ads", "c1", "x", "LinkedIn"),
    ("3", 3, "scheduled", "bob", "c@x", "2024-01-09", None, "n/a", None, "c2", "y", "cold-calling"),
    ("4", 4, "cancelled", "bob", None, "2023-12-01", None, "", "linkedin", "c2", "y", "LinkedIn"),
    ("5", 5, "lost", None, "e@x", "2024-01-10", "2024-01-11", "5", "google-ads", "c3", "z", "cold-email"),
    ("6", 6, "unqualified", "cat", "f@x", "bad", "2024-01-12", "7", "", None, "z", "LinkedIn"),
]


def by_key(df, key="owner"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_overview_counts_and_total(spark):
    out = by_key(K.kpi_overview(leads(spark, ROWS), "2024-01-01", "2024-01-31"))
    assert set(out) == {"ann", "bob", "cat", "Total"}      # null owner dropped, cat kept with zeros
    ann = out["ann"]
    assert (ann["new_calls_booked"], ann["proposals"], ann["won"], ann["cold_emails"], ann["linkedin"]) == (2, 2, 1, 1, 1)
    assert ann["closed_revenue"] == 100.0 and ann["pipeline_revenue"] == 50.0
    assert ann["close_rate"] == 50.0 and ann["revenue_per_call"] == 50.0
    bob = out["bob"]
    assert bob["new_calls_booked"] == 1 and bob["cancelled_calls"] == 0      # cancelled row out of range
    cat = out["cat"]
    assert cat["new_calls_booked"] == 0 and cat["show_rate"] == 0.0          # unparsable date
    tot = out["Total"]
    assert tot["new_calls_booked"] == 3                                      # sum of raw metrics
    rates = [out[k]["close_rate"] for k in ("ann", "bob", "cat")]
    assert tot["close_rate"] == pytest.approx(sum(rates) / 3)                # unweighted mean
    assert "close" not in out["Total"]


def test_empty_and_all_null_owner(spark):
    empty = leads(spark, [])
    t = K.kpi_overview(empty, "2024-01-01", "2024-01-31").collect()
    assert len(t) == 1 and t[0]["owner"] == "Total" and t[0]["new_calls_booked"] == 0
    assert t[0]["show_rate"] is None                                          # mean over no groups
    nulls = leads(spark, [r[:3] + (None,) + r[4:] for r in ROWS])
    assert [r["owner"] for r in K.kpi_overview(nulls, "2024-01-01", "2024-01-31").collect()] == ["Total"]


def test_campaign_report_filters_booked_only(spark):
    out = by_key(K.kpi_by_campaign(leads(spark, ROWS), "2024-01-01", "2024-01-31"), "utm_campaign")
    assert set(out) == {"c1", "c3", "Total"}                                 # campaigns with google-ads rows
    assert out["c1"]["new_calls_booked"] == 2 and out["c1"]["google_ads"] == 2
    none = leads(spark, [r[:8] + ("linkedin",) + r[9:] for r in ROWS])
    assert K.kpi_by_campaign(none, "2024-01-01", "2024-01-31").count() == 0   # no google-ads rows: empty


def test_sales_date_fallback(spark):
    df = leads(spark, ROWS)
    a = by_key(K.kpi_cold_email(df, "2024-01-01", "2024-01-31", sales_date_col=None))
    assert a["ann"]["sales_call_taken"] == 2


def test_metamorphic_widening_and_permutation(spark):
    df = leads(spark, ROWS)
    narrow = by_key(K.kpi_overview(df, "2024-01-06", "2024-01-09"))
    wide = by_key(K.kpi_overview(df, "2023-01-01", "2025-01-01"))
    for k in narrow:
        for m in ("new_calls_booked", "won", "proposals", "cancelled_calls"):
            assert wide[k][m] >= narrow[k][m]
    perm = by_key(K.kpi_overview(leads(spark, list(reversed(ROWS))), "2024-01-01", "2024-01-31"))
    assert perm == by_key(K.kpi_overview(df, "2024-01-01", "2024-01-31"))


def test_utm_rollup_no_date_column(spark):
    df = leads(spark, ROWS).drop("date_created")
    got = {r["utm_campaign"]: (r["count"], r["total_deal_value"]) for r in K.utm_rollup(df, "utm_campaign", "2024-01-01", "2024-01-31").collect()}
    assert got == {"c1": (2, 150.0), "c2": (2, 0.0), "c3": (1, 5.0)}


def test_one_key_no_lead_in_range_and_no_proposals(spark):
    rows = [r for r in ROWS if r[3] == "ann"]
    one = by_key(K.kpi_overview(leads(spark, rows), "2024-01-01", "2024-01-31"))
    assert set(one) == {"ann", "Total"} and one["Total"]["close_rate"] == one["ann"]["close_rate"]
    none_in_range = by_key(K.kpi_overview(leads(spark, ROWS), "2030-01-01", "2030-12-31"))
    assert all(v["new_calls_booked"] == 0 for v in none_in_range.values())
    assert set(none_in_range) == {"ann", "bob", "cat", "Total"}           # keys come from all dates
    no_prop = [r for r in ROWS if r[2] not in ("proposal",)]
    np_ = by_key(K.kpi_overview(leads(spark, no_prop), "2024-01-01", "2024-01-31"))
    assert np_["ann"]["pipeline_revenue"] == 0.0 and np_["ann"]["proposals"] == 1   # the won row


def test_total_row_only_sums_raw_metrics(spark):
    out = by_key(K.kpi_google_ads(leads(spark, ROWS), "2024-01-01", "2024-01-31"))
    groups = [v for k, v in out.items() if k != "Total"]
    assert out["Total"]["google_ads"] == pytest.approx(sum(g["google_ads"] for g in groups) / len(groups))
    assert out["Total"]["won"] == sum(g["won"] for g in groups)


def test_display_order_first_seen_total_last(spark):
    df = leads(spark, ROWS)
    rep = K.kpi_overview(df, "2024-01-01", "2024-01-31")
    keys = [r.owner for r in K.display_order(rep, df, "owner").collect()]
    # cancelled stage first (bob), then lost (owner null), proposal (ann), ..., unqualified (cat)
    assert keys == ["bob", "ann", "cat", "Total"]


def test_missing_utm_source_column(spark):
    df = leads(spark, ROWS).drop("utm_source")
    with pytest.raises(Exception):
        K.kpi_google_ads(df, "2024-01-01", "2024-01-31").collect()        # channel column required
    out = by_key(K.kpi_by_campaign(df, "2024-01-01", "2024-01-31"), "utm_campaign")
    assert set(out) == {"c1", "c2", "c3", "Total"}                       # no channel filter then
    assert out["c2"]["new_calls_booked"] == 1                            # scheduled row in range
    with pytest.raises(ValueError):
        K.kpi_overview(leads(spark, ROWS).drop("owner"), "2024-01-01", "2024-01-31")
