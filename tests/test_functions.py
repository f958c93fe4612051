import datetime as dt
import math


from leadflow import functions as LF


def _one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")


def test_coerce_date_formats(spark):
    vals = ["2024-01-05", "2024-01-05T23:30:00-05:00", "2024-01-05 14:05", "01/05/2024", "1/5/2024",
            "2024/1/5", "", None, "2024-02-30", "not a date", " 2024-01-05 ", "2024-01-05garbage"]
    got = [r["d"] for r in _one_col(spark, vals).orderBy("i").select(LF.coerce_date("v").alias("d")).collect()]
    d = dt.date(2024, 1, 5)
    # Wall date kept (no zone shift); month first for slashes; impossible dates -> null.
    assert got == [d, d, d, d, d, d, None, None, None, None, d, None]


def test_to_number_rules(spark):
    vals = ["", " 7 ", "1,200", "1e3", "inf", "nan", "1d", None, "-2.5", ".5", "0x1p3", "abc"]
    got = [r["n"] for r in _one_col(spark, vals).orderBy("i").select(LF.to_number("v").alias("n")).collect()]
    assert got[:4] == [0.0, 7.0, 0.0, 1000.0]
    assert math.isinf(got[4]) and got[5] == 0.0 and got[6] == 0.0 and got[7] == 0.0
    assert got[8:] == [-2.5, 0.5, 0.0, 0.0]


def test_safe_divide_and_rate(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 4.0), (float("nan"), 1.0), (float("inf"), 1.0)],
                               "n double, d double")
    got = [r[0] for r in df.select(LF.safe_divide("n", "d")).collect()]
    assert got == [0.0, 0.0, 0.75, 0.0, 0.0]
    assert df.select(LF.rate("n", "d")).collect()[2][0] == 75.0


def test_calendar_uri_key_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10), "https://x/organizations/ABC", "key-1")],
                               "ts timestamp, uri string, k string")
    r = df.select(LF.month_of("ts"), LF.weekday_of("ts"), LF.uri_tail("uri"),
                  LF.key_hash("k"), LF.key_id(LF.key_hash("k"))).collect()[0]
    import hashlib
    h = hashlib.sha256(b"key-1").hexdigest()
    assert tuple(r) == ("2024-01", "Monday", "ABC", h, h[:8])


def test_expiry_and_truthy(spark):
    now = dt.datetime(2024, 2, 1)
    df = spark.createDataFrame([(True, None), (True, dt.datetime(2024, 1, 1)), (False, dt.datetime(2025, 1, 1))],
                               "a boolean, e timestamp")
    r = df.select(LF.is_expired("e", now).alias("x"), LF.is_valid("a", "e", now).alias("v")).collect()
    assert [(x.x, x.v) for x in r] == [(False, True), (True, False), (False, False)]
    p = spark.createDataFrame([("", "old", 0, 5), (None, "old", None, 5), ("new", "old", 7, 5)],
                              "n string, o string, nr int, orr int")
    got = p.select(LF.truthy_or("n", "o"), LF.truthy_or("nr", "orr", kind="number")).collect()
    assert [tuple(x) for x in got] == [("old", 5), ("old", 5), ("new", 7)]


def test_extract_date_and_run_timestamp(spark):
    df = _one_col(spark, ["due 2024-13-45 ok", "none", "combined_output_20240102_030405.csv"])
    r = df.orderBy("i").select(LF.extract_date("v"), LF.run_timestamp_from_name("v")).collect()
    assert r[0][0] == "2024-13-45" and r[1][0] is None
    assert r[2][1] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_to_number_matches_python_rule_on_generated_texts(spark):
    """Property check: random number-like texts against a plain Python rule."""
    import random
    import re

    from leadflow.functions.columns import PLAIN_NUMBER_RE, SPECIAL_NUMBER_RE

    rnd = random.Random(11)
    parts = ["", "+", "-", "1", "07", "12", ".", ".5", "e", "E", "e-", "3", "inf", "NaN", " ", ",", "x", "d", "_"]
    texts = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(400)})

    def rule(s):
        t = s.strip()
        if re.search(PLAIN_NUMBER_RE, t) or re.search(SPECIAL_NUMBER_RE, t):
            v = float(t)
            return 0.0 if v != v else v
        return 0.0
    got = dict(_one_col(spark, texts).select("v", LF.to_number("v").alias("n")).collect())
    bad = {t: (got[t], rule(t)) for t in texts if got[t] != rule(t)}
    assert not bad


def test_coerce_date_matches_python_rule_on_generated_texts(spark):
    """Texts written in many forms; the day is known from how each was made."""
    import random

    rnd = random.Random(5)
    want = {}

    def day(y, m, d):
        try:
            return dt.date(y, m, d)
        except ValueError:
            return None
    for _ in range(600):
        y, m, d = rnd.choice([1999, 2024, 2023]), rnd.randint(0, 13), rnd.randint(0, 32)
        clock = rnd.choice(["", " 10:11", "T10:11:12", " 10:11:12.5", " 9:05 PM", " 10:11am", "T10:11:12+01:00", " 10:11 UTC", "T23:59Z", " 10:11 -0500"])
        year_first = rnd.choice([f"{y}-{m:02d}-{d:02d}", f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{y}.{m:02d}.{d:02d}", f"{y}{m:02d}{d:02d}"])
        want[year_first + clock] = day(y, m, d)
        sep = rnd.choice("-/.")
        want[f"{m}{sep}{d:02d}{sep}{y}" + clock] = day(y, d, m) if m > 12 else day(y, m, d)
        want[f"{d}{sep}{m}{sep}{y}" + clock] = day(y, m, d) if d > 12 else day(y, d, m)
        if 1 <= m <= 12:
            name = dt.date(2000, m, 1).strftime(rnd.choice(["%b", "%B"]))
            name = rnd.choice([name, name.lower(), name.upper()])
            want[rnd.choice([f"{name} {d}, {y}", f"{name} {d} {y}", f"{d} {name} {y}", f"{d}-{name}-{y}", f"Fri, {d:02d} {name} {y}", f"{name}. {d}, {y}" if name != "May" else f"May {d} {y}"]) + clock] = day(y, m, d)
    want.update({"2024-01-05 25:00": None, "01/05/24": None, "2024-1/5": None, "Mai 5, 2024": None, "5 2024": None, "2024": None, "Sept 5th, 2024": dt.date(2024, 9, 5), "2024-01-05Z": dt.date(2024, 1, 5)})
    got = dict(_one_col(spark, list(want)).select("v", LF.coerce_date("v").alias("d")).collect())
    assert {t: (got[t], w) for t, w in want.items() if got[t] != w} == {}
