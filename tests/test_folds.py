from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pixelchron.plans.folds import cyclic, join_folds, make_folds, parse_days, parse_ranges

Y = (2020, 2021)


def keys(**kw):
    return [f.key for f in make_folds(Y, **kw)]


@pytest.mark.parametrize(
    ("custom", "year", "month", "n", "first"),
    [
        ({}, False, False, 1, "Y2020-2021_M01-12_D001-366"),
        ({}, True, False, 2, "Y2020-2020_M01-12_D001-366"),
        ({}, False, True, 12, "Y2020-2021_M01-01_D001-366"),
        ({}, True, True, 24, "Y2020-2020_M01-01_D001-366"),
        ({"month": ["1-6", "7-12"]}, True, False, 4, "Y2020-2020_M01-06_D001-366"),
        ({"month": ["1-6"]}, False, False, 1, "Y2020-2021_M01-06_D001-366"),
        ({"month": ["12-2"]}, False, True, 3, "Y2020-2021_M12-12_D001-366"),
        ({"month": ["12-2"]}, True, True, 6, "Y2020-2020_M12-12_D001-366"),
        ({"year": ["2020+-0", "2021-2021"]}, False, False, 2, "Y2020-2020_M01-12_D001-366"),
        ({"year": ["2020-2021"]}, True, False, 2, "Y2020-2020_M01-12_D001-366"),
        ({"year": ["2020-2021"], "month": ["3-5"]}, False, False, 1, "Y2020-2021_M03-05_D001-366"),
        ({"year": ["2020-2021"], "month": ["3-5"]}, False, True, 1, "Y2020-2021_M03-05_D001-366"),
        ({"year": ["2020-2021"], "month": ["3-5"]}, True, True, 6, "Y2020-2020_M03-03_D001-366"),
        ({"doy": ["192+-30"]}, False, False, 1, "Y2020-2021_M01-12_D162-222"),
        ({"doy": ["350+-30"]}, True, False, 2, "Y2020-2020_M01-12_D320-014"),
        ({"year": ["2020-2021"], "doy": ["10-20"]}, False, False, 1, "Y2020-2021_M01-12_D010-020"),
        ({"year": ["2020-2021"], "doy": ["10-20"]}, True, False, 2, "Y2020-2020_M01-12_D010-020"),
        ({"date": ["20200301-20200401"]}, True, True, 1, "Y2020-2020_M00-00_D061-092"),
    ],
)
def test_branches(custom, year, month, n, first):
    got = keys(custom=custom, fold_year=year, fold_month=month)
    assert len(got) == n and got[0] == first


def test_conflicts_and_bounds():
    for bad in ({"month": ["3-5"], "doy": ["10-20"]}, {"year": ["2019-2020"]}, {"month": ["3-13"]}, {"date": ["20190101-20200101"]}):
        with pytest.raises(ValueError):
            keys(custom=bad)
    with pytest.raises(ValueError):
        keys(custom={"doy": ["10-20"]}, fold_month=True)


def test_grammar():
    assert parse_ranges(["350+-30"], 366) == [(320, 14)]
    assert parse_ranges(["1996+-1"]) == [(1995, 1997)]
    assert parse_days(["20200228+-2"]) == [(date(2020, 2, 26), date(2020, 3, 1))]
    assert cyclic(12, 2, 12) == (12, 1, 2)


def test_dates_of_interest_give_one_fold():
    (f,) = make_folds(Y, dates=(20200115, 20210301))
    assert f.date == (date(2020, 1, 15), date(2021, 3, 1)) and f.holds(date(2021, 2, 28)) and not f.holds(date(2021, 3, 1))


@given(st.integers(1, 12), st.integers(1, 12), st.dates(date(2020, 1, 1), date(2021, 12, 31)))
def test_single_months_cover_the_range_once(low, high, day):
    folds = make_folds(Y, fold_month=True, custom={"month": [f"{low}-{high}"]})
    assert sum(f.holds(day) for f in folds) == (day.month in cyclic(low, high, 12))


def test_join_keeps_an_observation_for_each_fold(spark):
    df = spark.createDataFrame([(1, "2020-01-15 10:00:00"), (2, "2020-07-01 00:00:00"), (3, "2022-01-15 00:00:00")], "i int, ts string").selectExpr("i", "cast(ts as timestamp) ts")
    got = join_folds(df, make_folds(Y, custom={"month": ["12-2", "1-6"]}))
    assert sorted((r["i"], r["fold_key"].split("_")[1]) for r in got.collect()) == [(1, "M01-06"), (1, "M12-02")]
