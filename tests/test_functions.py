"""Column builders: every label and status branch, casting rules, calendar edges."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalake import contracts
from stratalake.functions import casts, labels, payload, status
from stratalake.functions.calendar import date_attributes
from stratalake.params import BuildParams


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


# What the labels must be.
STATES = {
    "new": "تحت التأسيس",
    "established": "تحت الانشاء",
    "closed": "مغلق",
    "active": "منتج",
    "canceled": "ملغي",
}
# What the labels must be.
PROVIDERS = {
    "RCJY": "الهيئة الملكية للجبيل وينبع",
    "MOMRAH": "وزارة الشؤون البلدية والقروية والإسكان",
    "MODON": "الهيئة السعودية للمدن الصناعية ومناطق التقنية",
    "ECZA": "هيئة المدن والمناطق الإقتصادية الخاصة",
    "MEWA": "وزارة البيئة والمياه والزراعة",
    "GACA": "الهيئة العامة للطيران المدني",
    "MAWANI": "هيئة الموانئ السعودية",
    "UNIVERSITIES": "الجامعات",
    "MIM": "وزارة الصناعة والثروة المعدنية",
    "SAR": "المؤسسة العامة للخطوط الحديدية",
    "ARAMCO": "أرامكو السعودية",
    "NEOM": "نيوم",
    "SPARK": "مدينة الملك سلمان للطاقة",
    "OTHER": "اخرى",
}


@pytest.mark.parametrize(
    ("build", "table"),
    [(labels.state_label, STATES), (labels.provider_label, PROVIDERS)],
)
def test_every_label(spark, build, table):
    codes = [*table, "unheard-of", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    found = dict(df.select("code", build(F.col("code"))).collect())
    assert found == {**table, "unheard-of": None, None: None}


def test_labels_with_quotes(spark):
    odd = {"a'b": "x\\'y", "c\\": "ش"}
    df = spark.createDataFrame([(c,) for c in odd], "code string")
    assert dict(df.select("code", labels.label(F.col("code"), odd)).collect()) == odd


LICENSE = "deleted_at date, canceled_at date, suspended_at date, expires_at timestamp_ntz, issue_date date"
DAY = dt.date(2018, 1, 1)
TODAY = dt.date(2019, 6, 30)
PAST, FUTURE = dt.datetime(2019, 6, 29, 23, 59), dt.datetime(2019, 6, 30)


@pytest.mark.parametrize(
    ("row", "cycle", "state"),
    [
        ((DAY, DAY, DAY, FUTURE, DAY), "Deleted", "Active"),
        ((None, DAY, DAY, FUTURE, DAY), "Canceled", "Active"),
        ((None, None, DAY, PAST, DAY), "Suspended", "Expired"),
        ((None, None, None, PAST, DAY), "Expired", "Expired"),
        ((None, None, None, FUTURE, DAY), "Active", "Active"),
        ((None, None, None, FUTURE, None), "Unknown", "Active"),
        ((None, None, None, None, DAY), "Unknown", "Expired"),
        ((None, None, None, None, None), "Unknown", "Expired"),
        ((DAY, None, None, PAST, None), "Deleted", "Expired"),
        ((None, DAY, None, None, None), "Canceled", "Expired"),
        ((None, None, None, PAST, None), "Expired", "Expired"),
    ],
)
def test_license_rules(spark, row, cycle, state):
    df = spark.createDataFrame([row], LICENSE)
    today = BuildParams(as_of=TODAY).today()
    assert df.select(status.license_cycle(today), status.license_status(today)).first() == (
        cycle,
        state,
    )


def test_today_defaults_to_the_current_date(spark):
    one = spark.range(1)
    assert column(one, BuildParams().today()) == column(one, F.current_date())


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_blank_text_is_null(spark):
    df = texts(spark, "12", " 12 ", "", "   ", None)
    assert column(df, casts.blank_to_number(df, "x", "bigint")) == [12, 12, None, None, None]


def test_only_empty_text_is_null(spark):
    df = texts(spark, "12", " 12 ", "", None)
    assert column(df, casts.empty_to_number(df, "x", "bigint")) == [12, 12, None, None]


@pytest.mark.parametrize("text", ["12.0", "x"])
@pytest.mark.parametrize("rule", [casts.blank_to_number, casts.empty_to_number])
def test_bad_numbers_raise_or_become_null(spark, rule, text):
    df = texts(spark, text)
    with pytest.raises(PySparkException):
        df.select(rule(df, "x", "bigint")).collect()
    assert column(df, rule(df, "x", "bigint", strict=False)) == [None]


def test_spaces_fail_only_the_empty_rule(spark):
    df = texts(spark, "  ")
    with pytest.raises(PySparkException):
        df.select(casts.empty_to_number(df, "x", "bigint")).collect()
    assert column(df, casts.empty_to_number(df, "x", "bigint", strict=False)) == [None]


@pytest.mark.parametrize("rule", [casts.blank_to_number, casts.empty_to_number])
def test_numbers_landed_as_double(spark, rule):
    df = spark.createDataFrame([(12.0,), (None,)], "x double")
    assert column(df, rule(df, "x", "bigint")) == [12, None]


def test_promotion_touches_only_integers(spark):
    df = spark.createDataFrame([(2**53 + 1, 3, "a", True)], "i bigint, s int, t string, b boolean")
    promoted = casts.promote_integers(df)
    assert dict(promoted.dtypes) == {"i": "double", "s": "double", "t": "string", "b": "boolean"}
    assert promoted.first().i == 2.0**53  # why promotion is off by default
    assert df.first().i == 2**53 + 1


def test_timestamp_from_text(spark):
    df = texts(spark, "2024-02-29 10:00:01.5", "2024-02-29", None)
    got = column(df, casts.to_timestamp(df, "x"))
    assert got == [dt.datetime(2024, 2, 29, 10, 0, 1, 500000), dt.datetime(2024, 2, 29), None]


CALENDAR = {
    # date: (key, day, dow, short, long, week, year, week start, weekend)
    dt.date(2024, 12, 30): (20241230, 30, 1, "Mon", "Monday", 1, 2024, True, False),
    dt.date(2024, 2, 29): (20240229, 29, 4, "Thu", "Thursday", 9, 2024, False, False),
    dt.date(2023, 1, 1): (20230101, 1, 0, "Sun", "Sunday", 52, 2023, False, True),
    dt.date(2026, 5, 9): (20260509, 9, 6, "Sat", "Saturday", 19, 2026, False, True),
}


@pytest.mark.parametrize("day", CALENDAR)
def test_calendar_edges(spark, day):
    df = spark.createDataFrame([(day,)], "d date")
    row = df.select(*date_attributes(F.col("d"))).first()
    assert (
        row.date_key,
        row.day_of_month,
        row.day_of_week,
        row.day_name_short,
        row.day_name_long,
        row.week_of_year,
        row.year_num,
        row.is_week_start,
        row.is_weekend,
    ) == CALENDAR[day]


def test_month_names_are_not_padded(spark):
    df = spark.createDataFrame([(dt.date(2024, 5, 1),)], "d date")
    row = df.select(*date_attributes(F.col("d"))).first()
    assert (row.month_name_short, row.month_name_long, row.quarter, row.year_month) == (
        "May",
        "May",
        2,
        "2024-05",
    )


@pytest.mark.parametrize(
    ("body", "tabular"),
    [
        ('[{"a":1}]', True),
        (' [ {"a":2},3]', True),
        ('\n[\n  {"a": 1}\n]', True),
        ("[]", False),
        ("[1]", False),
        ('["{x"]', False),
        ('[[{"a":1}]]', False),
        ('{"k":1}', False),
        ("null", False),
        (None, False),
    ],
)
def test_shape_of_bodies(spark, body, tabular):
    df = spark.createDataFrame([(body,)], "body string")
    assert column(df, payload.is_tabular(F.col("body"))) == [tabular]


def test_meta_fields(spark):
    df = spark.createDataFrame([('{"AREA": "north", "X": 1}',), (None,), ("{}",)], "meta string")
    got = df.select(payload.extract_fields(F.col("meta"), {"AREA": "string", "Y": "double"}))
    assert [r[0] and tuple(r[0]) for r in got.collect()] == [("north", None), None, (None, None)]


def test_placeholders_have_declared_types(spark):
    df = spark.range(1).select(*casts.typed_nulls(contracts.LICENSE_META))
    assert dict(df.dtypes) == contracts.LICENSE_META
    assert set(df.first()) == {None}
