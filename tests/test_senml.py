import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions.senml import (
    envelope_records,
    parse_csv,
    parse_envelope,
    parse_pack,
    record,
    record_set,
    reject_unreadable,
    split_roles,
    to_pack,
    wrap_envelope,
)
from tideline.specs import FIT, GRID, SYS, TAXI

BASE = "149298F6D390FA640E80B41ED31199C5"
FIRST = {"bn": BASE, "n": "trip_time_in_secs", "u": "s", "v": "1440.0", "t": 1358116560}
SECOND = {"n": "pickup_datetime", "u": "s", "v": 1358116560.0, "t": 1358116560}


def packs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "pack string")


def taxi_pack(**changes):
    values = {f.name: ("x" if f.kind == "text" else 1.5) for f in TAXI.fields}
    values["pickup_datetime"] = "2013-01-14  00:36:00"
    values.update(changes)
    return json.dumps(
        [
            {"u": f.unit, "n": f.name, ("vs" if f.kind == "text" else "v"): values[f.name]}
            for f in TAXI.fields
            if values[f.name] is not None
        ]
    )


def test_single_record(spark):
    r = packs(spark, json.dumps(FIRST)).select(record(F.col("pack")).alias("r")).first()["r"]
    assert (r["bn"], r["n"], r["u"], r["value"]) == (BASE, "trip_time_in_secs", "s", 1440.0)
    assert r["time"].timestamp() == 1358116560


def test_empty_pack_gives_no_record(spark):
    assert record_set(packs(spark, "[]"), "pack").count() == 0


def test_base_name_is_inherited_and_copies_collapse(spark):
    rows = record_set(packs(spark, json.dumps([FIRST, SECOND, SECOND])), "pack").collect()
    assert len(rows) == 2
    assert {r["bn"] for r in rows} == {BASE}
    assert {r["v"] for r in rows} == {1440.0, 1358116560.0}
    assert {r["full_name"] for r in rows} == {BASE + "trip_time_in_secs", BASE + "pickup_datetime"}


def test_numbers_as_text_and_as_numbers(spark):
    text = '[{"n":  "id", "u": "double", "v": 19503.0}, {"n": "grid_measurement", "v": "0.14"}]'
    row = parse_pack(packs(spark, text), GRID).first()
    assert (row["id"], row["grid_measurement"], row["timestamp"]) == (19503.0, 0.14, None)


def test_both_text_keys(spark):
    for key in ("vs", "sv"):
        text = json.dumps([{"n": "source", key: "abc"}, {"n": "dust", "v": "53.88"}])
        row = parse_pack(packs(spark, text), SYS).first()
        assert (row["source"], row["dust"]) == ("abc", 53.88)


def test_unknown_names_are_ignored(spark):
    row = parse_pack(packs(spark, taxi_pack()[:-1] + ',{"n":"zzz","v":"1"}]'), TAXI).first()
    assert row["trip_distance"] == 1.5 and "zzz" not in row.asDict()


def test_duplicate_name_fails_in_a_pack(spark):
    text = '[{"n":"id","v":"1"},{"n":"id","v":"2"}]'
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        parse_pack(packs(spark, text), GRID).collect()


def test_last_name_wins_in_an_envelope(spark):
    text = '{"e":[{"n":"id","v":"1"},{"v":"7"},{"n":"id","v":"2"}],"bt":5,"bn":"base"}'
    rows = packs(spark, text).withColumnRenamed("pack", "envelope")
    row = parse_envelope(rows, ["id", "base", "none"]).first()
    assert (row["timestamp"], row["id"], row["base"], row["none"]) == ("5", "2", "7", None)
    long = envelope_records(rows).collect()
    assert [(r["n"], r["value"], r["t"]) for r in long] == [("id", "1", 5), ("base", "7", 5), ("id", "2", 5)]


def test_envelope_base_times(spark):
    rows = packs(spark, taxi_pack())
    wrapped = rows.select(wrap_envelope(TAXI, F.col("pack")).alias("envelope"))
    assert json.loads(wrapped.first()[0])["bt"] == 1358123760
    fit = packs(spark, "[]").select(wrap_envelope(FIT, F.col("pack"))).first()[0]
    assert json.loads(fit)["bt"] == "1358101800000"
    assert json.loads(packs(spark, "[]").select(wrap_envelope(SYS, F.col("pack"))).first()[0])["bt"] == 1358101800000


def test_roles(spark):
    rows = packs(spark, taxi_pack()).withColumn("envelope", wrap_envelope(TAXI, F.col("pack")))
    parsed = parse_envelope(rows.drop("pack"), [n for n in TAXI.schema_line if n != "timestamp"])
    row = split_roles(parsed, TAXI).first()
    assert row["meta"] == "2013-01-14  00:36:00,1358123760,1.5,1.5,1.5,1.5,x"
    assert row["obs"].split(",")[0] == "x" and len(row["obs"].split(",")) == 10
    assert TAXI.observed_fields[4] == "fare_amount" and SYS.observed_fields[4] == "airquality_raw"
    assert FIT.observed_fields[7] == "acc_ankle_z" and FIT.observed_fields[2] == "acc_chest_z"


def test_csv_message(spark):
    line = "t1,2013-01-14 03:57:00,2013-01-14 04:23:00,1560,19.36,-73.9,40.7,-73.7,40.6,CRD,52,0,0.5,13,4.8,70.3"
    row = parse_csv(spark.createDataFrame([(line,)], "line string"), TAXI).first()
    assert row["timestamp"] == "1358135820" and row["payment_type"] == "CRD"
    assert row["total_amount"] == "70.3" and row["hack_license"] == "t1"


def test_unreadable_text_is_set_apart(spark):
    good, bad = reject_unreadable(packs(spark, "[]", "[{", "nothing"))
    assert good.count() == 1 and bad.count() == 2


def test_null_values_keep_their_record(spark):
    row = spark.createDataFrame([(1.0, None, 3.0)], "id double, grid_measurement double, timestamp double")
    kept = json.loads(row.select(to_pack(GRID)).first()[0])
    assert kept[1] == {"u": "double", "n": "grid_measurement"}
    assert len(json.loads(row.select(to_pack(GRID, keep_null=False)).first()[0])) == 2
    assert json.loads(row.select(to_pack(GRID, quoted=False)).first()[0])[0]["v"] == 1.0


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc")), max_size=8)),
            *[st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False))] * 7,
        ),
        min_size=1,
        max_size=5,
    )
)
def test_write_and_parse_is_identity(spark, rows):
    schema = ", ".join(f"{f.name} {'string' if f.kind == 'text' else 'double'}" for f in SYS.fields)
    df = spark.createDataFrame(rows, schema)
    back = parse_pack(df.select(to_pack(SYS).alias("pack")), SYS)
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
