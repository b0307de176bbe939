"""SenML records, packs and envelopes as column expressions.

A record keeps ``v`` as text, because it arrives as ``"0.14"`` or as ``0.14``; text
values come as ``vs`` or ``sv``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.specs import CSV_POSITIONS, NUMBER, TEXT, Dataset, Field

RECORD = "struct<bn:string,n:string,u:string,v:string,vs:string,sv:string,t:bigint>"
PACK = f"array<{RECORD}>"
# What a wide row needs of a record; the JSON reader skips the rest.
VALUES = "array<struct<n:string,v:string,vs:string,sv:string>>"
ENVELOPE = f"struct<e:{PACK},bt:string,bn:string,bu:string>"


def with_parsed(df: DataFrame, text: str, schema: str, out: str = "__parsed") -> DataFrame:
    """Replace a JSON column by its parsed form, as a step of its own.

    A parsed column that later expressions use many times must be a column: written
    inline, and above all inside a lambda, it would be parsed again for every use.
    """
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.from_json(F.col(text), schema).alias(out))


def record(text: Column) -> Column:
    """One record object -> struct with ``value`` (double), ``text`` and ``time``."""
    r = F.from_json(text, RECORD)
    return F.struct(
        r["bn"].alias("bn"),
        r["n"].alias("n"),
        r["u"].alias("u"),
        r["v"].try_cast("double").alias("value"),
        F.coalesce(r["vs"], r["sv"]).alias("text"),
        F.timestamp_seconds(r["t"]).alias("time"),
    )


def full_name(base: Column, name: Column) -> Column:
    return F.concat(F.coalesce(base, F.lit("")), name)


def record_set(df: DataFrame, pack: str) -> DataFrame:
    """One output row per different record of a pack, keeping the other columns."""
    others = [c for c in df.columns if c != pack]
    based = with_parsed(df, pack, PACK).withColumn("__base", F.get("__parsed", 0)["bn"])
    full = F.transform(
        "__parsed",
        lambda r: F.struct(
            F.coalesce(r["bn"], F.col("__base")).alias("bn"),
            r["n"].alias("n"),
            r["u"].alias("u"),
            r["v"].alias("v"),
            F.coalesce(r["vs"], r["sv"]).alias("vs"),
            r["t"].alias("t"),
        ),
    )
    # Outer and not-null instead of plain explode, for which the optimizer would add a
    # filter on the size of the array and build it twice.
    exploded = based.select(*others, F.explode_outer(F.array_distinct(full)).alias("r"))
    exploded = exploded.filter(F.col("r").isNotNull())
    return exploded.select(
        *others,
        F.col("r.bn").alias("bn"),
        F.col("r.n").alias("n"),
        F.col("r.u").alias("u"),
        F.col("r.v").try_cast("double").alias("v"),
        F.col("r.vs").alias("vs"),
        F.col("r.t").alias("t"),
        full_name(F.col("r.bn"), F.col("r.n")).alias("full_name"),
    )


def _typed(r: Column, f: Field) -> Column:
    value = r["vs"] if f.kind == TEXT else r["v"].try_cast("double")
    return value.alias(f.name)


def parse_pack(df: DataFrame, spec: Dataset, pack: str = "pack", annotated: bool = False) -> DataFrame:
    """Pack text -> one wide row. A missing field is null, an unknown one is ignored.

    A name given twice in a pack fails the query (the map does not admit it).
    """
    others = [c for c in df.columns if c != pack]
    fields = spec.fields + (spec.annotations if annotated else ())
    named = F.transform(
        "__parsed",
        lambda r: F.struct(
            r["n"], F.struct(r["v"].alias("v"), F.coalesce(r["vs"], r["sv"]).alias("vs"))
        ),
    )
    by_name = with_parsed(df, pack, VALUES).select(
        *others, F.map_from_entries(named).alias("__records")
    )
    row = F.struct(*[_typed(F.col("__records")[f.name], f) for f in fields])
    return by_name.select(*others, _as_row(row)).select(
        *others, *[F.col(f"__row.{f.name}").alias(f.name) for f in fields]
    )


def _as_row(row: Column) -> Column:
    """The struct as the only row of a generator.

    Filters and join keys on parsed columns stay above a generator; through a plain
    projection they would be pushed down and every message parsed once more for them.
    The outer form keeps the optimizer from adding such a filter itself.
    """
    return F.explode_outer(F.array(row)).alias("__row")


def reject_unreadable(df: DataFrame, pack: str = "pack") -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable) messages: unreadable is text that is no JSON array."""
    bad = F.from_json(F.col(pack), PACK).isNull()
    return df.filter(~bad), df.filter(bad)


def _record_of(f: Field, keep_null: bool, quoted: bool) -> Column:
    """Record struct of one wide column. to_json leaves the unused value key out."""
    value = F.col(f.name).cast("string")
    none = F.lit(None).cast("string")
    number = value if f.kind == NUMBER else none
    built = F.struct(
        F.lit(f.unit).alias("u"),
        F.lit(f.name).alias("n"),
        (number if quoted else number.cast("double")).alias("v"),
        (value if f.kind == TEXT else none).alias("vs"),
    )
    return built if keep_null else F.when(value.isNotNull(), built)


def to_pack(
    spec: Dataset, annotated: bool = False, keep_null: bool = True, quoted: bool = True
) -> Column:
    """Wide row -> pack text, fields in fixed order, numbers as JSON strings if ``quoted``.

    A null value leaves a record with name and unit only, or with
    ``keep_null=False`` no record.
    """
    fields = spec.fields + (spec.annotations if annotated else ())
    built = F.array(*[_record_of(f, keep_null, quoted) for f in fields])
    return F.to_json(built if keep_null else F.array_compact(built))


def base_time(spec: Dataset, pack: Column) -> Column:
    """Envelope base time as text: pickup time in epoch seconds (0 when there is none to read), or the fixed value."""
    if spec.base_time is not None:
        return F.lit(spec.base_time)
    pickup = F.get(F.filter(F.from_json(pack, VALUES), lambda r: r["n"] == "pickup_datetime"), F.lit(0))
    return F.coalesce(epoch_seconds(F.coalesce(pickup["vs"], pickup["sv"])).cast("string"), F.lit("0"))


def epoch_seconds(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` -> epoch seconds; extra blanks between the parts allowed, other text is null."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss")))


def wrap_envelope(spec: Dataset, pack: Column) -> Column:
    """Pack text -> ``{"e": […], "bt": …}`` text. FIT writes the base time as text."""
    quote = F.lit('"' if spec.name == "FIT" else "")
    return F.concat(
        F.lit('{"e":'), pack, F.lit(',"bt":'), quote, base_time(spec, pack), quote, F.lit("}")
    )


def envelope_records(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """One row per envelope record: n, u, value, t with base name, unit and time filled in."""
    others = [c for c in df.columns if c != envelope]
    exploded = with_parsed(df, envelope, ENVELOPE).select(
        *others, _base_time("__parsed"), "__parsed.bn", "__parsed.bu", F.explode("__parsed.e").alias("r")
    )
    return exploded.select(
        *others,
        F.coalesce("r.n", "bn").alias("n"),
        F.coalesce("r.u", "bu").alias("u"),
        F.coalesce("r.v", "r.vs", "r.sv").alias("value"),
        (F.coalesce("r.t", F.lit(0)) + F.col("timestamp")).alias("t"),
    )


def _base_time(parsed: str) -> Column:
    given = F.col(f"{parsed}.bt").try_cast("bigint")
    return F.coalesce(given, F.lit(0)).alias("timestamp")


def parse_envelope(df: DataFrame, names: Iterable[str], envelope: str = "envelope") -> DataFrame:
    """Envelope text -> one text column per name plus ``timestamp`` (the base time).

    Of several records with one name the last counts: names and values are turned
    round, and the first position of a name is looked up.
    """
    others = [c for c in df.columns if c != envelope]
    schema = f"struct<e:{VALUES},bt:string,bn:string>"
    parsed = with_parsed(df, envelope, schema).withColumn("__bn", F.col("__parsed.bn"))
    turned = parsed.select(
        *others,
        _base_time("__parsed").cast("string").alias("timestamp"),
        F.reverse(F.transform("__parsed.e", lambda r: F.coalesce(r["n"], F.col("__bn")))).alias("__n"),
        F.reverse(
            F.transform("__parsed.e", lambda r: F.coalesce(r["v"], r["vs"], r["sv"]))
        ).alias("__v"),
    )

    def last(name: str) -> Column:
        place = F.array_position("__n", name).cast("int") - 1
        return F.get("__v", place).alias(name)

    names = [n for n in names if n != "timestamp"]
    row = F.struct(*[last(n) for n in names])
    return turned.select(*others, "timestamp", _as_row(row)).select(
        *others, "timestamp", *[F.col(f"__row.{n}").alias(n) for n in names]
    )


def parse_csv(df: DataFrame, spec: Dataset, line: str = "line") -> DataFrame:
    """Comma-separated message -> one text column per field plus ``timestamp``."""
    others = [c for c in df.columns if c != line]
    positions = CSV_POSITIONS[spec.name]
    parts = F.split(F.col(line), ",")
    stamp = epoch_seconds(F.get(parts, positions["pickup_datetime"])) if spec.name == "TAXI" else F.lit(0)
    return df.select(
        *others,
        stamp.cast("string").alias("timestamp"),
        *[F.get(parts, i).alias(name) for name, i in positions.items()],
    )


def joined(columns: Iterable[str]) -> Column:
    """Columns joined by commas, a missing value printed as ``null``."""
    return F.concat_ws(
        ",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    )


def split_roles(df: DataFrame, spec: Dataset) -> DataFrame:
    """Add ``sensor_id``, ``meta`` and ``obs`` (comma-joined) to a parsed message."""
    return df.withColumns(
        {
            "sensor_id": F.col(spec.id_field).cast("string"),
            "meta": joined(spec.meta_fields),
            "obs": joined(spec.observed_fields),
        }
    )
