"""Dataset descriptions: everything an operator needs to know about a message kind.

Fixed values: field names, units, valid ranges, window sizes and label lists are
the ones the messages and the expected results are defined with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TEXT = "text"
NUMBER = "number"

BLOCK_SIZE = 5
REGRESSION_WINDOW = 10
HORIZON = 10
SERIES_SIZE = 10


@dataclass(frozen=True)
class Field:
    name: str
    unit: str
    kind: str = NUMBER


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    closed: bool = True


@dataclass(frozen=True)
class Dataset:
    name: str
    fields: tuple[Field, ...]
    id_field: str
    annotations: tuple[Field, ...] = ()
    ranges: dict[str, Range] = field(default_factory=dict)
    interpolated: tuple[str, ...] = ()
    average_field: str = ""
    distinct_field: str = ""
    kalman_field: str = ""
    # Role lists for scoring: schema order and the columns that only describe a row.
    schema_line: tuple[str, ...] = ()
    meta_fields: tuple[str, ...] = ()
    averaged_types: tuple[str, ...] = ()
    error_field: str = ""
    # Training: columns in order, the last one is the target.
    training_fields: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    # Values an annotation may take where no dimension table is given.
    choices: dict[str, tuple] = field(default_factory=dict)
    # Constant base time of an envelope, as it is written; None = from the pickup time.
    base_time: str | None = None

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def annotation_names(self) -> list[str]:
        return [f.name for f in self.annotations]

    @property
    def observed_fields(self) -> list[str]:
        return [c for c in self.schema_line if c not in self.meta_fields]


TAXI = Dataset(
    name="TAXI",
    fields=(
        Field("taxi_identifier", "string", TEXT),
        Field("hack_license", "string", TEXT),
        Field("pickup_datetime", "time", TEXT),
        Field("trip_time_in_secs", "s"),
        Field("trip_distance", "m"),
        Field("pickup_longitude", "deg"),
        Field("pickup_latitude", "deg"),
        Field("dropoff_longitude", "deg"),
        Field("dropoff_latitude", "deg"),
        Field("payment_type", "payment_type", TEXT),
        Field("fare_amount", "dollar"),
        Field("surcharge", "%"),
        Field("mta_tax", "%"),
        Field("tip_amount", "dollar"),
        Field("tolls_amount", "dollar"),
        Field("total_amount", "dollar"),
    ),
    id_field="taxi_identifier",
    annotations=(
        Field("taxi_company", "string", TEXT),
        Field("driver_name", "string", TEXT),
        Field("taxi_city", "string", TEXT),
    ),
    ranges={
        "trip_time_in_secs": Range(140.0, 3155.0, closed=False),
        "trip_distance": Range(1.37, 29.86, closed=False),
        "fare_amount": Range(6.0, 201.0, closed=False),
        "tip_amount": Range(0.65, 38.55, closed=False),
        "tolls_amount": Range(2.5, 18.0, closed=False),
    },
    interpolated=(
        "trip_time_in_secs", "trip_distance", "fare_amount", "tolls_amount", "total_amount",
    ),
    average_field="trip_distance",
    distinct_field="taxi_identifier",
    kalman_field="trip_distance",
    schema_line=(
        "taxi_identifier", "hack_license", "pickup_datetime", "timestamp",
        "trip_time_in_secs", "trip_distance", "pickup_longitude", "pickup_latitude",
        "dropoff_longitude", "dropoff_latitude", "payment_type", "fare_amount",
        "surcharge", "mta_tax", "tip_amount", "tolls_amount", "total_amount",
    ),
    meta_fields=(
        "pickup_datetime", "timestamp", "pickup_longitude", "pickup_latitude",
        "dropoff_longitude", "dropoff_latitude", "payment_type",
    ),
    averaged_types=(
        "trip_time_in_secs", "trip_distance", "fare_amount", "surcharge", "mta_tax",
        "tip_amount", "tolls_amount", "total_amount",
    ),
    error_field="fare_amount",
    training_fields=("trip_time_in_secs", "trip_distance", "fare_amount"),
    classes=("Bad", "Good", "VeryGood"),
    choices={
        "taxi_company": ("c2", "c3", "c4"),
        "driver_name": ("n2", "n3", "n4"),
        "taxi_city": ("cty2", "cty3", "cty4"),
    },
)

_AXES = ("x", "y", "z")


def _triple(name: str, unit: str) -> tuple[Field, ...]:
    return tuple(Field(f"{name}_{axis}", unit) for axis in _AXES)


_FIT_NUMBERS = (
    *_triple("acc_chest", "m/s2"),
    Field("ecg_lead_1", "mV"),
    Field("ecg_lead_2", "mV"),
    *_triple("acc_ankle", "m/s2"),
    *_triple("gyro_ankle", "deg/s"),
    *_triple("magnetometer_ankle", "tesla"),
    *_triple("acc_arm", "m/s2"),
    *_triple("gyro_arm", "deg/s"),
    *_triple("magnetometer_arm", "tesla"),
    Field("label", "number"),
)

FIT = Dataset(
    name="FIT",
    fields=(Field("subjectId", "string", TEXT), *_FIT_NUMBERS),
    id_field="subjectId",
    annotations=(Field("age", "number"), Field("name", "string", TEXT)),
    ranges={f"acc_ankle_{axis}": Range(-2.0, 30.0) for axis in _AXES},
    interpolated=tuple(f"acc_ankle_{axis}" for axis in _AXES),
    average_field="acc_ankle_x",
    distinct_field="subjectId",
    kalman_field="gyro_ankle_x",
    schema_line=("subjectId", "timestamp", *(f.name for f in _FIT_NUMBERS)),
    meta_fields=(
        "subjectId", "timestamp",
        *(f"{n}_{a}" for n in ("gyro_ankle", "magnetometer_ankle") for a in _AXES),
        *(f"{n}_{a}" for n in ("gyro_arm", "magnetometer_arm") for a in _AXES),
        "label",
    ),
    averaged_types=("acc_ankle_z",),
    error_field="acc_chest_z",
    training_fields=(
        *(f"acc_ankle_{a}" for a in _AXES),
        *(f"acc_arm_{a}" for a in _AXES),
        *(f"acc_chest_{a}" for a in _AXES),
        "ecg_lead_1",
    ),
    choices={"age": (2.0, 5.0, 60.0), "name": ("John", "Jane", "Hans")},
    base_time="1358101800000",
)

GRID = Dataset(
    name="GRID",
    fields=(Field("id", "double"), Field("grid_measurement", "double"), Field("timestamp", "s")),
    id_field="id",
    annotations=(
        Field("house_id", "string", TEXT),
        Field("ownerFullName", "string", TEXT),
    ),
    ranges={"grid_measurement": Range(0.08, 0.95)},
    interpolated=("grid_measurement",),
    average_field="grid_measurement",
    distinct_field="id",
    kalman_field="grid_measurement",
    schema_line=("id", "timestamp", "grid_measurement"),
    meta_fields=("id", "timestamp"),
    averaged_types=("grid_measurement",),
    error_field="grid_measurement",
    training_fields=("timestamp", "grid_measurement"),
    choices={
        "house_id": ("a", "b", "c"),
        "ownerFullName": ("John Doe", "Jane Doe", "Hans Zimmer"),
    },
    base_time="1358101800000",
)

SYS = Dataset(
    name="SYS",
    fields=(
        Field("source", "string", TEXT),
        Field("longitude", "lon"),
        Field("latitude", "lat"),
        Field("temperature", "far"),
        Field("humidity", "per"),
        Field("light", "per"),
        Field("dust", "per"),
        Field("airquality_raw", "per"),
    ),
    id_field="source",
    annotations=(Field("location", "string", TEXT), Field("brand", "string", TEXT)),
    ranges={
        "temperature": Range(-12.5, 43.1),
        "humidity": Range(10.7, 95.2),
        "light": Range(1345.0, 26282.0),
        "dust": Range(186.61, 5188.21),
        "airquality_raw": Range(17.0, 363.0),
    },
    interpolated=("temperature", "humidity", "light", "dust", "airquality_raw"),
    average_field="airquality_raw",
    distinct_field="source",
    kalman_field="airquality_raw",
    schema_line=(
        "timestamp", "source", "longitude", "latitude", "temperature", "humidity",
        "light", "dust", "airquality_raw",
    ),
    meta_fields=("timestamp", "source", "longitude", "latitude"),
    averaged_types=("airquality_raw",),
    error_field="airquality_raw",
    training_fields=("temperature", "humidity", "light", "dust", "airquality_raw"),
    classes=("Bad", "Average", "Good", "VeryGood", "Excellent"),
    base_time="1358101800000",
)

DATASETS = {d.name: d for d in (TAXI, FIT, GRID, SYS)}

# Labels from the lowest to the highest quarter of a training batch.
QUARTILE_LABELS = ("BAD", "GOOD", "VERYGOOD", "EXCELLENT")

# Column positions of a comma-separated message.
CSV_POSITIONS = {
    "TAXI": {
        "taxi_identifier": 0,
        "hack_license": 0,
        "pickup_datetime": 1,
        "dropoff_datetime": 2,
        "trip_time_in_secs": 3,
        "trip_distance": 4,
        "pickup_longitude": 5,
        "pickup_latitude": 6,
        "dropoff_longitude": 7,
        "dropoff_latitude": 8,
        "payment_type": 9,
        "fare_amount": 10,
        "surcharge": 11,
        "mta_tax": 12,
        "tip_amount": 13,
        "tolls_amount": 14,
        "total_amount": 15,
    },
    "FIT": {name: i for i, name in enumerate(FIT.field_names)},
}
