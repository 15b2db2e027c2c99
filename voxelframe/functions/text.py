"""Small text and number functions of manifests and inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def strip_nifti(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.nii(\.gz)?$", "")


def channel_pattern(stem: Column) -> Column:
    """Whether a stem ends in a four-digit channel below 1000."""
    return stem.rlike(r"^.+_0[0-9]{3}$")


def case_id(stem: Column) -> Column:
    return F.when(channel_pattern(stem), F.regexp_extract(stem, r"^(.+)_(0[0-9]{3})$", 1)).otherwise(stem)


def channel_index(stem: Column) -> Column:
    return F.when(channel_pattern(stem), F.regexp_extract(stem, r"^(.+)_(0[0-9]{3})$", 2).cast("int"))


def patient_from_name(name: Column) -> Column:
    """What stands before the first underscore; all of it if that is empty."""
    return F.coalesce(F.nullif(F.substring_index(name, "_", 1), F.lit("")), name)


def safe_component(text: Column) -> Column:
    return F.coalesce(F.nullif(F.translate(text, "/\\: ", "____"), F.lit("")), F.lit("unknown"))


def split_labels(text: Column, mark: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def multi_values(text: Column) -> Column:
    """Values of a multi-valued element, parted by backslashes."""
    return F.transform(F.split(text, r"\\"), lambda x: F.trim(x))


def first_number(text: Column) -> Column:
    return F.try_element_at(multi_values(text), F.lit(1)).try_cast("float")


def two_numbers(text: Column) -> Column:
    numbers = F.transform(multi_values(text), lambda x: x.try_cast("float"))
    return F.when((F.size(numbers) >= 2) & F.get(numbers, F.lit(0)).isNotNull() & F.get(numbers, F.lit(1)).isNotNull(), F.slice(numbers, 1, 2))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is above zero."""
    return F.when(b > 0, a / b)


def finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def is_frontal(view: Column) -> Column:
    return F.coalesce(F.upper(view).isin("PA", "AP"), F.lit(False))


def json_number(text: Column, *path: str) -> Column:
    return F.get_json_object(text, "$." + ".".join(path)).try_cast("double")


def flat_index(x: Column, y: Column, z: Column, shape: Sequence[int]) -> Column:
    return x + F.lit(shape[0]) * (y + F.lit(shape[1]) * z)


def from_flat(index: Column, shape: Sequence[int]) -> list[Column]:
    sx, sy = shape[0], shape[1]
    return [(index % sx).cast("int"), (F.floor(index / sx) % sy).cast("int"), F.floor(index / (sx * sy)).cast("int")]


def clamp_start(centre: Column, patch: int, size: int) -> Column:
    return F.least(F.greatest(centre - F.lit(patch // 2), F.lit(0)), F.lit(size - patch))
