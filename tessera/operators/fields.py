"""Fields of heterogeneous rows that come as JSON objects: by priority, nested, flattened, as clean exports."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse, text


def first_of(row: Column, paths: Sequence[str]) -> Column:
    """The first non-empty value of the paths (a.b for nested ones), trimmed; the empty text without one."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(row, f"$.{p}")), F.lit("")) for p in paths), F.lit(""))


def all_of(row: Column, paths: Sequence[str]) -> Column:
    """The distinct non-empty values of the paths, in their order."""
    return F.array_distinct(F.filter(F.array(*(F.coalesce(F.trim(F.get_json_object(row, f"$.{p}")), F.lit("")) for p in paths)), lambda v: v != ""))


def nested(keys: Sequence[str], parents: Sequence[str]) -> list[str]:
    """The keys, then the same within each parent."""
    return [*keys, *(f"{p}.{k}" for p in parents for k in keys)]


def flattened(value: Column, preferred: Sequence[str] = ()) -> Column:
    """A JSON value as text: a list's or an object's distinct texts (of the preferred keys that it has, else of all), joined by blanks.

    Texts that differ in case and blanks only are one.
    """
    kept = F.trim(text(value))
    items = F.from_json(kept, "array<string>")
    entries = F.from_json(kept, "map<string,string>")
    own = F.filter(F.array(*(F.element_at(entries, F.lit(k)) for k in preferred)).cast("array<string>"), lambda v: F.trim(v) != "") if preferred else F.array().cast("array<string>")
    values = F.when(F.size(own) > 0, own).otherwise(F.map_values(entries))
    parts = F.filter(F.transform(F.when(kept.startswith("["), items).when(kept.startswith("{"), values), lambda v: F.trim(v)), lambda v: v != "")
    keys = F.transform(parts, lambda v: F.lower(collapse(v)))
    distinct = F.filter(parts, lambda v, i: F.array_position(keys, F.lower(collapse(v))) == i + 1)
    return F.when(parts.isNotNull(), F.array_join(distinct, " ")).otherwise(kept)


def split_pair(value: Column) -> Column:
    """order and family of ``order | family`` (or of a family alone)."""
    parts = F.transform(F.split(text(value), r"\|"), lambda p: F.trim(p))
    two = F.size(parts) > 1
    return F.struct(F.when(two, F.get(parts, F.lit(0))).otherwise("").alias("order"), F.when(two, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).alias("family"))


def search_text(row: dict[str, Column]) -> Column:
    """``column: value`` of the non-empty values, joined by bars."""
    return F.concat_ws(" | ", *(F.when(F.trim(text(v)) != "", F.concat(F.lit(f"{name}: "), v.cast("string"))) for name, v in row.items()))


def matched_fields(labels: dict[str, Column], tokens: Column) -> Column:
    """``label: value`` of the columns that hold one of the tokens, in their order."""
    return F.array_compact(F.array(*(F.when(F.exists(tokens, lambda w: F.contains(F.lower(text(v)), w)), F.concat(F.lit(f"{label}: "), collapse(v))) for label, v in labels.items())))


def listed(value: Column) -> Column:
    """A JSON list as it is, any other non-empty value as a list of one."""
    kept = F.trim(text(value))
    return F.when(kept.startswith("["), F.from_json(kept, "array<string>")).when(kept != "", F.array(kept)).otherwise(F.array().cast("array<string>"))


def exported(rows: DataFrame, payload: str, keep: Sequence[str], as_lists: Sequence[str] = ()) -> DataFrame:
    """Only the kept keys of a JSON column, those named as lists of texts."""
    return rows.select(*(listed(F.get_json_object(payload, f"$.{k}")).alias(k) if k in as_lists else F.get_json_object(payload, f"$.{k}").alias(k) for k in keep))
