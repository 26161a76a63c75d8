"""Names of taxa as keys: ranks, lookup keys by kind, record names, codes in parentheses, states of protection."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import code, collapse, external_id, family_name, scientific_name, text

#: Spellings of ranks that become another.
RANKS = {"ssp": "subspecies"}

#: Codes of protection and what they stand for; the names stand for themselves.
STATUSES = {
    "LC": "Least Concern",
    "NT": "Near Threatened",
    "VU": "Vulnerable",
    "EN": "Endangered",
    "CR": "Critically Endangered",
    "EW": "Extinct in the Wild",
    "EX": "Extinct",
    "DD": "Data Deficient",
    "NE": "Not Evaluated",
}
UNKNOWN_STATUS = "NE"


def _mapped(c: Column, values: dict[str, str]) -> Column:
    out = c
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def rank(c: Column | str) -> Column:
    return _mapped(F.lower(collapse(c)), RANKS)


def record_name(c: Column | str) -> Column:
    """Without the heading that pages put behind a name."""
    return F.regexp_replace(collapse(c), r"(?i)\s+Scientific name definitions$", "")


def lookup_key(c: Column | str, kind: str) -> Column:
    """The key under which names of a kind are found; other kinds: the collapsed text in lower case."""
    if kind == "external_id":
        return external_id(c, "avibase")
    if kind == "species_code":
        return code(c)
    if kind in ("scientific_name", "species_name", "english_name", "order_name"):
        return F.lower(scientific_name(c))
    return F.lower(family_name(c) if kind == "family_name" else collapse(c))


def table_name(c: Column | str) -> Column:
    """Letters, digits, hyphens and spaces of a name in a table, in lower case."""
    return F.lower(F.trim(F.regexp_replace(collapse(c), "[^A-Za-z0-9 -]+", " ")))


def bracketed_codes(c: Column | str) -> Column:
    """Capital codes within parentheses, parted by commas: distinct, in order."""
    groups = F.regexp_extract_all(text(c), F.lit(r"\(([A-Z, ]{1,20})\)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.split(F.array_join(groups, ","), ","), lambda x: F.upper(collapse(x))), lambda x: x != ""))


def status(c: Column | str) -> Column:
    """The name of a code of protection in any case; null and empty: not evaluated; other values as they are."""
    plain = F.coalesce(F.nullif(F.trim(text(c)), F.lit("")), F.lit(UNKNOWN_STATUS))
    named = _mapped(F.upper(plain), STATUSES)
    return F.when(F.upper(plain).isin(*STATUSES), named).otherwise(plain)
