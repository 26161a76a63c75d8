"""Parsing of answers and payloads that come as text."""

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import collapse, text, without_fence


def json_value(payload: Column, path: str) -> Column:
    """A value by path: of the payload, of what is within its fence, or of its outermost braces."""
    inner = F.regexp_extract(without_fence(payload), r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.get_json_object(F.when(F.try_parse_json(p).isNotNull(), p), path) for p in (text(payload), without_fence(payload), inner)))


def _balanced(values: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        start = (s or "").find("{")
        while start >= 0:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(s, start)[0], ensure_ascii=False)
            except ValueError:
                start = s.find("{", start + 1)
        return None

    return pd.Series([one(v) for v in values], dtype=object)


def balanced_object(c: Column) -> Column:
    """The first whole JSON object that a text holds."""
    return F.pandas_udf(_balanced, T.StringType())(c)


def choice(c: Column) -> Column:
    """A to E standing alone, else the first letter of the answer."""
    upper = F.upper(text(c))
    found = F.regexp_extract(upper, r"\b([A-E])\b", 1)
    return F.when(found != "", found).otherwise(F.substring(F.trim(upper), 1, 1))


def choices(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text(c)), F.lit(r"\b([A-E])\b"), F.lit(1))))


#: Marks that an answer loses; its lead-ins; signals of no, of yes and of a single form.
MARKS = r"[\[\](){}.,;:!?\"“”'`]+"
LEAD_INS = ("the answer is", "answer is", "it is", "it's", "its", "this is", "they are", "it was", "they were")
NEGATIVE = ("false", "no", "not", "no longer", "not currently", "distinct species", "separate species")
POSITIVE = ("true", "yes", "currently", "conspecific", "same species")
SINGLE_FORM = ("monotypic", "no recognized subspecies", "no subspecies", "no valid subspecies")


def plain(c: Column) -> Column:
    """Lower case, single blanks, without marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(c))), r"\s+", " "), MARKS, "")


def _hyphened(c: Column) -> Column:
    return F.regexp_replace(c, " to | – | — ", "-")


def short_answer(c: Column) -> Column:
    """plain, without a lead-in and units of time, ranges with a hyphen, meters as m."""
    out = _hyphened(F.regexp_replace(plain(c), f"^(?:{'|'.join(LEAD_INS)})\\s+", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"\b(?:days?|months?|years?)\b", ""), r"\bmeters?\b", "m")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _holds(c: Column, signals: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(s)) for s in signals))


def boolean(c: Column) -> Column:
    """Whether a short answer holds a signal of yes; those of no come first; null without either."""
    answer = short_answer(c)
    return F.when(_holds(answer, NEGATIVE), False).when(_holds(answer, POSITIVE), True)


def single_form(c: Column) -> Column:
    """Whether a short answer says that there are no further forms."""
    return _holds(short_answer(c), SINGLE_FORM)


def numbers(c: Column) -> Column:
    """Numbers and ranges of numbers as they are written, ranges with a hyphen."""
    return F.regexp_extract_all(_hyphened(F.lower(text(c))), F.lit(r"\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?"), F.lit(0))


def names(c: Column) -> Column:
    """Short answers of the parts between semicolons, commas, slashes, bars, line ends and the word and."""
    parts = F.split(F.regexp_replace(text(c), r"(?i)\band\b", ","), r"[;,/|\n]+")
    return F.filter(F.transform(parts, short_answer), lambda x: x != "")


def answer(c: Column) -> Column:
    """The answer of a JSON object, of a quoted pair, of a line that begins with its name, or the text; null if empty."""
    whole = F.trim(text(c))
    parsed = F.get_json_object(F.when(F.try_parse_json(whole).isNotNull() & whole.startswith("{"), whole), "$.answer")
    quoted = F.regexp_extract(whole, r'(?s)"answer"\s*:\s*"(.*?)"', 1)
    line = F.regexp_extract(whole, r"(?im)answer\s*[:=]\s*(.+)$", 1)
    return F.coalesce(F.trim(parsed), F.when(quoted != "", F.trim(quoted)), F.when(line != "", F.regexp_replace(F.trim(line), '^"+|"+$', "")), F.when(whole != "", whole))


def name(c: Column) -> Column:
    """For comparison: lower case, without a bullet or number in front, quotes, brackets and other marks."""
    out = F.regexp_replace(F.lower(collapse(c)), r"^[-*•]+", "")
    out = F.regexp_replace(F.trim(out), r"^[0-9]+[.)\-:]\s*", "")
    return collapse(F.regexp_replace(F.regexp_replace(out, "[\"'`“”‘’]+", ""), r"[^a-z0-9\s-]", " "))


def label(c: Column) -> Column:
    """Letters, digits, hyphens and single blanks, in lower case."""
    return F.lower(collapse(F.regexp_replace(text(c), "[^A-Za-z0-9\\- ]", " ")))


def scientific_names(c: Column) -> Column:
    """Distinct pairs of a capitalised and a lower-case word, as names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(r"\b([A-Z][a-z]+(?:-[a-z]+)?\s+[a-z][a-z-]+)\b"), F.lit(1)), name))


def percent(c: Column) -> Column:
    """A share in per cent with two digits (halves to the even digit), empty where there is none."""
    return F.when(c.isNull(), "").otherwise(F.format_string("%.2f", F.bround(c * 100, 2)))


def answer_list(c: Column) -> Column:
    """A JSON array, or values split at semicolons, commas or line ends; trimmed, non-empty, distinct."""
    parsed = F.from_json(without_fence(c), "array<string>")
    split = F.split(text(c), r"[;,\n]+")
    return F.array_distinct(F.filter(F.transform(F.coalesce(parsed, split), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:[-*]|\d+[.)])\s*", ""))), lambda x: x != ""))


def ranked_guesses(c: Column, most: int = 5) -> Column:
    """Up to so many guesses in order, numbers and bullets removed."""
    return F.slice(answer_list(F.regexp_replace(text(c), ",", "\n")), 1, most)


def order_and_family(c: Column) -> Column:
    get = lambda name: F.regexp_extract(text(c), rf"(?i){name}\s*[:=]?\s*\"?([A-Za-z]+)", 1)
    return F.struct(get("order").alias("order"), get("family").alias("family"))
