"""Constraint queries over trait tables: column resolution, a small query form, filters with counts, condition mining."""

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_names(names: Sequence[str], mark: str = "__") -> list[str]:
    """Repeated column names get a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = " ".join(str(n or "").split()) or "column"
        k = seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}{mark}{k}" if k else n)
    return out


def merged_header(upper: Sequence[str], lower: Sequence[str]) -> list[str]:
    """Two header rows as one: the upper cell goes on to the right until the next one."""
    out, last = [], ""
    for a, b in zip(upper, lower):
        last = str(a or "").strip() or last
        b = str(b or "").strip()
        out.append(" ".join(x for x in ((last if b != last else ""), b) if x))
    return unique_names(out)


def looks_like_header(names: Sequence[str], row: Sequence[str], markers: Sequence[str], unnamed: float = 0.25, least: int = 4) -> bool:
    """Whether the first data row is the real header: many unnamed columns, and enough known names in the row."""
    empty = sum(1 for n in names if not n or re.match(r"(?i)unnamed|_c\d+$", n))
    known = {str(x or "").strip().lower() for x in row}
    return empty >= unnamed * max(1, len(names)) and sum(m.lower() in known for m in markers) >= least


def resolve(columns: Sequence[str], wanted: Sequence[str], all_: bool = False) -> str | list[str] | None:
    """A column by exact name, then by letters and digits only, then as a part of the name."""
    plain = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    found = [c for w in wanted for c in columns if c == w]
    found += [c for w in wanted for c in columns if plain(c) == plain(w)]
    found += [c for w in wanted for c in columns if plain(w) and plain(w) in plain(c)]
    found = list(dict.fromkeys(found))
    return found if all_ else (found[0] if found else None)


@dataclass
class Constraints:
    """What a question asks of a table: values by column, any-of groups, flags, quantile bounds."""

    values: dict[str, list[str]] = field(default_factory=dict)
    any_of: list[tuple[list[str], list[str]]] = field(default_factory=list)
    flags: dict[str, bool] = field(default_factory=dict)
    quantiles: dict[str, tuple[str, float]] = field(default_factory=dict)  # column: (>= or <=, quantile)
    matched: dict[str, str] = field(default_factory=dict)

    def effective(self) -> bool:
        return bool(self.values or self.any_of or self.flags or self.quantiles)


#: Spellings of set and unset flags.
TRUE, FALSE = ("1", "1.0", "true", "yes", "y", "t"), ("0", "0.0", "false", "no", "n", "f", "")


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*TRUE)


def falsy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*FALSE)


def thresholds(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float]]:
    """Exact interpolated quantiles, all in one pass."""
    got = df.agg(*(F.percentile(F.col(c).try_cast("double"), F.array(*(F.lit(q) for q in qs))).alias(c) for c, qs in wanted.items())).first()
    return {c: list(got[c] or []) for c in wanted}


def predicates(df: DataFrame, ask: Constraints) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c, vs in ask.values.items():
        out[c] = F.lower(F.col(c)).isin(*(v.lower() for v in vs))
    for cs, vs in ask.any_of:
        out["|".join(cs)] = reduce(lambda a, b: a | b, [F.lower(F.col(c)).isin(*(v.lower() for v in vs)) for c in cs])
    for c, on in ask.flags.items():
        out[c] = truthy(F.col(c)) if on else falsy(F.col(c))
    bounds = thresholds(df, {c: [q] for c, (_, q) in ask.quantiles.items()}) if ask.quantiles else {}
    for c, (op, _) in ask.quantiles.items():
        x = F.col(c).try_cast("double")
        out[c] = x >= bounds[c][0] if op == ">=" else x <= bounds[c][0]
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def answer(df: DataFrame, ask: Constraints) -> DataFrame:
    """Rows that meet all constraints; nothing is asked: no rows."""
    if not ask.effective():
        return df.limit(0)
    return df.where(reduce(lambda a, b: a & b, predicates(df, ask).values()))


def selectivity(df: DataFrame, ask: Constraints) -> DataFrame:
    """How many rows each constraint alone, and all together, leave; one pass."""
    ps = predicates(df, ask)
    cols = [F.count_if(p).alias(k) for k, p in ps.items()] + [F.count_if(reduce(lambda a, b: a & b, ps.values())).alias("all")]
    wide = df.agg(*cols)
    return wide.unpivot([], wide.columns, "constraint", "rows")


def parse(question: str, vocabulary: dict[str, Sequence[str]], flags: dict[str, str], quantile_words: dict[str, tuple[str, str, float]]) -> Constraints:
    """Constraints of a question: known values of columns, flag words, and words for quantiles (word: column, operator, quantile).

    The question's own text is all that is read.
    """
    low, ask = f" {question.lower()} ", Constraints()
    for column, values in vocabulary.items():
        hit = [v for v in sorted(values, key=len, reverse=True) if re.search(rf"\b{re.escape(v.lower())}\b", low)]
        hit = [v for v in hit if not any(v != o and v.lower() in o.lower() for o in hit)]
        if hit:
            ask.values[column] = sorted(hit)
            ask.matched[column] = ", ".join(sorted(hit))
    for word, column in flags.items():
        if re.search(rf"\b(?:not|non)[ -]{re.escape(word)}\b", low):
            ask.flags[column] = False
        elif re.search(rf"\b{re.escape(word)}\b", low):
            ask.flags[column] = True
    for word, (column, op, q) in quantile_words.items():
        if re.search(rf"\b{re.escape(word)}\b", low):
            ask.quantiles[column] = (op, q)
    return ask


def vocabulary(df: DataFrame, columns: Sequence[str], most: int = 1000) -> dict[str, list[str]]:
    """Distinct values of categorical columns, at most so many each (more: not a categorical column)."""
    wide = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    keep = [c for c in columns if wide[c] <= most]
    if not keep:
        return {}
    got = df.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in keep)).first()
    return {c: list(got[c]) for c in keep}


def cooccurrence(df: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n").between(low, high))


def answer_sets(df: DataFrame, conditions: Sequence[str], name: str, low: int, high: int) -> DataFrame:
    """For each combination of values: the sorted distinct names, where there are low to high of them.

    Sizes are counted first, so a list is only collected where it is small enough to be kept.
    """
    distinct = df.select(*conditions, name).distinct()
    sizes = distinct.groupBy(*conditions).agg(F.count(name).alias("size")).where(F.col("size").between(low, high))
    return distinct.join(sizes, list(conditions)).groupBy(*conditions, "size").agg(F.array_sort(F.collect_set(name)).alias("names"))


def condition_lattice(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of all values and pairs of values, by grouping sets."""
    sets = [[c] for c in columns] + [[a, b] for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"))
