"""Predicates on questions, answers, names and chunks: what is left out, held back or flagged, and why."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import collapse, text, token_count

#: Names that are only an adjective; short names that mean something; uses of one piece of evidence that are too many.
ADJECTIVES = ("large", "small", "dark", "bright", "close")
SHORT_NAMES = ("lc", "nt", "vu", "en", "cr", "ew", "ex")
MOST_USES = 12


def noise(name: Column, uses: Column | None = None) -> Column:
    """What makes a name noise: an adjective alone, too short, a year, an author; evidence that is used too often."""
    low = F.lower(F.trim(text(name)))
    rules = [
        (low.isin(*ADJECTIVES), "adjective_or_ui_junk"), ((F.length(low) > 0) & (F.length(low) < 3) & ~low.isin(*SHORT_NAMES), "too_short"),
        (low.rlike(r"\b\d{4}\b"), "citation_like_year"), (low.rlike(r"\bet al\.?\b"), "author_reference"),
    ]
    if uses is not None:
        rules.append((F.coalesce(uses, F.lit(0)) > MOST_USES, "evidence_reused_too_many_times"))
    return F.array_compact(F.array(*(F.when(holds, reason) for holds, reason in rules)))


def invalid_answer(answer: Column, placeholders: Sequence[str], least: int = 20) -> Column:
    """Why an answer isn't scored: a placeholder, or fewer tokens than so many; the empty text if it is."""
    kept = F.trim(text(answer))
    held = F.lower(kept).isin(*placeholders) | (kept == "")
    return F.when(held, "empty_or_placeholder_answer").when(token_count(kept) < least, f"too_short_under_{least}_tokens").otherwise("")


def needs_constraint(question: Column, constraint: Column) -> Column:
    """Whether a non-empty constraint isn't part of its question already, whatever the case and blanks."""
    wanted = F.lower(collapse(constraint))
    return (wanted != "") & ~F.contains(F.lower(collapse(question)), wanted)


def with_constraint(question: Column, constraint: Column, lead: str) -> Column:
    return F.when(needs_constraint(question, constraint), F.concat(question, F.lit(f"\n\n{lead}: "), constraint)).otherwise(question)


def sensitive(dataset: Column, kind: Column, datasets: Sequence[str], kinds: dict[str, Sequence[str]]) -> Column:
    """Whether a question gives its target away: of some data sets all, of others some kinds."""
    out = dataset.isin(*datasets) if datasets else F.lit(False)
    for name, some in kinds.items():
        out = out | ((dataset == name) & kind.isin(*some))
    return F.coalesce(out, F.lit(False))


def of_kinds(rows: DataFrame, kind: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of the included kinds (all if none is named) that aren't excluded, whatever the case."""
    low = F.lower(F.trim(text(F.col(kind))))
    out = rows.where(low.isin(*(k.lower() for k in include))) if include else rows
    return out.where(~low.isin(*(k.lower() for k in exclude))) if exclude else out


def at_cap(chunks: DataFrame, claims: DataFrame, chunk: str, cap: str) -> DataFrame:
    """Chunks with as many claims as their cap, or more; claims counted by chunk."""
    n = claims.groupBy(chunk).agg(F.count("*").alias("n_claims"))
    return chunks.join(n, chunk).where((F.col(cap) > 0) & (F.col("n_claims") >= F.col(cap)))


def exclusions(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """reason, n: rows by the first rule that excludes them, ``selected`` without one."""
    reason = F.when(F.lit(False), "")
    for name, holds in rules.items():
        reason = reason.when(holds, name)
    return rows.groupBy(reason.otherwise("selected").alias("reason")).agg(F.count("*").alias("n"))


def supported_kinds(body: Column, rules: dict[str, Sequence[str]]) -> Column:
    """The kinds of questions that a text can answer: one of a kind's terms is in it; a kind without terms always can."""
    low = F.lower(text(body))
    held = lambda terms: F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(low, t)) if terms else F.lit(True)
    return F.array_compact(F.array(*(F.when(held(terms), F.lit(kind)) for kind, terms in rules.items())))


def round_robin(rows: DataFrame, group: Sequence[str], order: Sequence[str], kinds: Sequence[str], supported: Column) -> DataFrame:
    """rows with a kind: within a group the kinds take turns by a row's place; one that the row doesn't support passes it on.

    Places, not a running state, decide, so tasks need nothing of each other.  A row that supports none takes the
    kind whose turn it is.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    turn = F.transform(F.sequence(F.lit(0), F.lit(len(kinds) - 1)), lambda i: F.element_at(F.array(*(F.lit(k) for k in kinds)), ((F.col("_place") + i) % len(kinds) + 1).cast("int")))
    return rows.withColumn("_place", place).withColumn("kind", F.coalesce(F.get(F.filter(turn, lambda k: F.array_contains(supported, k)), F.lit(0)), F.get(turn, F.lit(0)))).drop("_place")


def limited(parts: dict[str, tuple[DataFrame, int]], order: Sequence[Column]) -> dict[str, DataFrame]:
    """Each source's first rows: none for 0, all for less than 0."""
    return {name: df.limit(0) if n == 0 else df if n < 0 else df.orderBy(*order).limit(n) for name, (df, n) in parts.items()}
