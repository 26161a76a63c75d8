"""Records of checklists, chunks and questions in one form each: projections, scopes, kinds, representative relations."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import names
from tessera.functions.text import code, collapse, external_id, family_name, genus, scientific_name, text, without_marks

#: Columns of the two checklists: name, column of the sheet, kind of value.
CHECKLIST_A = (
    ("rank", "Taxon_rank", "rank"),
    ("order_name", "Order", "name"),
    ("family_name", "Family", "family"),
    ("family_english_name", "Family_English_name", "name"),
    ("scientific_name", "Scientific_name", "name"),
    ("english_name_primary", "English_name_AviList", "name"),
    ("english_name_clements_v2024", "English_name_Clements_v2024", "name"),
    ("proposal_number", "Proposal_number", "text"),
    ("decision_summary", "Decision_summary", "text"),
    ("range_text", "Range", "text"),
    ("iucn_status", "IUCN_Red_List_Category", "text"),
    ("cornell_species_code", "Species_code_Cornell_Lab", "code"),
    ("bow_url", "Birds_of_the_World_URL", "text"),
    ("avibase_id", "AvibaseID", "id"),
)
CHECKLIST_B = (
    ("rank", "category", "rank"),
    ("species_code", "species_code", "code"),
    ("external_id", "taxon concept ID", "id"),
    ("change_note", "Clements v2025 change", "text"),
    ("website_note", "text for website v2025", "text"),
    ("english_name", "English name", "name"),
    ("scientific_name", "scientific name", "name"),
    ("range_text", "range", "text"),
    ("order_name", "order", "name"),
    ("family_name", "family", "family"),
)
#: Columns of which a row of the second checklist needs one.
MEANINGFUL_B = ("rank", "species_code", "external_id", "scientific_name", "english_name", "family_name", "order_name")
#: Chapters of families by their spellings in lower case.
FAMILY_CHAPTERS = {
    "Introduction": ("introduction", "overview"),
    "Systematics": ("systematics", "systematicas history", "systematics history", "systematicshistory"),
    "Morphology": ("morphology", "structure", "identification"),
    "Habitat": ("general habitat", "habitat"),
    "Movement": ("movement", "migration", "movements and migration"),
    "DietAndForaging": ("diet and foraging", "dietandforaging", "diet & foraging", "diet"),
    "Voice": ("voice", "vocal behavior", "sound", "sounds"),
    "Breeding": ("breeding", "reproduction"),
    "Conservation": ("conservation", "conservation status", "conservationstatus"),
    "HumanRelations": ("human relations", "relationships with people"),
    "Other": ("other",),
}
UNKNOWN = "Unknown"
#: Source of family chunks, relations of each kind to show, and how many at least in all.
FAMILY_SOURCE = "BOW_FAMILY"
BUDGETS, LEAST_RELATIONS = {"exact": 3, "alias": 3, "conflict": 2}, 5


def _value(c: Column, kind: str) -> Column:
    as_ = {"rank": names.rank, "name": scientific_name, "family": family_name, "code": code, "id": lambda x: external_id(x, "avibase"), "text": lambda x: F.trim(text(x))}
    return as_[kind](c.cast("string"))


def checklist(sheet: DataFrame, columns: Sequence[tuple[str, str, str]], source: str, release: str, meaningful: Sequence[str] = ()) -> DataFrame:
    """A checklist's rows in one form, with their genus; raises where columns lack.  Rows without any meaningful value go."""
    lack = sorted(c for _, c, _ in columns if c not in sheet.columns)
    if lack:
        raise ValueError(f"columns are missing: {', '.join(lack)}")
    rows = sheet.select(F.lit(source).alias("source"), F.lit(release).alias("release"), *(_value(F.col(f"`{c}`"), kind).alias(name) for name, c, kind in columns))
    rows = rows.withColumn("genus_name", genus("scientific_name"))
    return rows.where(F.concat(*meaningful) != "") if meaningful else rows


def _first(*cs: Column, otherwise: str = "") -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(otherwise))


def chunk_metadata(links: DataFrame, chunks: DataFrame, rank: str, source: str, release: str) -> DataFrame:
    """What is kept with claims of each linked chunk; the link's own values go before the chunk's, by the rank of the subject."""
    a, b = links.alias("a"), chunks.alias("b")
    a_, b_ = (lambda n: F.col(f"a.{n}") if n in links.columns else F.lit(None).cast("string")), (lambda n: F.col(f"b.{n}") if n in chunks.columns else F.lit(None).cast("string"))
    species = rank == "species"
    taxon = a_("canonical_taxon_id" if species else "canonical_family_id")
    scientific = _first(a_("canonical_scientific_name"), a_("species_name"), b_("species_name")) if species else _first(a_("canonical_family_name"), a_("family_name"), b_("family_name"))
    common = _first(a_("common_name"), b_("common_name")) if species else _first(b_("common_name"))
    return a.join(b, "chunk_id", "left").select(
        F.lit(source).alias("source_db"), F.lit(release).alias("source_release"), F.col("chunk_id").alias("source_chunk_id"), _first(a_("source_chapter"), b_("source_chapter"), otherwise=UNKNOWN).alias("source_chapter"),
        _first(a_("source_subchapter"), b_("source_subchapter"), otherwise=UNKNOWN).alias("source_subchapter"), _first(taxon).alias("subject_taxon_id"), F.lit(rank).alias("subject_rank"), common.alias("common_name"), scientific.alias("scientific_name"),
    )


def evidence_chunks(*parts: DataFrame) -> DataFrame:
    """Chunks of all parts with the same columns, their text cleaned; chapters that lack are unknown."""
    wanted = ("chunk_id", "raw_text", "source_db", "source_file", "source_chapter", "source_subchapter", "source_chapter_raw", "species_name", "family_name", "order_name")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    get = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    given = {n: F.coalesce(get(n), F.lit(UNKNOWN)) if "chapter" in n else get(n) if n.endswith("_name") or n == "chunk_id" else text(get(n)) for n in wanted}
    return rows.select(*(c.alias(n) for n, c in given.items()), without_marks(get("raw_text")).alias("cleaned_text"))


def in_scope(rows: DataFrame, families: DataFrame, orders: DataFrame, family: str, order: str, full: bool = False) -> DataFrame:
    """Rows of the families; rows without a family by their order; all rows in full scope.  Keys are columns of the same names."""
    if full:
        return rows
    named = F.coalesce(F.col(family), F.lit("")) != ""
    return rows.where(named).join(families.select(family).distinct(), family, "left_semi").select(rows.columns).unionByName(rows.where(~named).join(orders.select(order).distinct(), order, "left_semi").select(rows.columns))


def chunk_kind(source: Column, species: Column, common: Column, expected: str) -> Column:
    """family or species by what a chunk says of itself, else what its file is expected to hold."""
    return F.when(F.upper(text(source)) == FAMILY_SOURCE, "family").when((text(species) != "") | (text(common) != ""), "species").otherwise(expected)


def chunk_chapter(chapter: Column, raw: Column) -> Column:
    """The chapter; where it is empty or unknown, as the page had it."""
    plain = F.regexp_replace(F.lower(text(chapter)), "[^a-z0-9]+", "")
    return F.when((F.trim(text(chapter)) != "") & (plain != "unknown"), F.trim(chapter)).otherwise(_first(F.trim(raw), otherwise=UNKNOWN))


def family_chapter(c: Column | str) -> Column:
    low, out = F.lower(collapse(c)), F.lit(UNKNOWN)
    for name, spellings in FAMILY_CHAPTERS.items():
        out = F.when(low.isin(*spellings), name).otherwise(out)
    return out


def subchapter(c: Column | str, chapter: Column, parent: Column) -> Column:
    """The chapter that a heading itself is, else the heading under a known parent."""
    own = collapse(c)
    return F.when(own == "", UNKNOWN).when(chapter != UNKNOWN, chapter).when(F.coalesce(parent, F.lit(UNKNOWN)).isin("", UNKNOWN), UNKNOWN).otherwise(own)


def answer_summary(answers: DataFrame, scores: DataFrame, key: str, by: Sequence[str], score: str, invalid: str) -> DataFrame:
    """by, answers, scored, invalid, mean of the scores (two decimals each); answers without a score are only counted."""
    rows = answers.join(scores.select(key, score, invalid), key, "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n_total"), F.count(score).alias("n_scored"), F.count_if(F.col(score).isNotNull() & (F.col(invalid) > 0)).alias("n_invalid"), F.round(F.coalesce(F.avg(F.round(F.col(score), 2)), F.lit(0.0)), 6).alias("avg_score"))


def representatives(relations: DataFrame, id_: str, kind: str, unit: str, order: Sequence[str], budgets: dict[str, int] = BUDGETS, least: int = LEAST_RELATIONS) -> DataFrame:
    """A few relations to show: of each kind the first of different units within its budget, then others by order up to least in all."""
    budget = F.lit(0)
    for k, n in budgets.items():
        budget = F.when(F.col(kind) == k, n).otherwise(budget)
    once = relations.withColumn("_u", F.row_number().over(Window.partitionBy(kind, unit).orderBy(*order, id_))).where("_u = 1")
    chosen = once.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order, id_))).where((F.col("_n") <= max(budgets.values())) & (F.col("_n") <= budget)).select(relations.columns)
    ids = chosen.select(id_)
    others = relations.join(ids, id_, "left_anti").orderBy(*order, id_).limit(least)
    others = others.withColumn("_n", F.row_number().over(Window.orderBy(*order, id_))).join(ids.agg(F.count("*").alias("_have")))  # of so few rows
    return chosen.unionByName(others.where(F.col("_n") + F.col("_have") <= least).select(relations.columns))
