"""Text functions on columns: normalisation, tokens, splitting, labels."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null as the empty text."""
    return F.coalesce(_c(c), F.lit(""))


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def scientific_name(c: Column | str) -> Column:
    return F.replace(collapse(c), F.lit(" ,"), F.lit(","))


def without_parenthesis(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\s*\([^)]*\)\s*$", "")


def family_name(c: Column | str) -> Column:
    return scientific_name(without_parenthesis(text(c)))


def genus(c: Column | str) -> Column:
    return F.split_part(scientific_name(c), F.lit(" "), F.lit(1))


def binomial(c: Column | str) -> Column:
    return F.substring_index(scientific_name(c), " ", 2)


def key(c: Column | str) -> Column:
    """Letters and digits of ASCII only, in lower case."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def code(c: Column | str) -> Column:
    return F.lower(collapse(c))


def external_id(c: Column | str, prefix: str) -> Column:
    return F.upper(F.regexp_replace(collapse(c), f"(?i)^{prefix}[-:]?", ""))


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(collapse(c)), r"(?U)[^\w]+", "-"), F.lit("-"))


#: Typographic characters and what they become.
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "−": "-", "…": ".", " ": " "}


def fold_punctuation(c: Column | str) -> Column:
    return F.translate(text(c), "".join(PUNCTUATION), "".join(PUNCTUATION.values()))


#: Figure, table and plate references, links and bracketed credits.
VISUALS = (r"(?i)\((?:see )?(?:fig(?:ure)?|table|plate|map|photo|video|audio)s?\.?\s*[^)]*\)", r"https?://\S+", r"(?i)\[(?:photo|video|audio|image)[^\]]*\]")
#: (Author 1999), (Author et al. 1999, Author and Other 2001a), [12, 13].
CITATIONS = (r"\((?:[A-Z][^()]*?\b(?:1[89]|20)\d{2}[a-z]?[^()]*)\)", r"\[\d+(?:\s*,\s*\d+)*\]")


def strip(c: Column | str, patterns: Sequence[str]) -> Column:
    out = text(c)
    for p in patterns:
        out = F.regexp_replace(out, p, " ")
    return out


def clean(c: Column | str) -> Column:
    """Folded punctuation, no visual markers or citations, single spaces, none before punctuation."""
    return F.regexp_replace(collapse(strip(fold_punctuation(c), VISUALS + CITATIONS)), r"\s+([,.;:])", "$1")


def keep_paragraphs(c: Column | str) -> Column:
    """Blanks collapsed within lines; two line ends at most in a row."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"[ \t\f\r]+", " "), r"\s*\n\s*\n\s*", "\n\n"))


def strip_html(c: Column | str) -> Column:
    """Scripts, styles, comments and tags removed, five entities resolved, single spaces."""
    out = text(c)
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        out = F.regexp_replace(out, p, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def no_control(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def truncate(c: Column | str, n: int, mark: str = "...") -> Column:
    c = text(c)
    return F.when(F.char_length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - len(mark))), F.lit(mark))).otherwise(c)


def mask(c: Column | str, names: Column, by: str = "[MASK]") -> Column:
    """Every name of an array column replaced, longest first, whatever the case."""
    ordered = F.array_sort(F.filter(names, lambda n: F.length(n) > 0), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(ordered, lambda n: F.regexp_replace(n, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    return F.when(F.size(quoted) > 0, F.regexp_replace(text(c), F.concat(F.lit("(?i)"), F.array_join(quoted, "|")), F.lit(by))).otherwise(text(c))


#: Words that carry no meaning for retrieval.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with")


def tokens(c: Column | str, least: int = 2, stop: Sequence[str] = STOPWORDS) -> Column:
    """Runs of a-z and 0-9 in lower case, of a least length, without stopwords."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stop)) if stop else F.filter(found, lambda t: F.length(t) >= least)


#: Words, and page furniture, that retrieval over chunks leaves out.
RETRIEVAL_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "from", "at", "as", "is", "are", "was", "were", "be", "been", "being", "this", "that",
    "these", "those", "it", "its", "into", "than", "then", "their", "them", "they", "he", "she", "his", "her", "you", "your", "we", "our", "but", "if", "not", "do", "does",
    "did", "which", "what", "when", "where", "who", "whom", "how", "why", "can", "could", "should", "would", "may", "might", "about", "under", "over", "between", "during",
    "also", "only", "using", "use", "used", "within", "most", "more", "less", "very", "bird", "birds", "species", "target", "provided", "text", "based", "describe", "identify",
    "close", "share", "print", "photo", "video",
)


def retrieval_tokens(c: Column | str, least: int = 2) -> Column:
    """Runs of a-z, 0-9, hyphens, bars and apostrophes (curly ones made straight) in lower case, without words that retrieval leaves out."""
    found = F.regexp_extract_all(F.lower(F.replace(text(c), F.lit("’"), F.lit("'"))), F.lit("[a-z0-9'|-]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*RETRIEVAL_STOPWORDS))


#: What retrieval cuts from chunks: photo and video marks, figures, plates, (Author et al., 1999), [12, 13].
CHUNK_MARKS = (r"(?i)\b(?:photo|video)\b", r"\(?[Ff]ig\.?\s*\d+\)?", r"\(?[Pp]late\s*\d+\)?", r"\([A-Z][a-z]+(?: et al\.)?,\s*\d{4}\)", r"\[\d+(?:,\s*\d+)*\]")


def without_marks(c: Column | str) -> Column:
    """The text of a chunk without marks and citations, runs of blanks as one space."""
    out = text(c)
    for p in CHUNK_MARKS:
        out = F.regexp_replace(out, p, "")
    return F.trim(F.regexp_replace(out, r"(?U)\s{2,}", " "))


def query_terms(c: Column | str, most: int = 16) -> Column:
    return F.slice(F.array_sort(F.array_distinct(tokens(c, 3))), 1, most)


def token_count(c: Column | str) -> Column:
    """Words and numbers, and each CJK character."""
    return F.regexp_count(text(c), F.lit(r"[一-鿿]|[A-Za-z0-9]+"))


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), r"(?<=[.!?;])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def multi_value(c: Column | str, separator: str = "<SEP>") -> Column:
    return F.filter(F.transform(F.split(text(c), separator), lambda s: F.trim(s)), lambda s: s != "")


def labels(c: Column | str, rules: dict[str, str], most: int) -> Column:
    """Names of the rules (name: pattern) that match, in their order, at most so many."""
    return F.slice(F.array_compact(F.array(*(F.when(text(c).rlike(p), F.lit(name)) for name, p in rules.items()))), 1, most)


def first_rule(c: Column | str, rules: dict[str, str], otherwise: str) -> Column:
    """Name of the first rule that matches: ordered canonicalisation of headings, errors, groups."""
    out = None
    for name, p in rules.items():
        out = F.when(text(c).rlike(p), name) if out is None else out.when(text(c).rlike(p), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def ordered_distinct(values: Column) -> Column:
    """First spelling of each value, whatever the case."""
    lower = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)


def field(c: Column | str, name: str) -> Column:
    """value of ``name: value;`` in a text of conditions."""
    return F.trim(F.regexp_extract(text(c), rf"(?i)(?:^|;)\s*{name}\s*:\s*([^;]*)", 1))


def without_fence(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def name_variants(c: Column | str) -> Column:
    """The name, its title case, without hyphens, without a parenthesis: distinct, in order."""
    n = collapse(c)
    return F.filter(F.array_distinct(F.array(n, F.initcap(n), F.replace(n, F.lit("-"), F.lit(" ")), collapse(without_parenthesis(n)))), lambda x: x != "")


def supports(quote: Column, context: Column) -> Column:
    """Whether the normalised quote stands in the normalised context."""
    norm = lambda c: F.lower(collapse(fold_punctuation(c)))
    return (norm(quote) != "") & F.contains(norm(context), norm(quote))


def nearly_same(a: Column, b: Column, ratio: float = 0.8) -> Column:
    """Equal after normalisation, or one within the other with lengths this close."""
    a, b = F.lower(collapse(a)), F.lower(collapse(b))
    close = F.least(F.length(a), F.length(b)) >= ratio * F.greatest(F.length(a), F.length(b))
    return (a == b) | (close & (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)))
