"""One-hop context from a property graph: anchors of a target, scored edges, lines of text."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import collapse, multi_value, nearly_same, text, tokens

#: Points of an anchor whose name equals, begins with or contains the target; of its kind; of a description.
EXACT, BEGINS, CONTAINS, KIND, DESCRIBED = 100.0, 20.0, 10.0, 5.0, 1.0
#: Points of an edge for each domain keyword and each question token in its text, a description, the target as subject.
KEYWORD, TOKEN, EDGE_DESCRIBED, SUBJECT = 3.0, 0.5, 1.0, 1.0
HEADER, NOTES = "[Graph relation facts]", "[Brief related-node notes]"


def folded(c: Column) -> Column:
    return F.lower(collapse(c))


def grams(c: Column, size: Column) -> Column:
    """Distinct character sequences of a size."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, size)))


def containing(targets: DataFrame, nodes: DataFrame, name: str = "entity_id") -> DataFrame:
    """Rows of targets (query_id, wanted) with the nodes whose folded name contains the wanted text.

    An equi-join on the target's first characters (three, or as many as it has) selects the candidates.
    """
    asked = targets.where("wanted <> ''").withColumn("gram", F.substring("wanted", 1, 3))
    parts = nodes.withColumn("folded", folded(F.col(name)))
    by_size = F.array_distinct(F.concat(*(grams(F.col("folded"), F.lit(k)) for k in (1, 2, 3))))
    return asked.join(parts.withColumn("gram", F.explode(by_size)), "gram").where(F.contains("folded", "wanted")).drop("gram")


def anchors(targets: DataFrame, nodes: DataFrame, kinds: Sequence[str] = (), kind: str = "") -> DataFrame:
    """query_id, node_id, entity_id, score of the anchors of each target.

    All nodes of that very name; where there is none the best one that contains it, of at most five by likeness of
    name.  targets: query_id, target; nodes: node_id, entity_id, labels, entity_type, description.
    """
    asked = targets.select("query_id", folded(F.col("target")).alias("wanted"))
    exact = asked.where("wanted <> ''").join(nodes.withColumn("folded", folded(F.col("entity_id"))), F.col("wanted") == F.col("folded"))
    part = containing(asked.join(exact.select("query_id").distinct(), "query_id", "left_anti"), nodes)
    first = Window.partitionBy("query_id").orderBy(F.length("folded"), "entity_id", "node_id")
    part = part.withColumn("_n", F.row_number().over(first)).where("_n <= 5").drop("_n")
    rows = exact.select(*part.columns).unionByName(part)
    points = F.when(F.col("folded") == F.col("wanted"), EXACT).when(F.startswith("folded", "wanted"), BEGINS).otherwise(CONTAINS)
    for k in kinds:
        points = points + F.when(F.array_contains("labels", k), KIND).otherwise(0.0)
    points = points + F.when(folded(F.col("entity_type")) == kind, KIND).otherwise(0.0) + F.when(text(F.col("description")) != "", DESCRIBED).otherwise(0.0)
    scored = rows.withColumn("score", points)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id", "node_id")
    kept = scored.withColumn("_n", F.row_number().over(best)).where((F.col("folded") == F.col("wanted")) | (F.col("_n") == 1))
    return kept.select("query_id", "node_id", "entity_id", "score")


def edge_score(question: Column, keywords: Column, target: Column) -> Column:
    """Points of an edge (columns subject, object, description, keywords, weight) for a question, its domain keywords and target."""
    held = F.lower(F.concat_ws(" ", text(F.col("description")), text(F.col("keywords")), text(F.col("subject")), text(F.col("object"))))
    matches = lambda words: F.size(F.filter(words, lambda w: F.contains(held, F.lower(w))))
    described = F.when(text(F.col("description")) != "", EDGE_DESCRIBED).otherwise(0.0)
    own = F.when(folded(F.col("subject")) == folded(target), SUBJECT).otherwise(0.0)
    return F.coalesce(F.col("weight"), F.lit(0.0)) + KEYWORD * matches(keywords) + TOKEN * matches(F.array_distinct(tokens(question))) + described + own


def aligned_segment(description: Column, sources: Column, wanted: Column, most: int = 260) -> Column:
    """The part of a node's joined descriptions that comes from one of the edge's sources, else the first part."""
    parts, own = multi_value(description), multi_value(sources)
    at = F.array_position(F.transform(own, lambda s: F.array_contains(multi_value(wanted), s)), True)
    found = F.when(F.size(parts) > 0, F.coalesce(F.get(parts, F.when(at > 0, at - 1).cast("int")), F.get(parts, F.lit(0))))
    return F.when(F.length(found) > most, F.concat(F.rtrim(F.substring(found, 1, most)), F.lit("..."))).otherwise(F.coalesce(found, F.lit("")))


def top_edges(targets: DataFrame, found: DataFrame, edges: DataFrame, most: int = 40, neighbours: int = 160) -> DataFrame:
    """Edges of each query's anchors in either direction, with score and rank: the best of at most so many neighbours by weight.

    targets: query_id, target, question, domain_keywords; edges: edge_id, source, target, and what edge_score reads.
    """
    ends = edges.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("node_id")).drop("source", "target")
    rows = ends.join(found.select("query_id", "node_id"), "node_id").dropDuplicates(["query_id", "edge_id"])
    heavy = Window.partitionBy("query_id").orderBy(F.desc("weight"), "edge_id")
    rows = rows.withColumn("_n", F.row_number().over(heavy)).where(F.col("_n") <= neighbours).drop("_n").join(targets, "query_id")
    rows = rows.withColumn("score", F.round(edge_score(F.col("question"), F.col("domain_keywords"), F.col("target")), 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "edge_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def lines(ranked: DataFrame, notes: int = 0) -> DataFrame:
    """query_id, context: distinct relations in order, then at most so many notes on objects that say something else."""
    rows = ranked.where(text(F.col("description")) != "")
    same = Window.partitionBy("query_id", "subject", "description", "object", "source_id").orderBy("rank")
    rows = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    part = lambda rows, line: F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    out = rows.groupBy("query_id").agg(part(rows, F.concat(F.lit("- "), collapse(F.col("description")))).alias("relations"))
    if not notes:
        return out.select("query_id", F.concat_ws("\n", F.lit(HEADER), "relations").alias("context"))
    brief = rows.withColumn("brief", aligned_segment(F.col("object_description"), F.col("object_source_id"), F.col("source_id")))
    brief = brief.where((text(F.col("object")) != "") & (F.col("brief") != "") & ~nearly_same(F.col("brief"), F.col("description")))
    brief = brief.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", folded(F.col("object"))).orderBy("rank"))).where("_n = 1")
    brief = brief.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= notes)
    brief = brief.groupBy("query_id").agg(part(brief, F.concat(F.lit("- "), collapse(F.col("object")), F.lit(": "), F.col("brief"))).alias("notes"))
    text_ = F.concat_ws("\n", F.lit(HEADER), "relations", F.when(F.col("notes").isNotNull(), F.concat(F.lit("\n"), F.lit(NOTES))), "notes")
    return out.join(brief, "query_id", "left").select("query_id", text_.alias("context"))


def one_hop(targets: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = (), kind: str = "", most: int = 40, neighbours: int = 160, notes: int = 0) -> DataFrame:
    """query_id, context of every query; where there is none the text says why."""
    found = anchors(targets, nodes, kinds, kind)
    ranked = top_edges(targets, found, edges, most, neighbours)
    why = lambda reason: F.concat(F.lit(f"[NO_KG_CONTEXT: {reason}"), F.when(F.lit(reason.endswith(": ")), F.col("target")).otherwise(""), F.lit("]"))
    state = found.groupBy("query_id").agg(F.lit(1).alias("_a")).join(ranked.groupBy("query_id").agg(F.lit(1).alias("_e")), "query_id", "left")
    rows = targets.join(state, "query_id", "left").join(lines(ranked, notes), "query_id", "left")
    missing = F.when(collapse(F.col("target")) == "", why("missing target_entity")).when(F.col("_a").isNull(), why("entity not found: ")).when(F.col("_e").isNull(), why("no edges for entity: ")).otherwise(why("no usable relation descriptions for entity: "))
    return rows.select("query_id", F.coalesce("context", missing).alias("context"))
