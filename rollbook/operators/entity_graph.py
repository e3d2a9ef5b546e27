"""Entity graph of documents (DOC-4 to DOC-9).

The provenance of a node or edge is a set of documents. A common entity can occur in most
documents, so the set is kept as rows (name, document_id) and not as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import top_per_group
from ..functions.text import computed_once

REPLY = (
    "struct<entities:array<struct<entity_name:string,entity_type:string>>,"
    "relationships:array<struct<source_entity:string,target_entity:string,relation:string,relationship_description:string>>>"
)


def repaired(c: Column) -> Column:
    """Missing commas put in, trailing commas taken out."""
    t = F.regexp_replace(c, r"\}\s*\{", "}, {")
    t = F.regexp_replace(t, r"\]\s*\[", "], [")
    t = F.regexp_replace(t, r",\s*\}", "}")
    return F.regexp_replace(t, r",\s*\]", "]")


def parse_triplets(replies: DataFrame) -> DataFrame:
    """Triplets of model replies (document_id, reply): outermost braces, repaired when broken."""
    rows = computed_once(replies.select("document_id", "reply"), {"inner": F.regexp_extract("reply", r"(?s)\{.*\}", 0)})
    rows = computed_once(rows, {"whole": F.try_parse_json("inner").isNotNull()})
    rows = computed_once(rows, {"fixed": F.when(F.col("whole"), F.col("inner")).otherwise(repaired(F.col("inner")))})
    good = F.when(F.col("whole") | F.try_parse_json("fixed").isNotNull(), F.col("fixed"))
    rows = computed_once(rows, {"j": good}).where("j <> ''")
    rows = computed_once(rows.select("document_id", "j"), {"r": F.from_json("j", REPLY)})
    # Types join on (document, name): a lookup inside the row would scan all entities per relation.
    named = rows.select("document_id", F.posexplode("r.entities").alias("n", "e")).select("document_id", "n", F.lower("e.entity_name").alias("name"), "e.entity_type")
    types = named.groupBy("document_id", "name").agg(F.max_by(F.coalesce("entity_type", F.lit("Entity")), "n").alias("type"))
    rels = F.transform("r.relationships", lambda x, i: F.struct(
        i.alias("pos"), x["source_entity"].alias("source"), x["target_entity"].alias("target"),
        F.coalesce(x["relation"], F.lit("RELATED")).alias("relation"), F.coalesce(x["relationship_description"], F.lit("")).alias("description")))
    out = rows.select("document_id", F.inline(rels)).where("source <> '' AND target <> ''")
    for end in ("source", "target"):
        kinds = types.withColumnsRenamed({"name": "_key", "type": f"{end}_type"})
        out = out.withColumn("_key", F.lower(end)).join(kinds, ["document_id", "_key"], "left").drop("_key")
    return out.select(
        "document_id", "pos", "source", F.coalesce("source_type", F.lit("Entity")).alias("source_type"),
        "target", F.coalesce("target_type", F.lit("Entity")).alias("target_type"), "relation", "description",
    )


def entity_documents(triplets: DataFrame) -> DataFrame:
    """Provenance of entities: (name, document_id)."""
    ends = triplets.select(F.col("source").alias("name"), "document_id").unionByName(triplets.select(F.col("target").alias("name"), "document_id"))
    return ends.distinct()


def relation_documents(triplets: DataFrame) -> DataFrame:
    return triplets.select("source", "relation", "target", "document_id").distinct()


def merge_entities(triplets: DataFrame) -> DataFrame:
    """Entities with the type set last, in document and position order, and their document count."""
    order = F.struct("document_id", "pos", "end")
    ends = triplets.select(F.col("source").alias("name"), F.col("source_type").alias("type"), "document_id", "pos", F.lit(0).alias("end")).unionByName(
        triplets.select(F.col("target").alias("name"), F.col("target_type").alias("type"), "document_id", "pos", F.lit(1).alias("end"))
    )
    return ends.groupBy("name").agg(
        F.coalesce(F.max_by("type", F.when(F.col("type").isNotNull(), order)), F.lit("Entity")).alias("type"), F.countDistinct("document_id").alias("document_count")
    )


def merge_relations(triplets: DataFrame) -> DataFrame:
    """Relations with the description seen first and their document count."""
    return triplets.groupBy("source", "relation", "target").agg(
        F.min_by("description", F.struct("document_id", "pos")).alias("description"), F.countDistinct("document_id").alias("document_count")
    )


def purge_documents(provenance: DataFrame, keys: list[str], removed: DataFrame) -> DataFrame:
    """Nodes or edges left after documents are removed, with the documents they still have."""
    left = provenance.join(removed.select("document_id"), "document_id", "left_anti")
    return left.groupBy(*keys).agg(F.count("*").alias("document_count"))


def undirected(relations: DataFrame) -> DataFrame:
    """Both directions of every relation."""
    cols = ["relation", "description"]
    return relations.select(F.col("source").alias("s"), F.col("target").alias("t"), *cols).unionByName(
        relations.select(F.col("target").alias("s"), F.col("source").alias("t"), *cols)
    )


def matches(col: str, patterns: list[str]) -> Column:
    """Whether a name contains any of the asked entities, any case. The list comes with a request."""
    out = F.lit(False)
    for e in patterns:
        out = out | F.col(col).rlike(f"(?i){e}")
    return out


def subgraph_by_entity(relations: DataFrame, entities: list[str], n: int = 100) -> DataFrame:
    rows = undirected(relations).where(matches("s", entities))
    return rows.orderBy("s", "t", "relation").limit(n)


def subgraph_by_documents(relations: DataFrame, provenance: DataFrame, documents: DataFrame, n: int = 200) -> DataFrame:
    """Relations whose source or target occurs in any of the documents."""
    names = provenance.join(documents.select("document_id"), "document_id", "left_semi").select("name").distinct().withColumn("_in", F.lit(True))
    rows = (
        relations.join(names.withColumnsRenamed({"name": "source", "_in": "_a"}), "source", "left")
        .join(names.withColumnsRenamed({"name": "target", "_in": "_b"}), "target", "left")
        .where("_a OR _b").drop("_a", "_b")
    )
    return rows.orderBy("source", "target", "relation").limit(n)


def multi_hop(relations: DataFrame, entities: list[str], provenance: DataFrame | None = None, documents: DataFrame | None = None, n: int = 15) -> DataFrame:
    """One-hop and two-hop insight sentences from seed entities to others, n of each kind.

    For two hops over a middle node only the n smallest far ends of that node can be among the n
    first sentences of a (seed, middle) pair, so a hub is cut to n rows before it is joined.
    """
    both = undirected(relations)
    if documents is not None:
        scoped = provenance.join(documents.select("document_id"), "document_id", "left_semi").select(F.col("name").alias("s")).distinct().withColumn("in_s", F.lit(True))
        both = both.join(scoped, "s", "left").join(scoped.withColumnsRenamed({"s": "t", "in_s": "in_t"}), "t", "left").na.fill(False, ["in_s", "in_t"])
    else:
        both = both.withColumn("in_s", F.lit(True)).withColumn("in_t", F.lit(True))
    start = both.where(matches("s", entities))
    one = start.where(~matches("t", entities) & (F.col("in_s") | F.col("in_t")))
    text1 = F.concat("s", F.lit(" --("), F.lit("RELATED"), F.lit(")--> "), "t", F.lit(" (Context: "), F.coalesce("description", F.lit("N/A")), F.lit(")"))
    near = one.select("s", "t", text1.alias("insight")).distinct().orderBy("s", "t", "insight").limit(n).select("insight")
    firsts = start.select("s", F.col("t").alias("mid"), F.col("in_s").alias("seed_in")).distinct()
    far_all = both.where(~matches("t", entities)).select(F.col("s").alias("mid"), F.col("t").alias("far"), F.col("in_t").alias("far_in")).distinct()
    # far ends inside and outside the documents are ranked apart, as a seed inside may use both
    far = top_per_group(far_all, ["mid", "far_in"], [F.asc("far")], n, ["far"])
    two = firsts.join(far, "mid").where((F.col("seed_in") | F.col("far_in")) & (F.col("far") != F.col("s")))
    text2 = F.concat("s", F.lit(" is linked to "), "far", F.lit(" through "), "mid", F.lit(" (Rel: RELATED -> RELATED)"))
    wide = two.select("s", "mid", "far", text2.alias("insight")).distinct().orderBy("s", "mid", "far").limit(n).select("insight")
    return wide.unionByName(near).distinct()


def one_hop(relations: DataFrame, names: DataFrame, n: int = 15) -> DataFrame:
    """Neighbors of exactly named entities."""
    rows = undirected(relations).join(names.select(F.col("name").alias("s")), "s", "left_semi")
    fact = F.concat("s", F.lit(" --(RELATED)--> "), "t")
    return rows.select("s", "t", fact.alias("fact")).distinct().orderBy("s", "t").limit(n).select("fact")
