"""What a question asks for: keywords and a small graph of entities, held to the schema.

entities: qid, ord, id, label, props (map); links: qid, ord, source_id, target_id, type. Ids are
those of the question's own graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import canonical_name, col, json_list
from quillgraph.operators.graph import allowed

GRAPH = "struct<nodes:array<struct<id:string,label:string,properties:map<string,string>>>,relationships:array<struct<source_id:string,target_id:string,type:string>>>"
#: Labels whose name is looked up in its canonical form.
NAMED = ["Company", "Institution", "Person", "Court", "LegalParty"]


def keywords(c: Column | str, most: int = 3) -> Column:
    """The first of a comma-separated answer's items that aren't empty."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def question_graph(answers: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entities, links) from a provider's JSON answers (qid, value); an answer that can't be read gives none."""
    read = answers.select("qid", F.from_json(value, GRAPH).alias("g"))
    entities = read.select("qid", F.posexplode("g.nodes").alias("ord", "n")).select("qid", "ord", "n.id", "n.label", F.col("n.properties").alias("props"))
    links = read.select("qid", F.posexplode("g.relationships").alias("ord", "r")).select("qid", "ord", "r.*")
    return entities, links


def valid_entities(entities: DataFrame, schema: DataFrame) -> DataFrame:
    """Entities with labels of the schema and properties that it lists, or ``name``; of one id the last.

    An id that comes with an unknown label anywhere is left out. ``schema``: label, key_props, other_props.
    """
    rules = schema.select("label", "key_props", F.array_union(F.array_union("key_props", "other_props"), F.array(F.lit("name"))).alias("known"))
    marked = entities.join(F.broadcast(rules), "label", "left")  # a row per label
    same = Window.partitionBy("qid", "id")
    marked = marked.withColumns({"bad": F.max(F.col("known").isNull()).over(same), "last": F.row_number().over(same.orderBy(F.desc("ord")))})
    props = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains("known", k))
    return marked.where("NOT bad AND last = 1").select("qid", "ord", "id", "label", props.alias("props"), "key_props")


def normalized_entities(valid: DataFrame) -> DataFrame:
    """Names in canonical form; entities without any property are dropped, those that lack a key stay as hints."""
    name = F.try_element_at("props", F.lit("name"))
    rest = F.map_filter("props", lambda k, v: k != "name")
    others = F.map_filter(rest, lambda k, v: k != "normalized_name")
    named = F.when(F.coalesce(name, F.lit("")) != "", F.map_concat(others, F.create_map(F.lit("normalized_name"), canonical_name(name)))).otherwise(rest)
    renamed = F.col("label").isin(NAMED) & F.map_contains_key("props", "name")
    out = valid.withColumn("props", F.when(renamed, named).otherwise(F.col("props")))
    return out.where("size(props) > 0 OR size(key_props) = 0").drop("key_props")


def valid_links(links: DataFrame, valid: DataFrame, relations: DataFrame, last_only: bool = False) -> DataFrame:
    """Links between valid entities that the schema allows: src_label and dst_label are added.

    An end that is dropped later for want of properties doesn't matter. A rule is matched whole; with ``last_only``, of
    rules with one (from, type) the last alone counts. relations: from_label, type, to_label, ord.
    """
    ends = valid.select("qid", "id", "label")
    out = links.where("coalesce(type, '') <> ''")
    for side, name in (("source_id", "src_label"), ("target_id", "dst_label")):
        out = out.join(ends.toDF("qid", side, name), ["qid", side])
    return allowed(out, relations, last_only).select("qid", "ord", "source_id", "target_id", "type", "src_label", "dst_label")


def chosen_labels(answer: Column | str, known: list[str]) -> Column:
    """The listed names that exist, in a list answer; all of them where none does."""
    found = F.array_intersect(json_list(answer), F.array(*map(F.lit, known)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, known)))
