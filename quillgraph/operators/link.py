"""From a question's entities to nodes: tiers of lookups, and what they find by node.

nodes: element_id, label, labels (array), props (map). Matches: qid, id (of the entity), element_id,
labels, source, score, tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import lookup_candidates
from quillgraph.operators.cut import kept
from quillgraph.operators.search import tokens
from quillgraph.operators.text_index import TextIndex

# Labels with a composite key, and with an id of their own.
COMPOSITE = {"Article": ["parent_act_key", "index"], "Clause": ["parent_article_key", "index"], "CourtCase": ["document_id", "chunk_id"], "Section": ["document_id", "chunk_id"]}
SINGLE = {
    "Penalty": "penalty_id",
    "Contract": "contract_id",
    "Tender": "tender_id",
    "Award": "award_id",
    "Meeting": "meeting_id",
    "Auction": "auction_id",
    "Asset": "asset_id",
    "Document": "document_id",
    "Resolution": "resolution_id",
    "Complaint": "complaint_id",
    "Vote": "vote_id",
    "Correction": "correction_id",
    "Addendum": "addendum_id",
    "ChangeOrder": "change_order_id",
}


def legal_act_lookup(acts: DataFrame, asked: DataFrame) -> DataFrame:
    """Acts by type, number and year, numbers compared as text: qid, element_id, labels, source.

    Equal as values implies equal as text, so one join gives what a typed pass and a textual one would.
    """
    keys = ["act_type", "act_number", "act_year"]
    left = acts.select("element_id", "labels", *(F.col(k).cast("string").alias(k) for k in keys))
    right = asked.select("qid", *(F.col(k).cast("string").alias(k) for k in keys)).distinct()
    return left.join(right, keys).select("qid", "element_id", "labels", F.lit("legalact:key").alias("source")).dropDuplicates(["qid", "element_id"])


def _key(label, props):
    """A label's key as one text, null where a part is missing."""
    value = lambda k: F.try_element_at(props, F.lit(k))
    whole = lambda ks: F.when(F.concat(*map(value, ks)).isNotNull(), F.array_join(F.array(*map(value, ks)), "|"))
    out = F.when(label == "LegalAct", whole(["act_type", "act_number", "act_year"]))
    for name, keys in [*COMPOSITE.items(), *((k, [v]) for k, v in SINGLE.items())]:
        out = out.when(label == name, whole(keys))
    return out


def _key_source(label):
    return F.when(label == "LegalAct", "legalact:key").when(label.isin(*COMPOSITE), F.concat(F.lit("btree:composite_"), F.lower(label))).otherwise(F.concat(F.lit("btree:id_"), F.lower(label)))


def looked_up(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """qid, id of the entities that ask for a node of their own: with a whole key, or a property that is looked up."""
    keyed = entities.where(_key(F.col("label"), F.col("props")).isNotNull()).select("qid", "id")
    named = entities.select("qid", "id", "label", F.explode(F.map_keys("props")).alias("prop")).join(F.broadcast(properties), ["label", "prop"])  # a row per label and property
    return keyed.union(named.select("qid", "id")).distinct()


def linked(entities: DataFrame, nodes: DataFrame, properties: DataFrame, lookup=None, told: bool = False) -> DataFrame:
    """Matches of each entity in its first tier that has any: its key, else its properties, else what ``lookup`` finds.

    properties: label, prop: what may be looked up by a property. ``lookup`` gets the entities (qid, id, label, props) without a match in the first two tiers,
    such as by ``vector_index.targeted`` or ``text_lookup``, and gives qid, id, element_id, source. With ``told`` (without ``lookup``) matches lie by question, come with
    the entity's ``ord`` and props (``asked``), so that ``entry_nodes`` needs neither a join nor a shuffle, and may be repeated.
    """
    if told and lookup is not None:
        raise ValueError("what lookup finds isn't told")
    names = ["ord", "asked"] if told else []
    entities = entities.withColumn("asked", F.col("props")) if told else entities
    keyed = entities.withColumn("k", _key(F.col("label"), F.col("props"))).where("k IS NOT NULL").select("qid", "id", "label", "k", *names)
    there = nodes.withColumn("k", _key(F.col("label"), F.col("props"))).where("k IS NOT NULL").select("label", "k", "element_id", "labels")
    first = keyed.join(there, ["label", "k"]).select("qid", "id", "element_id", "labels", _key_source(F.col("label")).alias("source"), F.lit(1).alias("tier"), *names)

    rules = F.broadcast(properties)  # a row per label and property
    exploded = lambda rows, *keep: rows.select(*keep, "label", F.explode("props").alias("prop", "v")).join(rules, ["label", "prop"])
    forms = F.when(F.col("prop") == "normalized_name", lookup_candidates("v", "normalized_name")).otherwise(lookup_candidates("v", ""))
    wanted = exploded(entities, "qid", "id", *names).select("qid", "id", "label", "prop", F.explode(forms).alias("v"), *names)
    held = exploded(nodes, "element_id", "labels").select("element_id", "labels", "label", "prop", F.lower("v").alias("v"))
    second = wanted.join(held, ["label", "prop", "v"]).select("qid", "id", "element_id", "labels", F.lit("btree").alias("source"), F.lit(2).alias("tier"), *names)
    best = F.min("tier").over(Window.partitionBy("qid", "id"))
    found = first.union(second).repartition("qid") if told else first.union(second.distinct())
    found = found.withColumn("best", best).where("tier = best").drop("best")
    if lookup is None:
        return found
    found = kept(found)
    rest = entities.join(found.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    third = lookup(rest.select("qid", "id", "label", "props")).select("qid", "id", "element_id", "source").distinct()
    carries = nodes.select("element_id", "labels")
    return found.unionByName(third.join(carries, "element_id").select("qid", "id", "element_id", "labels", "source", F.lit(3).alias("tier")))


def text_lookup(entities: DataFrame, index: TextIndex, labels: list[str], limit: int = 3) -> DataFrame:
    """qid, id, element_id, source: entities of the given labels looked up by the words of their properties among nodes of the same label."""
    out = None
    for label in labels:  # labels with a full-text index: a few of the schema's
        words = tokens(F.array_join(F.map_values("props"), " "))
        asked = entities.where(F.col("label") == label).select(F.struct("qid", "id").alias("qid"), words.alias("terms"))
        found = index.search(asked, limit, [label]).select("qid.qid", "qid.id", "element_id", F.lit(f"fulltext:{label.lower()}").alias("source"))
        out = found if out is None else out.unionByName(found)
    return out


def entry_nodes(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """qid, element_id, labels, sources (sorted, distinct), props: a row per node found.

    Labels, and the properties of the entity that found it, are those of the first match by the entity's ``ord``.
    """
    rows = matches if "asked" in matches.columns else matches.join(entities.select("qid", "id", "ord", F.col("props").alias("asked")), ["qid", "id"])
    at = F.struct("ord", "tier", "source")
    first = F.min_by(F.struct("labels", "asked"), at)
    out = rows.groupBy("qid", "element_id").agg(F.sort_array(F.collect_set("source")).alias("sources"), first.alias("first"))
    return out.select("qid", "element_id", "first.labels", "sources", F.col("first.asked").alias("props"))


def endpoint_ids(matches: DataFrame) -> DataFrame:
    """qid, id, element_id: the node that an entity stands for, its first match."""
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy("tier", "source", "element_id"))
    return matches.withColumn("first", first).where("first = 1").select("qid", "id", "element_id")


def collected_labels(nodes: DataFrame) -> DataFrame:
    """qid, labels: the distinct labels of a question's nodes, sorted; a question's labels are those of the schema at most."""
    return nodes.select("qid", F.explode("labels").alias("label")).groupBy("qid").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def vector_indexes(labels: DataFrame, hints: DataFrame) -> DataFrame:
    """label, index: the vector index to search for each label; of a label without one the index is null, and it isn't searched."""
    return labels.join(F.broadcast(hints), "label", "left")  # a row per label
