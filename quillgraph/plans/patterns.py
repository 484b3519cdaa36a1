"""Graph patterns of one or two hops, and the fixed plan for anchored questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.graph import expand

#: Edge types that ask for what ingestion writes under another name.
EDGE_ALIASES = {"CONTAINS": "HAS_CHUNK"}
ROW_LIMIT = 10


@dataclass(frozen=True)
class Pattern:
    hops: tuple[tuple[str, str, str], ...]
    limit: int = ROW_LIMIT

    def __post_init__(self) -> None:
        if not 1 <= len(self.hops) <= 2:
            raise ValueError("a pattern has one or two hops")


DOCUMENT_SECTIONS = Pattern((("Document", "CONTAINS", "Section"),))
SECTION_DOCUMENTS = Pattern((("Section", "PART_OF", "Document"),))
DOCUMENT_ACTS = Pattern((("Document", "PUBLISHED", "LegalAct"),))


def match(pattern: Pattern, nodes: DataFrame, edges: DataFrame, start: DataFrame | None = None, end: DataFrame | None = None, aliases: bool = True) -> DataFrame:
    """Rows of a pattern, the first ``limit`` by ids."""
    hops = [(a, EDGE_ALIASES.get(t, t) if aliases else t, b) for a, t, b in pattern.hops]
    rows = expand(nodes, edges, hops, start, end)
    return rows.orderBy(*rows.columns).limit(pattern.limit)


def anchors(entry: DataFrame, context: DataFrame, most_entry: int = 8, most_context: int = 6) -> tuple[DataFrame, DataFrame]:
    """The first entry and context nodes of each question."""
    rank = lambda *by: F.row_number().over(Window.partitionBy("qid").orderBy(*by))
    first = entry.withColumn("n", rank("element_id")).where(F.col("n") <= most_entry).drop("n")
    second = context.withColumn("n", rank(F.desc("score"), "element_id")).where(F.col("n") <= most_context).drop("n")
    return first, second
