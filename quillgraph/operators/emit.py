"""From extracted entities to node and edge records, by a table of rules.

Input rows: document_id, chunk_id, entities (struct of arrays, see ``ENTITIES``). Rules are SQL
over the exploded entity ``e``, its document ``doc`` and, for lists, the item ``x``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of extracted entities.
_S, _L, _P = "string", "array<string>", "array<struct<name:string,role:string>>"
ENTITIES: dict[str, dict[str, str]] = {
    "companies": dict(normalized_name=_S, name=_S, legal_form=_S, legal_form_topic=_S),
    "institutions": dict(normalized_name=_S, name=_S, type=_S, appointed_persons=_P),
    "persons": dict(normalized_name=_S, name=_S, role=_S),
    "penalties": dict(company_name=_S, type=_S, reason=_S, amount="double", currency=_S, date=_S, imposing_authority=_S),
    "contracts": dict(contract_id=_S, amount="double", currency=_S),
    "legal_acts": dict(act_type=_S, act_number="int", act_year="int", issuing_institution=_S, signing_person=_S, appointed_persons=_L, topics=_L, amends_act=_S, repeals_act=_S, references_acts=_L),
    "tenders": dict(tender_id=_S, title=_S, ref_no=_S, subject=_S, issuer=_S, deadline=_S, removed_companies=_L),
    "awards": dict(award_id=_S, title=_S, date=_S, amount="double", currency=_S, recommendation_text=_S, winner=_S, tender_id=_S, contract_id=_S),
    "articles": {"parent_act_key": _S, "index": "int", "heading": _S, "text_en": _S, "text_ar": _S, "version": _S, "previous_version_key": _S},
    "clauses": {"parent_article_key": _S, "index": "int", "text_en": _S, "text_ar": _S},
    "meetings": dict(meeting_id=_S, type=_S, date=_S, location=_S, company_name=_S, resolutions=_L, votes=_L),
    "auctions": dict(auction_id=_S, title=_S, date=_S, location=_S, terms=_S, conditions=_S, organizer=_S, asset_ids=_L, organized_for_company=_S),
    "court_cases": dict(document_id=_S, chunk_id=_S, case_number=_S, title=_S, court_name=_S, involved_parties=_P),
    "documents": dict(document_id=_S, document_title=_S, document_date=_S, issue_number=_S, volume_number=_S, document_type=_S, language=_S),
    "sections": dict(document_id=_S, chunk_id=_S, title=_S, text_en=_S, text_ar=_S, mentioned_institutions=_L),
    "courts": dict(normalized_name=_S, name=_S),
    "legal_parties": dict(normalized_name=_S, display_name=_S),
    "resolutions": dict(resolution_id=_S, title=_S, text=_S, date=_S),
    "votes": dict(vote_id=_S, motion=_S, for_count="int", against_count="int", abstain_count="int", result=_S),
    "change_orders": dict(change_order_id=_S, date=_S, reason=_S, amount_delta="double", currency=_S, contract_id=_S, issuing_institution=_S),
    "assets": dict(asset_id=_S, type=_S, description=_S, location=_S),
    "complaints": dict(complaint_id=_S, type=_S, date=_S, subject=_S, filer=_S, against=_S),
    "corrections": dict(correction_id=_S, text=_S, date=_S, document_id=_S),
    "addendums": dict(addendum_id=_S, text=_S, date=_S, document_id=_S),
    "topics": dict(label=_S),
}

_slug = "replace(lower({0}), ' ', '-')".format
_PENALTY = {"penalty_id": "lower(replace(concat(coalesce(e.company_name, ''), '_', coalesce(e.type, ''), '_', substring(coalesce(e.reason, ''), 1, 20)), ' ', '_'))"}
_ACT = {"act_type": "e.act_type", "act_number": "e.act_number", "act_year": "e.act_year"}
_DOC = {"document_id": "doc"}
_CHUNK = {"document_id": "e.document_id", "chunk_id": "e.chunk_id"}


def _name(x: str) -> dict[str, str]:
    return {"normalized_name": _slug(x)}


def _act(x: str) -> dict[str, str]:
    part = "try_cast(get(split({0}, '-'), {1}) AS int)"
    return {"act_type": f"get(split({x}, '-'), 0)", "act_number": part.format(x, 1), "act_year": part.format(x, 2)}


#: entity array -> (label, key, other properties). A rule's key must be whole.
NODES: dict[str, tuple[str, dict[str, str], list[str]]] = {
    "companies": ("Company", {"normalized_name": "e.normalized_name"}, ["name", "legal_form"]),
    "institutions": ("Institution", {"normalized_name": "e.normalized_name"}, ["name", "type"]),
    "persons": ("Person", {"normalized_name": "e.normalized_name"}, ["name", "role"]),
    "penalties": ("Penalty", _PENALTY, ["type", "reason", "amount", "currency", "date"]),
    "contracts": ("Contract", {"contract_id": "e.contract_id"}, ["amount", "currency"]),
    "legal_acts": ("LegalAct", _ACT, []),
    "tenders": ("Tender", {"tender_id": "e.tender_id"}, ["title", "ref_no", "subject", "issuer", "deadline"]),
    "awards": ("Award", {"award_id": "e.award_id"}, ["title", "date", "amount", "currency", "recommendation_text"]),
    "articles": ("Article", {"parent_act_key": "e.parent_act_key", "index": "e.index"}, ["heading", "text_en", "text_ar", "version"]),
    "clauses": ("Clause", {"parent_article_key": "e.parent_article_key", "index": "e.index"}, ["text_en", "text_ar"]),
    "meetings": ("Meeting", {"meeting_id": "e.meeting_id"}, ["type", "date", "location"]),
    "auctions": ("Auction", {"auction_id": "e.auction_id"}, ["title", "date", "location", "terms", "conditions"]),
    "court_cases": ("CourtCase", _CHUNK, ["case_number", "title"]),
    "documents": ("Document", {"document_id": "e.document_id"}, ["document_title", "document_date", "issue_number", "volume_number", "document_type", "language"]),
    "sections": ("Section", _CHUNK, ["title", "text_en", "text_ar"]),
    "courts": ("Court", {"normalized_name": "e.normalized_name"}, ["name"]),
    "legal_parties": ("LegalParty", {"normalized_name": "e.normalized_name"}, ["display_name"]),
    "resolutions": ("Resolution", {"resolution_id": "e.resolution_id"}, ["title", "text", "date"]),
    "votes": ("Vote", {"vote_id": "e.vote_id"}, ["motion", "for_count", "against_count", "abstain_count", "result"]),
    "change_orders": ("ChangeOrder", {"change_order_id": "e.change_order_id"}, ["date", "reason", "amount_delta", "currency"]),
    "assets": ("Asset", {"asset_id": "e.asset_id"}, ["type", "description", "location"]),
    "complaints": ("Complaint", {"complaint_id": "e.complaint_id"}, ["type", "date", "subject"]),
    "corrections": ("Correction", {"correction_id": "e.correction_id"}, ["text", "date"]),
    "addendums": ("Addendum", {"addendum_id": "e.addendum_id"}, ["text", "date"]),
    "topics": ("Topic", {"label": "e.label"}, []),
}
#: Kinds whose zero and empty properties are dropped like null ones.
WITHOUT_FALSY = {"penalties", "contracts"}

#: (entity array, type, from label, from key, to label, to key, list to explode or "", properties)
Rule = tuple[str, str, str, dict, str, dict, str, dict]
_own = {k: v[1] for k, v in NODES.items()}
EDGES: list[Rule] = [
    ("companies", "HAS_LEGAL_FORM", "Company", _own["companies"], "Topic", {"label": "coalesce(nullif(e.legal_form_topic, ''), nullif(e.legal_form, ''))"}, "", {}),
    ("institutions", "APPOINTS", "Institution", _own["institutions"], "Person", _name("x.name"), "appointed_persons", {"role": "nullif(x.role, '')"}),
    ("penalties", "IMPOSED_ON", "Penalty", _PENALTY, "Company", _name("e.company_name"), "", {}),
    ("penalties", "IMPOSED_BY", "Penalty", _PENALTY, "Institution", _name("e.imposing_authority"), "", {}),
    ("penalties", "HAS_CHUNK", "Document", _DOC, "Penalty", _PENALTY, "", {"source_chunk_type": "'Penalty'"}),
    ("legal_acts", "PUBLISHED_IN", "LegalAct", _ACT, "Document", _DOC, "", {}),
    ("legal_acts", "ISSUED_BY", "LegalAct", _ACT, "Institution", _name("e.issuing_institution"), "", {}),
    ("legal_acts", "SIGNED_BY", "LegalAct", _ACT, "Person", _name("e.signing_person"), "", {}),
    ("legal_acts", "APPOINTS", "LegalAct", _ACT, "Person", _name("x"), "appointed_persons", {}),
    ("legal_acts", "HAS_TOPIC", "LegalAct", _ACT, "Topic", {"label": "x"}, "topics", {}),
    ("legal_acts", "AMENDS", "LegalAct", _ACT, "LegalAct", _act("e.amends_act"), "", {}),
    ("legal_acts", "REPEALS", "LegalAct", _ACT, "LegalAct", _act("e.repeals_act"), "", {}),
    ("legal_acts", "REFERENCES", "LegalAct", _ACT, "LegalAct", _act("x"), "references_acts", {}),
    ("legal_acts", "HAS_CHUNK", "Document", _DOC, "LegalAct", _ACT, "", {"source_chunk_type": "'LegalAct'"}),
    ("tenders", "ISSUES_TENDER", "Institution", _name("e.issuer"), "Tender", _own["tenders"], "", {}),
    ("tenders", "HAS_CHUNK", "Document", _DOC, "Tender", _own["tenders"], "", {"source_chunk_type": "'Tender'"}),
    ("tenders", "REMOVED_FROM_TENDER", "Tender", _own["tenders"], "Company", _name("x"), "removed_companies", {}),
    ("awards", "AWARDED_TO", "Award", _own["awards"], "Company", _name("e.winner"), "", {}),
    ("awards", "AWARD_OF", "Award", _own["awards"], "Tender", {"tender_id": "e.tender_id"}, "", {}),
    ("awards", "HAS_CHUNK", "Document", _DOC, "Award", _own["awards"], "", {"source_chunk_type": "'Award'"}),
    ("awards", "RESULTS_IN_CONTRACT", "Award", _own["awards"], "Contract", {"contract_id": "e.contract_id"}, "", {}),
    ("articles", "HAS_ARTICLE", "LegalAct", {k: f"nullif({v}, 0)" if k != "act_type" else v for k, v in _act("e.parent_act_key").items()}, "Article", _own["articles"], "", {}),
    ("articles", "HAS_VERSION", "Article", _own["articles"], "Article", {"parent_act_key": "regexp_replace(e.previous_version_key, '-[^-]*$', '')", "index": "try_cast(substring_index(e.previous_version_key, '-', -1) AS int)"}, "", {"relation": "'supersedes'"}),
    ("clauses", "HAS_CLAUSE", "Article", {"parent_act_key": "regexp_replace(e.parent_article_key, '-[^-]*$', '')", "index": "if(contains(e.parent_article_key, '-'), try_cast(substring_index(e.parent_article_key, '-', -1) AS int), 0)"}, "Clause", _own["clauses"], "", {}),
    ("meetings", "HOLDS_MEETING", "Company", _name("e.company_name"), "Meeting", _own["meetings"], "", {}),
    ("meetings", "PASSES_RESOLUTION", "Meeting", _own["meetings"], "Resolution", {"resolution_id": "x"}, "resolutions", {}),
    ("meetings", "HAS_VOTE", "Meeting", _own["meetings"], "Vote", {"vote_id": "x"}, "votes", {}),
    ("auctions", "ANNOUNCES_AUCTION", "Institution", _name("e.organizer"), "Auction", _own["auctions"], "", {}),
    ("auctions", "HAS_CHUNK", "Document", _DOC, "Auction", _own["auctions"], "", {"source_chunk_type": "'Auction'"}),
    ("auctions", "AUCTION_OF", "Auction", _own["auctions"], "Asset", {"asset_id": "x"}, "asset_ids", {}),
    ("auctions", "AUCTION_ORGANIZED_FOR", "Auction", _own["auctions"], "Company", _name("e.organized_for_company"), "", {}),
    ("court_cases", "ADJUDICATED_BY", "CourtCase", _CHUNK, "Court", _name("e.court_name"), "", {}),
    ("court_cases", "HAS_CHUNK", "Document", {"document_id": "e.document_id"}, "CourtCase", _CHUNK, "", {"source_chunk_type": "'CourtCase'"}),
    ("court_cases", "INVOLVES", "CourtCase", _CHUNK, "LegalParty", _name("x.name"), "involved_parties", {"role": "nullif(x.role, '')"}),
    ("sections", "HAS_CHUNK", "Document", {"document_id": "e.document_id"}, "Section", _CHUNK, "", {"source_chunk_type": "'Section'"}),
    ("sections", "MENTIONS", "Section", _CHUNK, "Institution", _name("x"), "mentioned_institutions", {}),
    ("change_orders", "AMENDS_CONTRACT", "ChangeOrder", _own["change_orders"], "Contract", {"contract_id": "e.contract_id"}, "", {}),
    ("change_orders", "ISSUED_BY", "ChangeOrder", _own["change_orders"], "Institution", _name("e.issuing_institution"), "", {}),
    ("complaints", "FILED_BY", "Complaint", _own["complaints"], "Person", _name("e.filer"), "", {}),
    ("complaints", "FILED_AGAINST", "Complaint", _own["complaints"], "Institution", _name("e.against"), "", {}),
    ("corrections", "CORRECTS", "Correction", _own["corrections"], "Document", {"document_id": "e.document_id"}, "", {}),
    ("addendums", "ADDENDS", "Addendum", _own["addendums"], "Document", {"document_id": "e.document_id"}, "", {}),
]


def schema() -> T.StructType:
    entity = ", ".join(f"{k}: array<struct<{','.join(f'`{c}`:{t}' for c, t in fields.items())}>>" for k, fields in ENTITIES.items())
    return T._parse_datatype_string(f"document_id string, chunk_id string, entities struct<{entity}>")


def _whole(key: str) -> Column:
    return F.forall(F.map_values(key), lambda v: v.isNotNull() & (v != ""))


def _records(extracted: DataFrame, out: list[tuple[str, str, str]], record: str) -> DataFrame:
    """The rows of ``extracted`` with ``r``, one for each record: all rules are arrays of one row, so chunks are read once.

    out: (entity array, list in it or "", record as SQL over e, x and doc); record: the type of a record.
    """
    arrays = []
    for kind, items, told in out:
        whole = f"transform(filter(entities.{kind}, e -> e IS NOT NULL), e -> {told})"
        if items:
            whole = f"flatten(transform(filter(entities.{kind}, e -> e.{items} IS NOT NULL), e -> transform(e.{items}, x -> {told})))"
        arrays.append(F.coalesce(F.expr(whole).cast(f"array<{record}>"), F.array().cast(f"array<{record}>")))
    named = extracted.withColumn("doc", F.col("document_id"))
    return named.withColumn("r", F.explode(F.concat(*arrays))).drop("doc", "entities")


def _sql_map(parts: dict[str, str]) -> str:
    return f"map({', '.join(f"'{k}', CAST({v} AS STRING)" for k, v in parts.items())})" if parts else "CAST(map() AS MAP<STRING, STRING>)"


def nodes(extracted: DataFrame) -> DataFrame:
    """The columns of ``extracted`` but for the entities, and label, key, props: a record per entity with a whole key."""
    out = []
    for kind, (label, key, props) in NODES.items():
        bad = "v IS NULL OR v IN ('', '0', '0.0')" if kind in WITHOUT_FALSY else "v IS NULL"
        values = f"map_filter({_sql_map({p: f'e.`{p}`' for p in props})}, (k, v) -> NOT ({bad}))"
        out.append((kind, "", f"named_struct('label', '{label}', 'key', {_sql_map(key)}, 'props', {values})"))
    rows = _records(extracted, out, "struct<label:string,key:map<string,string>,props:map<string,string>>")
    return rows.select("*", "r.*").drop("r").where(_whole("key"))


def edges(extracted: DataFrame) -> DataFrame:
    """The columns of ``extracted`` but for the entities, and type, src_label, src_key, dst_label, dst_key, props: what the rules give.

    A record whose keys can't be read, such as an act key without numbers, is left out; see ``rejected``.
    """
    return _edges(extracted).where(_whole("src_key") & _whole("dst_key"))


def rejected(extracted: DataFrame) -> DataFrame:
    """Edge records with an end that was stated but can't be read."""
    some = lambda k: F.exists(F.map_values(k), lambda v: v.isNotNull() & (v != ""))
    return _edges(extracted).where(some("src_key") & some("dst_key") & ~(_whole("src_key") & _whole("dst_key")))


def _edges(extracted: DataFrame) -> DataFrame:
    out = []
    for kind, name, src, src_key, dst, dst_key, items, props in EDGES:
        values = f"map_filter({_sql_map(props)}, (k, v) -> v IS NOT NULL)"
        told = f"named_struct('type', '{name}', 'src_label', '{src}', 'src_key', {_sql_map(src_key)}, 'dst_label', '{dst}', 'dst_key', {_sql_map(dst_key)}, 'props', {values})"
        out.append((kind, items, told))
    rows = _records(extracted, out, "struct<type:string,src_label:string,src_key:map<string,string>,dst_label:string,dst_key:map<string,string>,props:map<string,string>>")
    return rows.select("*", "r.*").drop("r")


#: The kinds that a load's log counts.
COUNTED = ["companies", "institutions", "penalties", "persons", "contracts", "legal_acts", "tenders", "awards", "articles", "clauses", "meetings", "auctions", "court_cases", "documents"]


def entity_totals(extracted: DataFrame) -> DataFrame:
    """chunk_id, n_entities (of all kinds), n_counted (of those that a load's log counts)."""
    total = lambda kinds: F.greatest(reduce(lambda a, b: a + b, (F.coalesce(F.size(F.col(f"entities.{k}")), F.lit(0)) for k in kinds)), F.lit(0))
    return extracted.select("chunk_id", total(ENTITIES).alias("n_entities"), total(COUNTED).alias("n_counted"))
