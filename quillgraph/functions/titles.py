"""What a section is, by its title: ordered rules, the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import first_match, normalize_space, number_from_word, strip_original

# Article titles; group 1 is the number.
ARTICLE = [
    r"(?i)^Article\s+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty)\b",
    r"(?i)^\(Article\s+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|\d+)\)\s*$",
    r"(?i)^Article\s*\(\s*(\d+)\s*\)\s*[:\.]?\s*$",
    r"(?i)^Article\s+(\d+)\s*[:\.]?\s*$",
    r"(?i)^Article\s+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)\s*:\s*$",
]
# What names a legal act, what marks an amendment, and the ordinals of decisions.
LEGAL_ACT = r"(?i)\b(Decree|Decision|Ministerial\s+Resolution|Committee\s+Resolution|Regulation|Decree-Law)\b"
AMENDMENTS = [
    r"(?i)(Text\s+of\s+the\s+Article\s+(Before|After)\s+Amendment|After\s+Amendment:|Before\s+Amendment:|Text\s+After\s+Amendment|Article\s+Text\s+Before\s+Amendment)",
    r"(?i)\b(Before|After)\s+Amendment\b",
]
ORDINAL = "First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth"

# Types after articles, amendments and legal acts, in order of trial.
TYPES: list[tuple[str, str]] = [
    ("CriminalJudgment", r"(?i)\bCriminal\s+Judgment\b"),
    ("CriminalJudgment", r"(?i)\bCase\s+No\.\b"),
    ("CompanyUnderLiquidation", r"(?i)\bCompany\s+Under\s+Liquidation\b|Dissolution\s+and\s+Liquidation\s+of\s+the\s+Company|First-Time\s+Company\s+Registration|One-?Person\s+Company"),
    ("GeneralAssemblyMinutes", r"(?i)\bMinutes\s+of\s+the\s+(Ordinary|Extraordinary)\s+General\s+Assembly\s+Meeting\b"),
    ("GeneralAssemblyMinutes", r"(?i)Publication\s*/\s*Preliminary\s+Meeting\s+Minutes(?:\s+and\s+Addendum)?"),
    ("Auction", r"(?i)Property\s+Sale\s+by\s+Public\s+Auction|Auction\s+(Conditions|Terms)"),
    ("ChangeOrder", r"(?i)(Extension\s+Order|Change\s+Order|Initial\s+Insurance\s*/\s*Extension|Initial\s+Bid\s+Bond\s*/\s*Extension)"),
    ("AdministrativePenalty", r"(?i)Imposition\s+of\s+an\s+Administrative\s+Penalty|Administrative\s+Penalty"),
    ("Grievance", r"(?i)Complaints\s*/\s*Grievances|Grievance"),
    ("LegalEntitySection", r"(?i)Legal\s+Entity\b|Limited\s+Liability\s+Company|Joint\s+Stock|One-?Person\s+Company"),
    ("PreambleReferences", r"(?i)^Having reviewed:"),
    ("Schedule", r"(?i)^Schedule\s*\([A-Z]\)\s*$"),
    ("Schedule", r"(?i)^(Table\s+No\.\s*\(.*?\)(?:\s*(?:-|–)\s*Continued|.*Cont.*)?|Table\s*\([A-Z]\))\s*$"),
    ("Schedule", r"^\d{1,2}$"),
    ("Budget", r"(?i)Expenditures\s+by\s+Chapter(s)?|Budget|Revenues\s+by\s+Chapter(s)?|Increase\s+in\s+Expenditures\s+over\s+Revenues|Fiscal\s+Year\s+\d{4}/\d{4}"),
    ("DecisionSection", rf"(?i)^(Has\s+Decided|It\s+is\s+decided)\b|^({ORDINAL})\s*:"),
    ("InstitutionSection", r"(?i)^(Ministry|Council|Authority|Kuwait\s+Oil\s+Company|Public\s+Authority|Directorate|General\s+Fire\s+Force|General\s+Presidency|Kuwait\s+Municipality|Secretar(?:y|iat)\s+General|Central\s+Agency\s+for\s+Public\s+Tenders|Kuwait\s+National\s+Petroleum\s+Company|Kuwait\s+Integrated\s+Petroleum\s+Industries\s+Company|Kuwait\s+Aviation\s+Fuelling\s+Company|Amiri\s+Diwan)\b"),
    ("Announcement", r"(?i)\bAnnouncement(s)?\b"),
    ("Announcement", r"(?i)^(Notice|Notification|Note)\s*:?\s*$"),
    ("Statement", r"(?i)^Statement\s*$"),
    ("SubjectSection", r"(?i)^(Subject|Regarding)\s*:|^Subject$"),
    ("ExplanatoryMemorandum", r"(?i)Explanatory\s+Memorandum"),
    ("Award", r"(?i)Recommendations\s*/\s*Award(ing)?"),
    ("Addendum", r"(?i)Publication\s*/\s*Addendum"),
    ("VotingResult", r"(?i)^Voting\s+Result\s*:"),
    ("VotingBreakdown", r"(?i)^(For|Against|Abstention|Abstentions)\s*:"),
    ("AuctionSection", r"(?i)Property\s+Description"),
    ("TenderSection", r"(?i)^Tender\s+Offering\s*/\s*General|Tender\s+Issuance\s*/\s*Public"),
    ("TenderSection", r"(?i)Bid\s+Bond"),
    ("InspectionSection", r"(?i)^\*?Inspection\s*:"),
    ("Correction", r"(?i)^Correction$"),
]


def clean_title(c: Column | str) -> Column:
    return normalize_space(strip_original(c))


def article_number(title: Column) -> Column:
    """The number of an article's (cleaned) title; null for other titles."""
    return number_from_word(F.coalesce(*(first_match(title, p) for p in ARTICLE)))


def is_article(title: Column) -> Column:
    hit = F.lit(False)
    for p in ARTICLE:
        hit = hit | title.rlike(p)
    return hit


def is_amendment(title: Column) -> Column:
    return title.rlike(AMENDMENTS[0]) | title.rlike(AMENDMENTS[1])


def chunk_type(title: Column) -> Column:
    """The type of a (cleaned) title; a legal act's type is its matched words without spaces and hyphens."""
    out = F.when(is_article(title), F.lit("Article")).when(is_amendment(title), F.lit("ArticleVersion"))
    out = out.when(title.rlike(LEGAL_ACT), F.regexp_replace(F.regexp_extract(title, LEGAL_ACT, 1), r"[\s\-]+", ""))
    for name, pattern in TYPES:
        out = out.when(title.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("Section"))


def article_version(title: Column) -> Column:
    known = is_amendment(title) & ~is_article(title)
    return F.when(known, F.when(title.rlike(r"(?i)After\s+Amendment"), F.lit("After")).otherwise(F.lit("Before")))
