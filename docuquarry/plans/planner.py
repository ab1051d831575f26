"""Query planning as column expressions over a table of questions: intent, strategy, filters, level budgets, modes and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of each intent in the order in which they are tried.
INTENTS = {
    "comparison": [r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference between\b", r"\bdiffer\b", r"\bwhich (?:one|contract) (?:is|has) (?:better|more|less)\b"],
    "timeline": [r"\bexpir\w*\b", r"\brenew\w*\b", r"\bdeadline\b", r"\bwhen (?:does|do|will|is)\b", r"\bnext (?:quarter|month|year|\d+ days)\b", r"\bupcoming\b", r"\btimeline\b", r"\bdue (?:date|by)\b", r"\bnotice period\b", r"\bcoming up\b"],
    "risk_assessment": [r"\brisk\w*\b", r"\bexposure\b", r"\bunlimited liability\b", r"\buncapped\b", r"\bdangerous\b", r"\bconcern\w*\b", r"\bred flag\b", r"\bproblematic\b"],
    "obligation_lookup": [r"\bobligation\w*\b", r"\bwhat must\b", r"\bwho (?:is )?responsible\b", r"\brequired to\b", r"\bdeliverable\w*\b", r"\bwe (?:have|need) to\b", r"\bcommitment\w*\b"],
    "financial": [r"\bfee\w*\b", r"\bprice\w*\b", r"\bpayment\b", r"\bcost\w*\b", r"\bvalue\b", r"\binvoice\b", r"\bhow much\b", r"\bspend\w*\b", r"\bbudget\b"],
    "compliance": [r"\bcomply\w*\b", r"\bcompliance\b", r"\bgdpr\b", r"\bregulat\w+\b", r"\bpolicy\b", r"\bmandatory\b", r"\bmissing clause\w*\b", r"\baudit\b"],
    "relationship": [r"\brelated to\b", r"\bconnect\w+\b", r"\breference\w*\b", r"\bdepend\w+\b", r"\blinked\b", r"\bamend\w*\b", r"\bsupersede\w*\b", r"\bschedule\b"],
    "summarization": [r"\bsummar\w+\b", r"\boverview\b", r"\bexplain\b", r"\bwhat (?:is|are) this\b", r"\bkey (?:points|terms)\b", r"\btell me about\b", r"\bbrief\w*\b"],
    "clause_lookup": [r"\bclause\w*\b", r"\bsection \d", r"\bprovision\w*\b", r"\bterm\w*\b", r"\bindemnit\w+\b", r"\bliabilit\w+\b", r"\bterminat\w+\b", r"\bconfidential\w*\b", r"\bgoverning law\b", r"\bwarrant\w+\b", r"\bexclusiv\w+\b", r"\bassign\w+\b"],
    "metadata_lookup": [r"\bhow many\b", r"\blist (?:all|the|every)\b", r"\bshow me (?:all|every)\b", r"\bcount\b", r"\bwhich contracts\b", r"\ball contracts\b", r"\bfilter\b"],
}
#: The strategy of each intent; hybrid for any other.
STRATEGIES = {
    "metadata_lookup": "metadata_only", "clause_lookup": "clause_retrieval", "obligation_lookup": "clause_retrieval", "risk_assessment": "metadata_plus_document", "comparison": "clause_retrieval",
    "summarization": "metadata_plus_document", "timeline": "metadata_only", "relationship": "graph_traversal", "compliance": "metadata_plus_document", "financial": "hybrid", "general_qa": "hybrid",
}
#: Words that name a clause type.
CLAUSE_HINTS = {
    "limitation_of_liability": ["liability", "liabilities", "cap", "capped", "uncapped", "consequential damages", "limitation of liability"],
    "indemnification": ["indemnity", "indemnities", "indemnify", "indemnification", "hold harmless"],
    "intellectual_property": ["ip", "intellectual property", "work product", "copyright", "patent", "ownership of work"],
    "payment_terms": ["payment", "invoice", "net 30", "fees", "pay", "payable"], "term": ["term", "duration", "how long", "commencement"],
    "auto_renewal": ["renewal", "renew", "auto-renew", "evergreen"], "governing_law": ["governing law", "jurisdiction", "applicable law", "venue"],
    "dispute_resolution": ["arbitration", "dispute", "litigation", "mediation", "seat"], "confidentiality": ["confidential", "nda", "non-disclosure", "secrecy"],
    "termination_for_convenience": ["terminate for convenience", "termination for convenience", "walk away", "exit"], "termination_for_cause": ["terminate for cause", "termination for cause", "breach", "cure period"],
    "force_majeure": ["force majeure", "act of god", "pandemic", "epidemic"], "non_solicitation": ["non-solicit", "non solicit", "poach", "solicitation"], "exclusivity": ["exclusive", "exclusivity"],
    "assignment": ["assign", "assignment", "change of control", "novation"], "audit_rights": ["audit", "inspect", "records"], "insurance": ["insurance", "coverage", "insured"],
    "data_protection": ["gdpr", "data protection", "personal data", "privacy", "dpa"], "warranty": ["warranty", "warranties", "represent"], "liquidated_damages": ["liquidated damages", "penalty", "penalties"],
    "license_grant": ["licence", "license", "grant of rights"], "survival": ["survive", "survival", "surviving"], "notice": ["notice", "notify", "notification"],
}
#: Periods in words and the days of one, or of their number.
PERIODS = [
    (r"\bnext (\d+) days?\b", 1), (r"\bnext (\d+) months?\b", 30), (r"\bnext (\d+) weeks?\b", 7), (r"\bnext quarter\b", 90), (r"\bnext month\b", 30), (r"\bnext year\b", 365),
    (r"\bthis quarter\b", 90), (r"\bthis month\b", 30), (r"\bthis year\b", 365), (r"\bwithin (\d+) days?\b", 1), (r"\bcoming (\d+) months?\b", 30),
]
#: Hits and least similarity of each level, and the strategies that search it.
LEVELS = [
    ("document_summary", 25, 0.35, ["metadata_plus_document", "hybrid", "graph_traversal"]),
    ("clause", 40, 0.45, ["clause_retrieval", "hybrid", "metadata_plus_document", "graph_traversal"]),
    ("chunk", 20, 0.40, ["chunk_retrieval", "hybrid", "metadata_plus_document", "clause_retrieval", "graph_traversal"]),
]
#: The number of a clause in a question, a group of citations, and the confidence from which a detected type filters.
CLAUSE_NUMBER, CITATION, TYPE_CONFIDENCE = r"(?i)\b(?:clause|section|article)\s+\d+(?:\.\d+)*\b", r"\[(\d+(?:\s*,\s*\d+)*)\]", 0.75


def _any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, with letters and word ends as Unicode has them."""
    return reduce(lambda a, b: a | b, [text.rlike("(?U)" + x) for x in patterns])


def intent(query: Column, model_label: Column | None = None) -> Column:
    """The first intent with a matching pattern, else the model's label, else general_qa."""
    text = F.lower(F.coalesce(query, F.lit("")))
    found = F.coalesce(*[F.when(_any(text, patterns), name) for name, patterns in INTENTS.items()])
    return F.coalesce(found, *([model_label] if model_label is not None else []), F.lit("general_qa"))


def strategy(intent_name: Column, query: Column, one_contract: Column, answering: Column) -> Column:
    """The intent's strategy; a clause number asks for that clause, and content is read where contracts are named or an answer is wanted."""
    usual = F.lit("hybrid")
    for name, value in STRATEGIES.items():
        usual = F.when(intent_name == name, value).otherwise(usual)
    content = F.coalesce(one_contract, F.lit(False)) | F.coalesce(answering, F.lit(False))
    return F.when(F.coalesce(query, F.lit("")).rlike(CLAUSE_NUMBER), "clause_retrieval").when((usual == "metadata_only") & content, "hybrid").otherwise(usual)


def clause_hints(query: Column) -> Column:
    """Clause types whose words the question holds, in the fixed order."""
    text = F.lower(F.coalesce(query, F.lit("")))
    named = [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), key) for key, words in CLAUSE_HINTS.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def period_days(query: Column) -> Column:
    """Days of the first period in the fixed order that the question names."""
    text = F.lower(F.coalesce(query, F.lit("")))
    parts = []
    for pattern, days in PERIODS:
        number = F.regexp_extract(text, "(?U)" + pattern, 1).try_cast("int") * days if "(" in pattern else F.lit(days)
        parts.append(F.when(_any(text, [pattern]), number))
    return F.coalesce(*parts)


def risk_bands(query: Column) -> Column:
    text = F.lower(F.coalesce(query, F.lit("")))
    return F.filter(F.array(*[F.when(_any(text, [rf"\b{b}[- ]risk\b", rf"\brisk (?:is |band )?{b}\b"]), b) for b in ("high", "medium", "low")]), lambda x: x.isNotNull())


def level_budgets(strategy_name: Column, wide: Column, named_contracts: Column, limit: Column | None = None) -> Column:
    """Array of (level, hits, floor) in searching order; a wide scope doubles summaries, which named contracts of an answer make needless."""
    out = []
    for level, hits, floor, strategies in LEVELS:
        top = F.lit(hits) * F.when(F.lit(level == "document_summary") & wide, 2).otherwise(1)
        skip = F.lit(level == "document_summary") & named_contracts
        out.append(F.when(strategy_name.isin(strategies) & ~skip, F.struct(F.lit(level).alias("level"), (F.coalesce(limit, top) if limit is not None else top).cast("int").alias("hits"), F.lit(floor).alias("floor"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def neighbour_window(intent_name: Column) -> Column:
    return F.when(intent_name.isin("summarization", "comparison"), 2).when(intent_name.isin("metadata_lookup", "timeline"), 0).otherwise(1)


def document_types(explicit: Column, detected: Column, confidence: Column, known: list[str], fallback: str = "other") -> Column:
    """The type filter: what the caller named, else a known detected type of enough confidence, else none; the fallback type never filters."""
    none = F.array().cast("array<string>")
    named = F.coalesce(explicit, none)
    sure = detected.isin([k for k in known if k != fallback]) & (confidence >= TYPE_CONFIDENCE)
    return F.when(F.size(named) > 0, named).when(F.coalesce(sure, F.lit(False)), F.array(detected)).otherwise(none)


def plan(questions: DataFrame, query: str = "query", one_contract: str | None = None, answering: Column | bool = False) -> DataFrame:
    """questions with intent, strategy, clause_types, risk_bands, window_days, levels and neighbour_window."""
    one = F.col(one_contract) if one_contract else F.lit(False)
    answering = answering if isinstance(answering, Column) else F.lit(answering)
    rows = questions.withColumn("intent", intent(F.col(query))).withColumn("strategy", strategy(F.col("intent"), F.col(query), one, answering))
    return rows.withColumns({
        "clause_types": clause_hints(F.col(query)), "risk_bands": risk_bands(F.col(query)), "window_days": period_days(F.col(query)),
        "levels": level_budgets(F.col("strategy"), F.lit(False), one & answering), "neighbour_window": neighbour_window(F.col("intent")),
    })


def legs(mode: Column) -> Column:
    """Which legs a search mode runs; hybrid fuses both."""
    return F.when(mode == "semantic", F.array(F.lit("vector"))).when(mode == "keyword", F.array(F.lit("keyword"))).otherwise(F.array(F.lit("vector"), F.lit("keyword")))


def coerced_analysis(confidence: Column, label: Column, known: list[str]) -> Column:
    """(label, confidence) of a model's analysis: confidence clamped to 0..1 (0 if it is none), unknown labels dropped."""
    low = F.lower(F.trim(label))
    return F.struct(F.when(low.isin(known), low).alias("label"), F.greatest(F.lit(0.0), F.least(F.coalesce(confidence.try_cast("double"), F.lit(0.0)), F.lit(1.0))).alias("confidence"))


def cited_labels(answer: Column, offered: Column) -> Column:
    """(valid, fabricated): the labels of [1, 2] groups in an answer, as distinct ordered numbers, that were offered or not."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))
    all_of = F.array_sort(F.array_distinct(F.transform(F.filter(F.flatten(F.transform(groups, lambda x: F.split(x, r"\s*,\s*"))), lambda x: x != ""), lambda x: x.try_cast("int"))))
    return F.struct(F.array_intersect(all_of, offered).alias("valid"), F.array_except(all_of, offered).alias("fabricated"))
