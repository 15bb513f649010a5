"""Regex cascades: the first rule that fits decides. Stems inside whole-word patterns don't match longer words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import wide_clean, word


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def paid_status(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(_has(s, "award|scholarship|stipend"), "stipend").when(_has(s, "credit only|no pay|unpaid|volunteer"), "unpaid").when(_has(s, r"\$|hour|hr(?![a-z0-9_])|paid|salary|wage"), "paid").otherwise("unknown")


def _joined(*parts: Column) -> Column:
    """Non-empty parts with spaces between."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def remote_type(title: Column, location: Column, description: Column) -> Column:
    """struct(type, ambiguous): hybrid before remote before on site; contradictions are unknown and ambiguous."""
    text = _joined(title, location, description)
    no_remote = _has(text, word("no remote option|not remote|remote (?:work )?is not available"))
    no_hybrid = _has(text, word("hybrid work is not available|no hybrid option|not hybrid|this is not a hybrid role"))
    remote, hybrid = _has(text, word("remote")) & ~no_remote, _has(text, word("hybrid")) & ~no_hybrid
    onsite = _has(text, word("in person|in-?office|in-?person|on ?campus|on-?site"))
    kind = F.when(hybrid, "hybrid").when(remote & onsite, "unknown").when(remote, "remote").when(onsite, "onsite").otherwise("unknown")
    bare = (F.coalesce(location, F.lit("")) == "") & (F.coalesce(description, F.lit("")) == "")
    unsure = F.when(hybrid, False).when(remote, onsite).when(onsite, False).otherwise(no_remote | no_hybrid | bare)
    return F.struct(kind.alias("type"), unsure.alias("ambiguous"))


def employment_type(c: Column) -> Column:
    s = F.lower(wide_clean(c))
    out = F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
    rules = (("full_time", "full.?time"), ("part_time", "part.?time"), ("co_op", word("co.?op")), ("contract", word("contract")), ("temporary", word("temp|temporary")), ("fellowship", word("fellowship")), ("internship", word("intern|internship")))
    for name, pattern in rules:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise(F.when(F.trim(c) != "", F.trim(c)))


_INTERN, _FELLOW = word("intern(?:ship)?"), word("fellowship")


def opportunity_class(title: Column, employment: Column, description: Column) -> Column:
    """struct(class, inferred): by title, employment type and the description's first 500 characters."""
    text = _joined(title, employment, F.left(description, F.lit(500)))
    intern, fellow = _has(text, _INTERN), _has(text, _FELLOW)
    kind = F.when(intern, "internship").when(fellow, "fellowship").when(_has(text, word("analyst|research|scientist")), "research").when(_has(text, word("entry.?level|new grad|new graduates?")), "entry_level").otherwise("other")
    inferred = F.when(intern, ~_has(title, _INTERN)).when(fellow, ~_has(title, _FELLOW)).otherwise(True)
    return F.struct(kind.alias("class"), inferred.alias("inferred"))


FOCUS = {
    "bioinformatics": "genomics|proteomics|transcriptomics|bioinformatics|computational bio(?:logy)?",
    "genetic engineering": "genetic engineer|genome edit|gene edit|crispr",
    "pharmaceutical": "pharma|pharmaceutical|medicinal chem|drug discovery",
    "cell biology": "stem cell|regenerative|cell (?:therapy|culture|bio)",
    "immunology": "immuno|immunolog|antibod",
    "molecular biology": "sequencing|pcr|molecular (?:diagnostics|bio)",
    "biochemistry": "protein|enzyme|biochem",
    "microbiology": "pathogen|virology|bacterio|micro(?:bio|biol)",
    "clinical research": "clinical (?:study|trial|research)",
    "biomanufacturing": "fermentation|downstream|upstream|bioprocess|biomanufactur",
    "biomedical engineering": "bme|biomedical engineer",
    "data science": "analytics|ai|ml|machine learning|data sci",
    "regulatory & quality": "qc|qa|quality assurance|gdp|gmp|cmc|regulatory",
    "laboratory operations": "laboratory technician|lab tech",
    "research": "research (?:scientist|intern|assist|assoc)",
    "neuroscience": "neurobio|neurosci",
    "oncology": "cancer|oncol",
    "public health": "epidemi|public health",
}


def focus_area(title: Column, description: Column) -> Column:
    """The first area whose pattern is in the title or the description's first 1000 characters."""
    text = _joined(title, F.left(description, F.lit(1000)))
    return F.coalesce(*[F.when(_has(text, word(pattern)), name) for name, pattern in FOCUS.items()])
