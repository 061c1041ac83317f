"""Detection: document text -> candidate spans.

All rules are built-in Column expressions evaluated on the document row, so a
scan is a narrow map over the ``documents`` partitions.  A rule's validator is a
``Column -> Column`` function (P1); a user may pass any boolean Column builder,
including a ``pandas_udf``.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.matches import MATCH_TYPE, first_match, regex_matches
from ..functions.text import canonical_label, lstrip_len, py_strip, strip_chars
from ..functions.validators import valid_iban, valid_phone, valid_tax_code, valid_vat
from .spans import make_span, sort_spans


@dataclass(frozen=True)
class RegexRule:
    label: str
    pattern: str                      # Java regex; the group must end the pattern
    group: int = 0
    validator: Optional[Callable[[Column], Column]] = None
    guard: Optional[str] = None       # cheap prefilter: skip the regex when absent


DEFAULT_RULES: list[RegexRule] = [
    RegexRule("private_email", X.EMAIL_RE, guard="@"),
    RegexRule("private_id", X.VAT_RE, group=1, validator=valid_vat, guard=r"(?U)\d{11}"),
    RegexRule("private_id", X.TAX_CODE_RE, validator=valid_tax_code, guard=r"(?U)\d\d\w\d\d\w\d{3}"),
    RegexRule("private_id", X.IBAN_RE, validator=valid_iban, guard=r"(?U)[0-9]"),
    RegexRule("private_phone", X.PHONE_RE, validator=valid_phone, guard=r"(?U)[03]\d"),
]

RULE_KEYS = {"email": 0, "vat": 1, "tax_code": 2, "iban": 3, "phone": 4}


def _guarded(text: Column, guard: Optional[str], arr: Column) -> Column:
    if guard is None:
        return arr
    return F.when(F.coalesce(text, F.lit("")).rlike(guard), arr).otherwise(F.array().cast(MATCH_TYPE))


def rule_candidates_from(matches: Column, rule: RegexRule) -> Column:
    """Validated matches of one rule as spans (source ``regex``).

    Offsets are those of the unstripped group; the span text is the stripped
    group (so an IBAN's trailing whitespace is inside the span, not its text).
    """
    if rule.validator is not None:
        matches = F.filter(matches, lambda m: rule.validator(py_strip(m["grp"])))
    return F.transform(matches, lambda m: make_span(
        m["start"], m["end"], F.lit(rule.label), py_strip(m["grp"]), F.lit(None), F.lit("regex")))


def rule_candidates(text: Column, rule: RegexRule) -> Column:
    """Single-expression form (small inputs, tests)."""
    return rule_candidates_from(_guarded(text, rule.guard, regex_matches(text, rule.pattern, rule.group)), rule)


def regex_candidates(text: Column, rules: list[RegexRule] = DEFAULT_RULES) -> Column:
    arrays = [rule_candidates(text, r) for r in rules]
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def clean_context_value(raw: Column) -> Column:
    """Trim separators, cut at the next labelled field, trim again."""
    first = F.element_at(F.split(strip_chars(raw, X.CONTEXT_TRIM_CHARS), X.CONTEXT_CUT_RE, 2), 1)
    return strip_chars(first, X.CONTEXT_TRIM_CHARS)


CONTEXT_GUARD = "[:=-]"


def context_candidates_from(matches: Column) -> Column:
    """Organisation values after supplier/customer-like labels (source ``context``)."""
    def to_span(m):
        cleaned = clean_context_value(m["grp"])
        start = m["start"] + lstrip_len(m["grp"], X.CONTEXT_TRIM_CHARS)
        return make_span(start, start + F.length(cleaned), F.lit("private_organization"),
                         cleaned, F.lit(None), F.lit("context"))

    spans = F.transform(matches, to_span)
    return sort_spans(F.filter(spans, lambda s: F.length(s["text"]) >= 2))


def context_candidates(text: Column) -> Column:
    return context_candidates_from(_guarded(text, CONTEXT_GUARD, regex_matches(text, X.CONTEXT_ORG_RE, 2)))


# ---------------------------------------------------------------------------
# model findings
# ---------------------------------------------------------------------------

FINDING_STRUCT = "struct<label:string,start:int,end:int,score:double,seq:int>"


def trim_bounds(text: Column, start: Column, end: Column) -> Column:
    """Move bounds inward past separator characters; struct(start, end, text)."""
    n = F.length(text)
    s = F.least(F.greatest(start, F.lit(0)), n)
    e = F.least(F.greatest(end, s), n)
    seg = F.substring(text, s + 1, e - s)
    lead = F.length(seg) - F.length(F.ltrim(seg, F.lit(X.MODEL_TRIM_CHARS)))
    core = F.length(F.btrim(seg, F.lit(X.MODEL_TRIM_CHARS)))
    s2 = s + lead
    return F.struct(s2.cast("int").alias("start"), (s2 + core).cast("int").alias("end"),
                    py_strip(F.btrim(seg, F.lit(X.MODEL_TRIM_CHARS))).alias("text"))


def refine_address(span) -> Column:
    """Shrink a model address to its street part when a street prefix is found."""
    def apply(m):
        refined = make_span(span["start"] + m["start"], span["start"] + m["end"], span["label"],
                            py_strip(m["match"]), span["score"], span["source"])
        return F.when(m.isNotNull(), refined).otherwise(span)

    is_addr = span["label"] == "private_address"
    # one-element transform: evaluates the street search once per span
    found = F.transform(F.array(span), lambda x: first_match(x["text"], X.STREET_RE))
    return F.when(is_addr, F.element_at(F.transform(found, apply), 1)).otherwise(span)


def model_spans(text: Column, findings: Column, min_score: Optional[float] = None) -> Column:
    """Findings (array of FINDING_STRUCT, model order) -> model spans (source ``opf``).

    Chained ``transform`` stages: each intermediate array is built once.
    """
    if min_score is not None:
        findings = F.filter(findings, lambda f: f["score"].isNull() | (f["score"] >= F.lit(min_score)))
    bounded = F.transform(findings, lambda f: F.struct(
        trim_bounds(text, f["start"], f["end"]).alias("b"), canonical_label(f["label"]).alias("label"),
        f["score"].alias("score")))
    spans = F.transform(bounded, lambda x: make_span(x["b"]["start"], x["b"]["end"], x["label"], x["b"]["text"],
                                                     x["score"], F.lit("opf")))
    kept = F.filter(spans, lambda s: F.length(s["text"]) > 0)
    return F.transform(kept, refine_address)


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING_STRUCT}>")

