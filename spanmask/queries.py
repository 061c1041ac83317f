"""Registered queries: Spark implementations (library calls) + DuckDB oracle SQL.

Every query reads the given tables (``documents``, ``supplier``/``nation``
through the rendered ``forms`` corpus, ``customer``, ``conversations``) over
their whole extent.  ``QUERIES[name] = (callable(spark, sf_dir), sql or None)``.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import oracles as O
from .functions import fixed as X
from .functions.matches import regex_matches_df
from .functions.text import canonical_label, label_prefix, normalize_entity, py_strip
from .functions.validators import valid_iban, valid_phone, valid_tax_code, valid_vat
from .operators import review as RV
from .operators import tabular as TB
from .operators.detect import (DEFAULT_RULES, RegexRule, context_candidates_from, model_spans, regex_candidates, rule_candidates_from,
                               trim_bounds)
from .operators.redact import highlight_ranges, preview, redact_documents
from .operators.registry import assign_codes, entity_registry
from .operators.resolve import dedupe_rows, greedy_regex, island_representatives, islands, overlapping_pairs
from .operators.spans import explode_array, span_rank
from .plans.publish import publish, scan_parts
from .session import checkpoint, scratch
from .plans.scan import findings_per_doc, scan
from .sinks.writers import index_rows, leak_check, one_row_join, output_name
from .sinks.text_files import read_text_files, unique_names, write_text_files
from .sources import corpus
from .sources.model import attach_model_findings
from .sources.files import classify_names, documents_from_files, list_folder, read_documents
from .sources.parts import read_parts
from .sources.profile import mode_threshold, parse_profile, parse_terms

QUERIES: dict = {}


def query(name, sql=None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def longs(df: DataFrame) -> DataFrame:
    """Offsets and counts as BIGINT on both sides of the comparison."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name)
                       if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name)
                       for f in df.schema.fields])


def _se(prefix=""):
    return f'cast({prefix}st as bigint) as "start", cast({prefix}en as bigint) as "end"'


RULE_NAMES = ["email", "vat", "tax_code", "iban", "phone"]
LABELS_SUBSET = ["private_email", "private_id", "private_organization"]
LABELS_SQL = "'private_email','private_id','private_organization'"
EXCEPTIONS = ["INFO0@example.com", "Supplier#000000003"]
MIN_SCORE = 0.2


# ---------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------

def forms(spark, sf):
    return corpus.forms(spark, sf)


def docs(spark, sf):
    return corpus.documents(spark, sf)


def raw_matches(df: DataFrame, rule_idx: int) -> DataFrame:
    r = DEFAULT_RULES[rule_idx]
    m = regex_matches_df(df.select("doc_id", "file", "text"), "text", [(r.pattern, r.group, r.guard, "m")])
    return explode_array(m, F.col("m"), ["doc_id", "file"], "x").select("doc_id", "file", "x.*")


def rule_spans(df: DataFrame, rule_idx: int) -> DataFrame:
    r = DEFAULT_RULES[rule_idx]
    m = regex_matches_df(df.select("doc_id", "file", "text"), "text", [(r.pattern, r.group, r.guard, "m")])
    return explode_array(m, rule_candidates_from(F.col("m"), r), ["doc_id", "file"]).select("doc_id", "file", "s.*")


def all_rule_spans(df: DataFrame) -> DataFrame:
    """Candidates of all rules with the rule's number, every regex in one projection."""
    specs = [(r.pattern, r.group, r.guard, f"_rx{i}") for i, r in enumerate(DEFAULT_RULES)]
    m = regex_matches_df(df.select("doc_id", "file", "text"), "text", specs)

    def tagged(i, rule):
        return F.transform(rule_candidates_from(F.col(f"_rx{i}"), rule), lambda s: F.struct(F.lit(i).alias("i"), s.alias("s")))

    rows = explode_array(m, F.concat(*[tagged(i, r) for i, r in enumerate(DEFAULT_RULES)]), ["doc_id", "file"], "x")
    return rows.select("doc_id", "file", "x.s.*", F.col("x.i").alias("rule_idx"))


def forms_spans(spark, sf, model=True, labels=X.DEFAULT_LABELS, exceptions=()):
    f = forms(spark, sf)
    fnd = corpus.form_findings(spark, sf) if model else None
    return scan(f, labels=labels, exclusions=exceptions, findings=fnd, min_score=MIN_SCORE if model else None)


def published(spark, sf, spans=None, d=None):
    """The publish job: spans checkpointed once, registry, codes, rewritten texts."""
    d = d if d is not None else forms(spark, sf)
    sp = spans if spans is not None else forms_spans(spark, sf)
    return publish(d, sp)


# DuckDB shared blocks
FORMS_RES = [O.FORMS] + O.resolved("forms", with_model=True, min_score=MIN_SCORE)
FORMS_RES_NOMODEL = [O.FORMS] + O.resolved("forms", with_model=False)
DOCS_RES = [O.DOCS] + O.resolved("docs", with_model=False)


def spans_cte(flagged_labels=O.DEFAULT_LABELS, exceptions=None, name="sp"):
    return f"{name} as (select *, {O.flag(flagged_labels, exceptions)} as will_redact from res)"


# ---------------------------------------------------------------------------
# Rules and validators
# ---------------------------------------------------------------------------

@query("detect_email", O.with_([O.DOCS] + O.rule_ctes("docs", O.RULES[:1]),
                               f"select doc_id, {_se()}, text from m_email_v"))
def q_detect_email(spark, sf):
    return longs(rule_spans(docs(spark, sf), 0).select("doc_id", "start", "end", "text"))


for _i, _name in enumerate(RULE_NAMES[1:], start=1):
    _cte = O.RULES[_i][0]

    def _mk(i):
        def fn(spark, sf):
            return longs(rule_spans(forms(spark, sf), i).select("doc_id", "start", "end", "text"))
        return fn

    QUERIES[f"detect_{_name}"] = (_mk(_i), O.with_([O.FORMS] + O.rule_ctes("forms", [O.RULES[_i]]),
                                                   f"select doc_id, {_se()}, text from {_cte}_v"))

_VALIDATORS = {"vat": (1, valid_vat, O.v_vat), "tax_code": (2, valid_tax_code, O.v_tax),
               "iban": (3, valid_iban, O.v_iban), "phone": (4, valid_phone, O.v_phone)}
for _name, (_i, _sv, _dv) in _VALIDATORS.items():
    _cte = O.RULES[_i][0]

    def _mkv(i, sv):
        def fn(spark, sf):
            m = raw_matches(forms(spark, sf), i)
            t = py_strip(F.col("grp"))
            return longs(m.select("doc_id", "start", t.alias("text"), sv(t).alias("valid")))
        return fn

    QUERIES[f"valid_{_name}"] = (_mkv(_i, _sv), O.with_(
        [O.FORMS, O.matches(_cte, "forms", O.RULES[_i][1], O.RULES[_i][2], O.RULES[_i][5])],
        f"select doc_id, cast(gs as bigint) as \"start\", {O.strip('gt')} as text, "
        f"coalesce({_dv(O.strip('gt'))}, false) as valid from {_cte}"))


@query("detect_context_org", O.with_([O.FORMS] + O.context_ctes("forms"),
                                     f"select doc_id, {_se()}, text from ctx"))
def q_detect_context(spark, sf):
    f = regex_matches_df(forms(spark, sf).select("doc_id", "file", "text"), "text",
                         [(X.CONTEXT_ORG_RE, 2, "[:=-]", "m")])
    return longs(explode_array(f, context_candidates_from(F.col("m")), ["doc_id"])
                 .select("doc_id", "s.start", "s.end", "s.text"))


@query("clean_context", O.with_([O.FORMS] + O.context_ctes("forms"),
                                "select doc_id, cast(gs as bigint) as \"start\", gt as raw, cleaned from ctx_a"))
def q_clean_context(spark, sf):
    from .operators.detect import clean_context_value
    f = regex_matches_df(forms(spark, sf).select("doc_id", "file", "text"), "text",
                         [(X.CONTEXT_ORG_RE, 2, "[:=-]", "m")])
    x = explode_array(f, F.col("m"), ["doc_id"], "x").select("doc_id", "x.*")
    return longs(x.select("doc_id", "start", F.col("grp").alias("raw"), clean_context_value(F.col("grp")).alias("cleaned")))


# ---------------------------------------------------------------------------
# resolution
# ---------------------------------------------------------------------------

@query("regex_greedy", O.with_([O.FORMS] + O.rule_ctes("forms") + [O.regex_cands()] + O.greedy(),
                               f"select doc_id, label, {_se('')}, text from rxg"))
def q_regex_greedy(spark, sf):
    f = forms(spark, sf)
    specs = [(r.pattern, r.group, r.guard, f"_rx{i}") for i, r in enumerate(DEFAULT_RULES)]
    m = regex_matches_df(f.select("doc_id", "file", "text"), "text", specs)
    r = m.select("doc_id", F.concat(*[rule_candidates_from(F.col(f"_rx{i}"), rr)
                                      for i, rr in enumerate(DEFAULT_RULES)]).alias("r"))
    g = explode_array(r, greedy_regex(F.col("r")), ["doc_id"])
    return longs(g.select("doc_id", "s.label", "s.start", "s.end", "s.text"))


@query("overlap_priority", O.with_(FORMS_RES_NOMODEL, f"select doc_id, label, text, {_se('')}, source from res"))
def q_overlap_priority(spark, sf):
    return longs(forms_spans(spark, sf, model=False).select("doc_id", "label", "text", "start", "end", "source"))


DETECT_ALL_SQL = O.with_(FORMS_RES + [spans_cte()],
                         f"select doc_id, file, label, text, {_se('')}, score, source, will_redact from sp")


@query("detect_all", DETECT_ALL_SQL)
def q_detect_all(spark, sf):
    return longs(forms_spans(spark, sf).select("doc_id", "file", "label", "text", "start", "end", "score",
                                               "source", "will_redact"))


@query("detect_documents", O.with_(DOCS_RES + [spans_cte()],
                                   f"select doc_id, file, label, text, {_se('')}, source, will_redact from sp"))
def q_detect_documents(spark, sf):
    return longs(scan(docs(spark, sf)).select("doc_id", "file", "label", "text", "start", "end", "source",
                                              "will_redact"))


@query("span_rank", O.with_(FORMS_RES, f"select doc_id, label, {_se('')}, {O.SRC_PRIO.format(s='source')} as p, "
                                       "coalesce(score, 0.0) as s, cast(en - st as bigint) as n from res"))
def q_span_rank(spark, sf):
    s = forms_spans(spark, sf)
    r = span_rank(F.struct("start", "end", "score", "source"))
    return longs(s.select("doc_id", "label", "start", "end", r["p"].alias("p"), r["s"].alias("s"), r["n"].alias("n")))


@query("dedupe_spans", O.with_(FORMS_RES_NOMODEL + [
    "dup as (select doc_id, label, text, st, en, score, source from res union all "
    "select doc_id, label, text, st, en, 0.5, 'opf' from res)",
    f"dd as (select *, row_number() over (partition by doc_id, label, st, en, {O.norm('label', 'text')} "
    f"order by {O.SRC_PRIO.format(s='source')} desc, coalesce(score, 0.0) desc) as rk from dup)"],
    f"select doc_id, label, {_se('')}, source from dd where rk = 1"))
def q_dedupe_spans(spark, sf):
    s = forms_spans(spark, sf, model=False)
    dup = s.unionByName(s.withColumn("score", F.lit(0.5)).withColumn("source", F.lit("opf")))
    return longs(dedupe_rows(dup).select("doc_id", "label", "start", "end", "source"))


@query("union_sources", O.with_(FORMS_RES, "select source, count(*) as n from res group by source"))
def q_union_sources(spark, sf):
    return forms_spans(spark, sf).groupBy("source").agg(F.count("*").alias("n"))


@query("overlap_pairs", O.with_([O.FORMS] + O.rule_ctes("forms") + [O.regex_cands()],
                                "select a.doc_id, cast(a.st as bigint) as a_start, cast(a.en as bigint) as a_end, "
                                "a.label as a_label, cast(b.st as bigint) as b_start, cast(b.en as bigint) as b_end, "
                                "b.label as b_label from rx a join rx b on a.doc_id = b.doc_id "
                                "and greatest(a.st, b.st) < least(a.en, b.en) and "
                                "(a.st, a.en, a.rule_idx) < (b.st, b.en, b.rule_idx)"))
def q_overlap_pairs(spark, sf):
    c = all_rule_spans(forms(spark, sf)).select("doc_id", "start", "end", "label", "rule_idx")
    return longs(overlapping_pairs(c))


# ---------------------------------------------------------------------------
# Model findings
# ---------------------------------------------------------------------------

def _findings(spark, sf):
    return corpus.form_findings(spark, sf)


@query("model_findings_ingest", O.with_([O.FORMS, O.FINDINGS],
                                        "select doc_id, count(*) as n_findings from findings group by doc_id"))
def q_findings_ingest(spark, sf):
    f = findings_per_doc(_findings(spark, sf))
    return f.select("doc_id", F.size("findings").cast("long").alias("n_findings"))


@query("min_score", O.with_([O.FORMS, O.FINDINGS], f"select doc_id, seq from findings where score is null "
                                                   f"or score >= {MIN_SCORE}"))
def q_min_score(spark, sf):
    f = _findings(spark, sf)
    return f.where(F.col("score").isNull() | (F.col("score") >= MIN_SCORE)).select("doc_id", "seq")


@query("min_score_spans", O.with_([O.FORMS] + O.model_ctes("forms", MIN_SCORE), f"select doc_id, label, {_se('')}, text, score from md"))
def q_min_score_spans(spark, sf):
    """C1 as the scan applies it: findings below the minimum score give no span."""
    f = findings_per_doc(_findings(spark, sf)).join(forms(spark, sf).select("doc_id", "text"), "doc_id")
    m = explode_array(f, model_spans(F.col("text"), F.col("findings"), MIN_SCORE), ["doc_id"])
    return longs(m.select("doc_id", "s.label", "s.start", "s.end", "s.text", "s.score"))


@query("canonical_label", O.with_([O.FORMS, O.FINDINGS], f"select distinct label as raw_label, case when label in "
                                                         f"({O.ALIASES}) then 'private_id' else label end as label "
                                                         "from findings"))
def q_canonical_label(spark, sf):
    f = _findings(spark, sf).select(F.col("label").alias("raw_label")).distinct()
    return f.select("raw_label", canonical_label(F.col("raw_label")).alias("label"))


@query("trim_bounds", O.with_([O.FORMS] + O.model_ctes("forms", None)[:4],
                              "select doc_id, seq, cast(s2 as bigint) as \"start\", cast(s2 + core as bigint) as \"end\", "
                              "t as text from md_c"))
def q_trim_bounds(spark, sf):
    f = _findings(spark, sf).join(forms(spark, sf).select("doc_id", "text"), "doc_id")
    b = trim_bounds(F.col("text"), F.col("start"), F.col("end"))
    return longs(f.select("doc_id", "seq", b["start"].alias("start"), b["end"].alias("end"), b["text"].alias("text")))


@query("refine_address", O.with_([O.FORMS] + O.model_ctes("forms", None),
                                 f"select doc_id, {_se('')}, text, label from md where label = 'private_address'"))
def q_refine_address(spark, sf):
    f = findings_per_doc(_findings(spark, sf)).join(forms(spark, sf).select("doc_id", "text"), "doc_id")
    m = explode_array(f, model_spans(F.col("text"), F.col("findings")), ["doc_id"])
    return longs(m.where(F.col("s.label") == "private_address").select("doc_id", "s.start", "s.end", "s.text",
                                                                       "s.label"))


@query("score_bucket", O.with_([O.FORMS, O.FINDINGS],
                               "select doc_id, seq, case when score is null then '-' when score >= 0.8 then 'High' "
                               "when score >= 0.5 then 'Medium' else 'Low' end as bucket from findings"))
def q_score_bucket(spark, sf):
    return _findings(spark, sf).select("doc_id", "seq", RV.score_bucket(F.col("score")).alias("bucket"))


# ---------------------------------------------------------------------------
# Normalisation and prefixes
# ---------------------------------------------------------------------------

@query("normalize_entity", O.with_(FORMS_RES, f"select doc_id, label, cast(st as bigint) as \"start\", "
                                              f"{O.norm('label', 'text')} as normalized from res"))
def q_normalize(spark, sf):
    s = forms_spans(spark, sf)
    return longs(s.select("doc_id", "label", "start", normalize_entity(F.col("label"), F.col("text")).alias("normalized")))


@query("label_prefix", O.with_(FORMS_RES, f"select distinct label, {O.PREFIX} as prefix from res"))
def q_label_prefix(spark, sf):
    return forms_spans(spark, sf).select("label").distinct().select("label", label_prefix(F.col("label")).alias("prefix"))


# ---------------------------------------------------------------------------
# G1, H1, H2, F2: registry
# ---------------------------------------------------------------------------

REG_FORMS_ALL = FORMS_RES + [spans_cte()] + O.registry_ctes("sp", redacted_only=False)
REG_COLS = "cast(entity_id as bigint) as entity_id, placeholder, label, normalized, text"


@query("entity_registry", O.with_(REG_FORMS_ALL, f"select {REG_COLS} from reg"))
def q_entity_registry(spark, sf):
    reg = entity_registry(forms_spans(spark, sf), redacted_only=False)
    return longs(reg.select("entity_id", "placeholder", "label", "normalized", "text"))


@query("placeholders", O.with_(FORMS_RES + [spans_cte()] + O.registry_ctes("sp", redacted_only=True),
                               "select label, normalized, placeholder from reg"))
def q_placeholders(spark, sf):
    reg = entity_registry(forms_spans(spark, sf), redacted_only=True)
    return reg.select("label", "normalized", "placeholder")


@query("entity_ids", O.with_(DOCS_RES + [spans_cte()] + O.registry_ctes("sp", redacted_only=True),
                             f"select {REG_COLS} from reg"))
def q_entity_ids(spark, sf):
    reg = entity_registry(scan(docs(spark, sf)), redacted_only=True)
    return longs(reg.select("entity_id", "placeholder", "label", "normalized", "text"))


@query("assign_codes", O.with_(FORMS_RES + [spans_cte()] + O.coded_ctes("sp"),
                               f"select doc_id, label, {_se('')}, code from coded"))
def q_assign_codes(spark, sf):
    _, _, coded = published(spark, sf)
    return longs(coded.select("doc_id", "label", "start", "end", "code"))


@query("mapping_output", O.with_(FORMS_RES + [spans_cte()] + O.registry_ctes("sp", redacted_only=True),
                                 "select cast(entity_id as bigint) as entity_id, placeholder, label, text from reg"))
def q_mapping_output(spark, sf):
    _, reg, _ = published(spark, sf)
    return longs(reg.select("entity_id", "placeholder", "label", "text"))


# ---------------------------------------------------------------------------
# Islands and rewriting
# ---------------------------------------------------------------------------

RAW_CANDS = [O.FORMS] + O.rule_ctes("forms") + [O.regex_cands(),
                                               "rc as (select doc_id, file, label, text, st, en, "
                                               "cast(null as double) as score, 'regex' as source, '' as code from rx)"]


def _raw_cands(spark, sf):
    c = all_rule_spans(forms(spark, sf))
    return c.select("doc_id", "file", "label", "text", "start", "end", "score", F.lit(True).alias("will_redact"),
                    F.lit("").alias("code"), "source")


@query("merge_intervals", O.with_(RAW_CANDS + O.island_ctes("rc")[:2],
                                  f"select doc_id, {_se('')}, label, cast(min(st) over (partition by doc_id, island) as bigint) as island "
                                  "from isl_b"))
def q_merge_intervals(spark, sf):
    i = islands(_raw_cands(spark, sf))
    return longs(i.select("doc_id", "start", "end", "label", "island"))


@query("island_representative", O.with_(RAW_CANDS + O.island_ctes("rc"),
                                        f"select doc_id, {_se('')}, label, source from isl"))
def q_island_rep(spark, sf):
    r = island_representatives(_raw_cands(spark, sf))
    return longs(r.select("doc_id", "start", "end", "label", "source"))


REDACT_FORMS = FORMS_RES + [spans_cte()] + O.coded_ctes("sp") + O.rewrite_ctes("forms", "coded")


@query("redact_text", O.with_(REDACT_FORMS, "select doc_id, redacted_text, cast(n_redactions as bigint) as n_redactions "
                                            "from redacted"))
def q_redact_text(spark, sf):
    t, _, _ = published(spark, sf)
    return longs(t.select("doc_id", "redacted_text", "n_redactions"))


@query("safe_output", O.with_(REDACT_FORMS, "select doc_id, regexp_replace(file, '\\.txt$', '') || '_txt_anonymized.txt' "
                                            "as out_name, redacted_text from redacted"))
def q_safe_output(spark, sf):
    t, _, _ = published(spark, sf)
    return t.select("doc_id", output_name(F.col("file")).alias("out_name"), "redacted_text")


@query("safe_files", O.with_(REDACT_FORMS, "select regexp_replace(file, '\\.txt$', '') || '_txt_anonymized.txt' as out_name, "
                                           "redacted_text as text from redacted"))
def q_safe_files(spark, sf):
    """One file per document, written and read back."""
    t, _, _ = published(spark, sf)
    folder = scratch(spark, "safe")
    write_text_files(unique_names(t.withColumn("out_name", output_name(F.col("file")))).withColumn("text", F.col("redacted_text")), folder)
    return read_text_files(spark, folder)


REDACT_DOCS = DOCS_RES + [spans_cte()] + O.coded_ctes("sp") + O.rewrite_ctes("docs", "coded")


@query("redact_documents", O.with_(REDACT_DOCS, "select doc_id, redacted_text, cast(n_redactions as bigint) "
                                                "as n_redactions from redacted"))
def q_redact_documents(spark, sf):
    d = docs(spark, sf)
    t, _, _ = published(spark, sf, spans=scan(d), d=d)
    return longs(t.select("doc_id", "redacted_text", "n_redactions"))


@query("leak_check", O.with_(REDACT_FORMS, "select count(distinct (c.doc_id, c.text)) as leaks from redacted r join coded c on r.doc_id = c.doc_id "
                                           "where c.will_redact and length(c.text) > 0 "
                                           "and strpos(r.redacted_text, c.text) > 0"))
def q_leak_check(spark, sf):
    t, _, coded = published(spark, sf)
    return leak_check(t, coded).agg(F.count("*").alias("leaks"))


@query("occurrence_index", O.with_(FORMS_RES + [spans_cte()] + O.coded_ctes("sp"),
                                   "select file, code as placeholder, label, text, " + _se('') + ", "
                                   "case when score is null then '' else printf('%.3f', score) end as score, "
                                   "will_redact, source from coded where will_redact"))
def q_occurrence_index(spark, sf):
    _, _, coded = published(spark, sf)
    return longs(index_rows(coded))


@query("highlight_ranges", O.with_(FORMS_RES + [spans_cte()],
                                   f"select doc_id, {_se('')}, case when will_redact then 'redact' else 'keep' end "
                                   "as tag from sp"))
def q_highlight(spark, sf):
    return longs(highlight_ranges(forms_spans(spark, sf)).select("doc_id", "start", "end", "tag"))


# ---------------------------------------------------------------------------
# Flags, filters, metrics
# ---------------------------------------------------------------------------

@query("label_flag", O.with_(FORMS_RES_NOMODEL + [spans_cte(LABELS_SQL)],
                             "select doc_id, cast(st as bigint) as \"start\", label, will_redact from sp"))
def q_label_flag(spark, sf):
    return longs(forms_spans(spark, sf, model=False, labels=LABELS_SUBSET).select("doc_id", "start", "label",
                                                                                  "will_redact"))


@query("exclude_terms", O.with_(FORMS_RES_NOMODEL + [spans_cte(exceptions=EXCEPTIONS)],
                                "select doc_id, cast(st as bigint) as \"start\", label, text, will_redact from sp"))
def q_exclude_terms(spark, sf):
    return longs(forms_spans(spark, sf, model=False, exceptions=EXCEPTIONS).select("doc_id", "start", "label", "text",
                                                                                   "will_redact"))


ACCENTED = "replace(text, 'Supplier#', 'Straße  É#')"
EXCLUDED_SQL = "select replace(s_name, 'Supplier#', 'STRASSE é#') as term from supplier where s_suppkey % 2 = 0"


def _folded(c):
    return f"replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query("exclusion_table", O.with_([O.FORMS, f"accented as (select doc_id, file, {ACCENTED} as text from forms)"]
                                  + O.resolved("accented", with_model=False) + [spans_cte(), f"ex as ({EXCLUDED_SQL})"],
                                  "select doc_id, label, text, will_redact and not exists (select 1 from ex where "
                                  f"{_folded('ex.term')} = {_folded('sp.text')}) as will_redact from sp"))
def q_exclusion_table(spark, sf):
    """A table of exceptions that fold like the texts: spelling, case and white space differ."""
    corpus.register(spark, sf, ["supplier"])
    s = scan(forms(spark, sf).withColumn("text", F.expr(ACCENTED)), exclusions=spark.sql(EXCLUDED_SQL))
    return s.select("doc_id", "label", "text", "will_redact")


@query("kept_vs_redacted", O.with_(FORMS_RES + [spans_cte(LABELS_SQL, EXCEPTIONS)],
                                   "select will_redact, count(*) as n from sp group by will_redact"))
def q_kept_vs_redacted(spark, sf):
    s = forms_spans(spark, sf, labels=LABELS_SUBSET, exceptions=EXCEPTIONS)
    return s.groupBy("will_redact").agg(F.count("*").alias("n"))


@query("review_filter", O.with_(FORMS_RES, f"select doc_id, {_se('')}, text from res where label = 'private_id'"))
def q_review_filter(spark, sf):
    return longs(RV.review_filter(forms_spans(spark, sf), "Personal and business IDs")
                 .select("doc_id", "start", "end", "text"))


@query("redactions_by_label", O.with_(FORMS_RES + [spans_cte(LABELS_SQL)],
                                      "select label, count(*) as n from sp where will_redact group by label"))
def q_by_label(spark, sf):
    return RV.redactions_by_label(forms_spans(spark, sf, labels=LABELS_SUBSET))


@query("run_summary", O.with_(FORMS_RES + [spans_cte(LABELS_SQL)],
                              "select (select count(*) from forms) as processed_files, count(*) as total_spans, "
                              "count(*) filter (where will_redact) as redacted_spans, "
                              "count(*) filter (where not will_redact) as kept_spans from sp"))
def q_run_summary(spark, sf):
    n = forms(spark, sf).agg(F.count("*").alias("processed_files"))
    return one_row_join(n, RV.summary(forms_spans(spark, sf, labels=LABELS_SUBSET)))


@query("labels_found", O.with_(FORMS_RES, f"select distinct {O.DISPLAY.format(l='label')} as type from res"))
def q_labels_found(spark, sf):
    return RV.labels_found(forms_spans(spark, sf))


@query("first_span", O.with_(FORMS_RES, "select doc_id, cast(min(st) as bigint) as first_start from res group by doc_id"))
def q_first_span(spark, sf):
    return longs(RV.first_span(forms_spans(spark, sf)))


@query("docs_left_spans", O.with_(DOCS_RES, "select d.doc_id, count(r.doc_id) as n_spans from docs d "
                                            "left join res r on d.doc_id = r.doc_id group by d.doc_id"))
def q_docs_left_spans(spark, sf):
    d = docs(spark, sf)
    s = scan(d).groupBy("doc_id").agg(F.count("*").alias("n_spans"))
    return d.select("doc_id").join(s, "doc_id", "left").select("doc_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


# ---------------------------------------------------------------------------
# Review table
# ---------------------------------------------------------------------------

@query("review_rows", O.with_(FORMS_RES + [spans_cte()] + O.coded_ctes("sp"),
                              f"select doc_id, {_se('')}, case when will_redact then 'Yes' else 'No' end as redact, code, "
                              f"file, {O.DISPLAY.format(l='label')} as type, case when length(text) <= 140 then text "
                              "else substr(text, 1, 137) || '...' end as text, case when score is null then '-' "
                              "when score >= 0.8 then 'High' when score >= 0.5 then 'Medium' else 'Low' end as confidence, "
                              f"{O.SRC_DISPLAY.format(s='source')} as source_name from coded"))
def q_review_rows(spark, sf):
    _, _, coded = published(spark, sf)
    return longs(RV.review_rows(coded))


@query("display_names", O.with_(FORMS_RES, f"select distinct label, source, {O.DISPLAY.format(l='label')} as type, "
                                           f"{O.SRC_DISPLAY.format(s='source')} as source_name from res"))
def q_display_names(spark, sf):
    s = forms_spans(spark, sf).select("label", "source").distinct()
    return s.select("label", "source", RV.display_label(F.col("label")).alias("type"),
                    RV.source_display(F.col("source")).alias("source_name"))


SORTED_BY = {"redact": "will_redact", "code": "code", "file": "lower(file)", "type": f"lower({O.DISPLAY.format(l='label')})",
             "text": "lower(text)", "confidence": "coalesce(score, -1.0)", "source": f"lower({O.SRC_DISPLAY.format(s='source')})"}


@query("review_sort", O.with_(FORMS_RES + [spans_cte()] + O.coded_ctes("sp") + [
    "ix as (select *, row_number() over (order by file, st, en, label) as idx from coded)"],
    " union all ".join(f"select '{c}' as sorted_by, doc_id, cast(st as bigint) as \"start\", label, "
                       f"cast(row_number() over (order by {k} {'desc' if i % 2 else 'asc'}, idx) as bigint) as pos from ix"
                       for i, (c, k) in enumerate(SORTED_BY.items()))))
def q_review_sort(spark, sf):
    from .operators.numbering import row_numbers
    _, _, coded = published(spark, sf)
    s = row_numbers(coded, [(F.col(c), True) for c in ("file", "start", "end", "label")], "idx")
    s = checkpoint(s)                            # sorted seven times
    out = None
    for i, c in enumerate(SORTED_BY):
        t = RV.review_sort(s, c, descending=bool(i % 2)).select(F.lit(c).alias("sorted_by"), "doc_id", "start", "label", "pos")
        out = t if out is None else out.unionByName(t)
    return longs(out)


PAGE, PAGES = 40, 3


@query("review_pages", O.with_(FORMS_RES + [spans_cte()] + O.coded_ctes("sp") + [
    "ix as (select *, row_number() over (order by file, st, en, label) as idx from coded)"],
    " union all ".join(f"select * from (select '{c}' as sorted_by, doc_id, cast(st as bigint) as \"start\", label, "
                       f"cast((row_number() over (order by {k} {'desc' if i % 2 else 'asc'}, idx) - 1) // {PAGE} + 1 as bigint) as page from ix) "
                       f"where page <= {PAGES}" for i, (c, k) in enumerate(SORTED_BY.items()))))
def q_review_pages(spark, sf):
    """The first pages of each sort, each found from the last row of the page before."""
    from .operators.numbering import row_numbers
    _, _, coded = published(spark, sf)
    s = checkpoint(row_numbers(coded, [(F.col(c), True) for c in ("file", "start", "end", "label")], "idx"))
    out = None
    for i, c in enumerate(SORTED_BY):
        last = None
        for n in range(1, PAGES + 1):
            page = RV.review_page(s, c, PAGE, last, descending=bool(i % 2))
            t = page.select(F.lit(c).alias("sorted_by"), "doc_id", "start", "label", F.lit(n).alias("page"))
            out = t if out is None else out.unionByName(t)
            rows = page.select("page_key", "idx").collect()              # one page
            if len(rows) < PAGE:
                break
            last = rows[-1]
    return longs(out)


# ---------------------------------------------------------------------------
# A user's rule and a user's detector
# ---------------------------------------------------------------------------

DIGIT_RUNS = "runs as (select doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')) as text from forms)"


@query("user_rule", O.with_([O.FORMS, DIGIT_RUNS], "select doc_id, text, count(*) as n from runs "
                            "where cast(right(text, 2) as int) % 4 = 0 group by doc_id, text"))
def q_user_rule(spark, sf):
    """A rule that is not among the fixed ones, with a validator of its own."""
    rule = RegexRule("private_number", "[0-9]{2,}", validator=lambda v: F.substring(v, -2, 2).cast("int") % 4 == 0)
    found = forms(spark, sf).select("doc_id", regex_candidates(F.col("text"), [rule]).alias("spans"))
    return explode_array(found, "spans", ["doc_id"]).groupBy("doc_id", F.col("s.text").alias("text")).agg(F.count("*").alias("n"))


def digit_runs():
    """A detector as a user writes it: every run of digits, scored by its length."""
    runs = re.compile("[0-9]{2,}")
    return lambda texts: [[("private_number", m.start(), m.end(), 1 / (m.end() - m.start())) for m in runs.finditer(t)] for t in texts]


@query("user_detector", O.with_([O.FORMS, DIGIT_RUNS], "select doc_id, text, count(*) as n, 1.0 / length(text) as score from runs group by doc_id, text"))
def q_user_detector(spark, sf):
    """A user's detector attached to the documents."""
    found = attach_model_findings(forms(spark, sf), digit_runs, "digit runs 1")
    f = explode_array(found, "findings", ["doc_id", "text"])
    text = F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return f.select("doc_id", text.alias("text"), F.col("s.score").alias("score")).groupBy("doc_id", "text") \
        .agg(F.count("*").alias("n"), F.first("score").alias("score"))


# ---------------------------------------------------------------------------
# Decisions and manual terms
# ---------------------------------------------------------------------------

def _decisions(spans: DataFrame) -> DataFrame:
    """Reviewer toggles derived from the data: every span starting at a multiple of 7 is flipped."""
    return spans.where(F.col("start") % 7 == 0).select("doc_id", "label", "start", "end",
                                                        (~F.col("will_redact")).alias("will_redact"))


DECIDED = FORMS_RES + [spans_cte(), "dec as (select doc_id, label, st, en, case when st % 7 = 0 then not will_redact "
                                    "else will_redact end as will_redact, file, text, score, source from sp)"]


@query("apply_decisions", O.with_(DECIDED, "select doc_id, label, cast(st as bigint) as \"start\", will_redact from dec"))
def q_apply_decisions(spark, sf):
    s = forms_spans(spark, sf)
    return longs(RV.apply_decisions(s, _decisions(s)).select("doc_id", "label", "start", "will_redact"))


BULK = DECIDED + ["blk as (select doc_id, label, st, en, case when label = 'private_phone' then false "
                  "else will_redact end as will_redact, file, text, score, source from dec)"]


@query("bulk_decision", O.with_(BULK, "select label, will_redact, count(*) as n from blk group by label, will_redact"))
def q_bulk_decision(spark, sf):
    s = forms_spans(spark, sf)
    b = RV.bulk_decision(RV.apply_decisions(s, _decisions(s)), "Phone numbers", False)
    return b.groupBy("label", "will_redact").agg(F.count("*").alias("n"))


@query("rebuild_codes", O.with_(BULK + O.coded_ctes("blk"), f"select doc_id, label, {_se('')}, code from coded"))
def q_rebuild_codes(spark, sf):
    s = forms_spans(spark, sf)
    b = RV.bulk_decision(RV.apply_decisions(s, _decisions(s)), "Phone numbers", False)
    return longs(RV.rebuild_codes(b).select("doc_id", "label", "start", "end", "code"))


@query("preview_doc", O.with_(DECIDED + O.coded_ctes("dec") + O.rewrite_ctes("forms", "coded"),
                              "select doc_id, redacted_text from redacted"))
def q_preview_doc(spark, sf):
    s = forms_spans(spark, sf)
    coded = RV.rebuild_codes(RV.apply_decisions(s, _decisions(s)))
    t = redact_documents(forms(spark, sf), coded)
    return t.select("doc_id", "redacted_text")


@query("preview_one", O.with_(DECIDED + O.coded_ctes("dec") + O.rewrite_ctes("forms", "coded"),
                              "select doc_id, file, redacted_text, cast(n_redactions as bigint) as n_redactions from redacted "
                              "where doc_id = (select max(doc_id) from forms)"))
def q_preview_one(spark, sf):
    """The preview of one document, coded among all of them."""
    s, f = forms_spans(spark, sf), forms(spark, sf)
    coded = RV.rebuild_codes(RV.apply_decisions(s, _decisions(s)))
    return longs(preview(f, coded, f.agg(F.max("doc_id")).first()[0]))


def _terms(spark, sf):
    corpus.register(spark, sf, ["nation"])
    return spark.sql("select n_name as term, 'private_location' as label from nation")


TERMS = ["terms as (select n_name as term, 'private_location' as label from nation)",
         "tm_a as (select f.doc_id, f.file, t.term, t.label, string_split(f.text, t.term) as parts from forms f "
         "join terms t on strpos(f.text, t.term) > 0)",
         "tm_b as (select *, unnest(range(1, len(parts))) as i from tm_a)",
         "tm as (select doc_id, file, label, term as text, cast(list_sum(list_transform(parts[1:i], lambda x: length(x))) "
         "+ (i - 1) * length(term) as integer) as st, cast(list_sum(list_transform(parts[1:i], lambda x: length(x))) "
         "+ i * length(term) as integer) as en from tm_b)"]


@query("manual_terms", O.with_([O.FORMS] + TERMS, f"select doc_id, {_se('')}, text from tm"))
def q_manual_terms(spark, sf):
    return longs(RV.manual_term_spans(forms(spark, sf), _terms(spark, sf)).select("doc_id", "start", "end", "text"))


MANUAL = FORMS_RES + [spans_cte()] + TERMS + [
    "fresh as (select m.* from tm m where not exists (select 1 from sp s where s.doc_id = m.doc_id and s.st = m.st "
    "and s.en = m.en and s.label = m.label))",
    "allsp as (select doc_id, file, label, text, st, en, score, source, will_redact from sp union all "
    "select doc_id, file, label, text, st, en, null, 'manual', true from fresh)"]


@query("manual_anti_join", O.with_(MANUAL, f"select doc_id, {_se('')}, text from fresh"))
def q_manual_anti(spark, sf):
    s = forms_spans(spark, sf)
    found = RV.manual_term_spans(forms(spark, sf), _terms(spark, sf))
    fresh = found.join(s.select("doc_id", "start", "end", "label"), ["doc_id", "start", "end", "label"], "left_anti")
    return longs(fresh.select("doc_id", "start", "end", "text"))


@query("manual_add", O.with_(MANUAL + O.coded_ctes("allsp"), f"select doc_id, label, {_se('')}, source, code from coded"))
def q_manual_add(spark, sf):
    new, _ = RV.manual_add(forms_spans(spark, sf), forms(spark, sf), _terms(spark, sf))
    return longs(new.select("doc_id", "label", "start", "end", "source", "code"))


# ---------------------------------------------------------------------------
# File names (derived from documents)
# ---------------------------------------------------------------------------

NAMES_SQL = ("select doc_id, concat('doc_', lpad(cast(doc_id as string), cast(greatest(9, length(cast(doc_id as string))) as int), '0'), case doc_id % 11 "
             "when 0 then '.txt' when 1 then '.CSV' when 2 then '.tsv' when 3 then '.pdf' when 4 then '.docx' "
             "when 5 then '.xlsx' when 6 then '.jpg' when 7 then '.rtf' when 8 then '' when 9 then '.' "
             "else '.Txt' end) as name from documents")


def _names(spark, sf):
    corpus.register(spark, sf, ["documents"])
    return spark.sql(NAMES_SQL)


EXT = r"lower(regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1))"
NAMES = [f"names as ({NAMES_SQL})", f"nx as (select *, {EXT} as ext from names)"]
SUPPORTED = "('.pdf','.docx','.xlsx','.txt','.csv','.tsv')"


@query("scan_supported", O.with_(NAMES, f"select name, ext from nx where ext in {SUPPORTED}"))
def q_scan_supported(spark, sf):
    return classify_names(_names(spark, sf)).where(F.col("status") == "supported").select("name", "ext")


@query("scan_unsupported", O.with_(NAMES, f"select name, ext from nx where ext <> '' and ext not in {SUPPORTED}"))
def q_scan_unsupported(spark, sf):
    return classify_names(_names(spark, sf)).where(F.col("status") == "unsupported").select("name", "ext")


@query("scan_dispatch", O.with_(NAMES, f"select name, case when ext in {SUPPORTED} then substr(ext, 2) "
                                       "else 'unsupported' end as route from nx"))
def q_scan_dispatch(spark, sf):
    c = classify_names(_names(spark, sf))
    return c.select("name", F.when(F.col("status") == "supported", F.substring("ext", 2, 10))
                    .otherwise(F.lit("unsupported")).alias("route"))


FILES_SQL = ("select doc_id, concat('doc_', cast(doc_id as string), case doc_id % 6 when 0 then '.txt' when 1 then '.TXT' when 2 then '.xlsx' "
             "when 3 then '.docx' when 4 then '.pdf' else '.txt' end) as name, text from documents")


def _byte_files(spark, sf):
    """Documents as bytes: UTF-8, UTF-16 with a mark, and Latin-1 where it holds the text; containers get plain text."""
    corpus.register(spark, sf, ["documents"])
    narrow = F.col("text").rlike(r"^[\x00-\x7F\u00A0-\u00FF]*$")
    content = F.when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).when((F.col("doc_id") % 3 == 2) & narrow, F.encode("text", "ISO-8859-1")) \
        .otherwise(F.encode("text", "UTF-8"))
    f = classify_names(spark.sql(FILES_SQL))
    return f.select("doc_id", F.col("name").alias("path"), "name", "ext", content.alias("content"))


@query("read_text_ladder", O.with_([f"fl as ({FILES_SQL})"], "select name as file, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) "
                                                             "as text from fl where lower(right(name, 4)) = '.txt'"))
def q_read_text_ladder(spark, sf):
    docs_, _ = documents_from_files(_byte_files(spark, sf).where(F.col("ext") == ".txt"))
    return docs_.select("file", "text")


@query("ingest_errors", O.with_([f"fl as ({FILES_SQL})"], "select name as file, true as reported from fl where lower(right(name, 4)) <> '.txt'"))
def q_ingest_errors(spark, sf):
    _, errors = documents_from_files(_byte_files(spark, sf))
    return errors.select("file", F.col("message").startswith(F.concat("file", F.lit(": "))).alias("reported"))


def _folder(spark, sf, names):
    """A folder with one file for each row of ``names`` (name, text)."""
    folder = scratch(spark, "files")
    write_text_files(names.select(F.col("name").alias("out_name"), "text"), folder)
    return folder


@query("folder_listing", O.with_([f"fl as ({FILES_SQL})", f"fx as (select *, {EXT} as ext from fl)"],
                                 f"select name, case when ext in {SUPPORTED} then 'supported' else 'unsupported' end as status, "
                                 "cast(octet_length(encode(coalesce(text, ''))) as bigint) as length from fx"))
def q_folder_listing(spark, sf):
    """Files written from the documents and listed page by page."""
    corpus.register(spark, sf, ["documents"])
    return list_folder(spark, _folder(spark, sf, spark.sql(FILES_SQL))).select("name", "status", "length")


@query("folder_documents", O.with_([O.FORMS], "select file, text from forms"))
def q_folder_documents(spark, sf):
    """Files written from the forms, listed and read by the pages of the listing."""
    read, _ = read_documents(spark, _folder(spark, sf, forms(spark, sf).withColumnRenamed("file", "name")))
    return read.select("file", "text")


@query("part_spans", O.with_(DOCS_RES, f"select file, label, text, {_se('')} from res"))
def q_part_spans(spark, sf):
    """Documents written as files, read in parts of 8 KB and scanned part by part."""
    parts, _ = read_parts(spark, _folder(spark, sf, docs(spark, sf).withColumnRenamed("file", "name")), 8 << 10)
    return longs(scan_parts(parts).select("file", "label", "text", "start", "end"))


@query("output_names", O.with_(NAMES, r"select name, regexp_replace(name, '(\.[^.]*)$', '') || '_' || "
                                      r"case when length(ext) > 1 then substr(ext, 2) else 'file' end || "
                                      r"'_anonymized.txt' as out_name from nx"))
def q_output_names(spark, sf):
    return _names(spark, sf).select("name", output_name(F.col("name")).alias("out_name"))


@query("unsupported_sample", O.with_(NAMES + [
    f"us as (select name, row_number() over (order by lower(name), name) as k from nx "
    f"where ext <> '' and ext not in {SUPPORTED})"],
    "select name, cast(k as bigint) as k, (select count(*) from us) - 12 as more from us where k <= 12"))
def q_unsupported_sample(spark, sf):
    u = classify_names(_names(spark, sf)).where(F.col("status") == "unsupported")
    # distributed top-k first; only the 12 kept rows are numbered
    top = u.orderBy("sort_key", "name").limit(X.SAMPLE_LIST) \
        .withColumn("k", F.row_number().over(Window.orderBy("sort_key", "name")))
    more = u.agg((F.count("*") - X.SAMPLE_LIST).alias("more"))
    return longs(top.select("name", "k").withColumn("_one", F.lit(1))
                 .join(more.withColumn("_one", F.lit(1)), "_one").drop("_one"))


# ---------------------------------------------------------------------------
# Profiles derived from supplier rows
# ---------------------------------------------------------------------------

PROFILE_SQL = ("select s_suppkey, case s_suppkey % 4 when 0 then 'recommended' when 1 then 'complete' "
               "when 2 then 'selective' else 'bogus' end as mode, concat(s_name, ', ', ' ,', n_name, ',  x ') as raw "
               "from supplier join nation on s_nationkey = n_nationkey")


def _profiles(spark, sf):
    corpus.register(spark, sf, ["supplier", "nation"])
    return spark.sql(PROFILE_SQL)


@query("mode_threshold", O.with_([f"pr as ({PROFILE_SQL})"],
                                 "select s_suppkey, case mode when 'complete' then 0.0 when 'selective' then 0.6 "
                                 "else 0.2 end as min_score from pr"))
def q_mode_threshold(spark, sf):
    p = _profiles(spark, sf)
    return p.select("s_suppkey", mode_threshold(F.col("mode")).cast("double").alias("min_score"))


@query("parse_terms", O.with_([f"pr as ({PROFILE_SQL})",
                               "pt as (select s_suppkey, unnest(string_split(raw, ',')) as t from pr)"],
                              "select s_suppkey, trim(t) as term from pt where trim(t) <> ''"))
def q_parse_terms(spark, sf):
    p = _profiles(spark, sf)
    return p.select("s_suppkey", F.explode(parse_terms(F.col("raw"))).alias("term"))


@query("profile_apply", O.with_([f"pr as ({PROFILE_SQL})"],
                                "select s_suppkey, case when mode in ('recommended','complete','selective') then mode "
                                "else 'recommended' end as detection_mode, "
                                "case when s_suppkey % 2 = 0 then raw else '' end as exceptions, "
                                "s_suppkey % 3 = 0 as include_kept_in_index from pr"))
def q_profile_apply(spark, sf):
    p = _profiles(spark, sf)
    js = F.to_json(F.struct(
        F.array(F.lit("private_email")).alias("labels"), F.col("mode").alias("detection_mode"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("raw")).alias("exceptions"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(True)).alias("include_kept_in_index")))
    parsed = parse_profile(js)
    return p.select("s_suppkey", parsed["detection_mode"].alias("detection_mode"),
                    parsed["exceptions"].alias("exceptions"),
                    parsed["include_kept_in_index"].alias("include_kept_in_index"))


# ---------------------------------------------------------------------------
# Tabular rendering and assembly (cells from customer)
# ---------------------------------------------------------------------------

# workbook, sheet and row come from the key: 500 customers a workbook, 100 a sheet
CELLS_BASE = ("select c_custkey, cast(floor(c_custkey / 500) as bigint) as book, "
              "cast(floor(c_custkey % 500 / 100) as bigint) + 1 as sheet_idx, c_custkey % 100 + 1 as rn, "
              "cast(floor(c_custkey / 500) as bigint) % 3 <> 0 as has_head, c_mktsegment, c_name, c_acctbal, "
              "cast(cast(round(c_acctbal * 100) as bigint) as string) as bal from customer")


def _cells(spark, sf) -> DataFrame:
    corpus.register(spark, sf, ["customer"])
    b = spark.sql(CELLS_BASE)
    data = F.struct((F.col("rn") + F.col("has_head").cast("int")).alias("row_number"), F.array(
        F.col("c_name"), F.col("bal"), F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lower(F.col("c_name")), F.lit("@example.com"))),
        F.lit("")).alias("cells"))
    head = F.struct(F.lit(1).cast("long").alias("row_number"),
                    F.array(F.lit("Name"), F.lit("Balance"), F.lit("Segment"), F.lit("Email")).alias("cells"))
    rows = F.when(F.col("has_head") & (F.col("rn") == 1), F.array(head, data)).otherwise(F.array(data))
    return b.select(F.concat(F.lit("cust_"), F.col("book").cast("string"), F.lit(".xlsx")).alias("file"), "sheet_idx",
                    F.concat(F.lit("Part "), F.col("sheet_idx").cast("string")).alias("sheet"), F.explode(rows).alias("r")) \
        .select("file", "sheet_idx", "sheet", "r.row_number", "r.cells")


CELLS = [f"cb as ({CELLS_BASE})",
         "cells as (select 'cust_' || cast(book as varchar) || '.xlsx' as file, sheet_idx, 'Part ' || cast(sheet_idx as "
         "varchar) as sheet, rn + case when has_head then 1 else 0 end as row_number, [c_name, bal, case when c_custkey % 5 = 0 "
         "then '' else c_mktsegment end, case when c_custkey % 4 = 0 then '' else lower(c_name) || '@example.com' end, ''] "
         "as cells from cb union all select 'cust_' || cast(book as varchar) || '.xlsx', sheet_idx, 'Part ' || cast(sheet_idx as "
         "varchar), 1, ['Name', 'Balance', 'Segment', 'Email'] from cb where has_head and rn = 1)",
         "tc as (select *, list_filter(cells, lambda x: x <> '') as filled, "
         "coalesce(list_max(list_transform(range(1, len(cells) + 1), lambda i: case when cells[i] <> '' then i "
         "else 0 end)), 0) as last from cells)",
         "tr as (select file, sheet_idx, sheet, row_number, cells[1:last] as cells from tc where last > 0)",
         "hd as (select *, len(list_filter(cells, lambda x: x <> '')) >= 2 and len(list_filter(list_filter(cells, "
         "lambda x: x <> ''), lambda x: regexp_matches(x, '[A-Za-z]'))) >= greatest(2, "
         "len(list_filter(cells, lambda x: x <> '')) // 2) as is_header from tr)",
         "hh as (select file, sheet_idx, min(row_number) as header_row from hd where is_header group by file, sheet_idx)",
         "hx as (select h.file, h.sheet_idx, h.header_row, d.cells as headers from hh h join hd d on h.file = d.file "
         "and h.sheet_idx = d.sheet_idx and h.header_row = d.row_number)"]

CTX_HEADER = X.CONTEXT_HEADER_RE.replace("(?iU)", "(?i)").replace("(?iu)", "(?i)").replace("(?iuU)", "(?i)")

ROW_SQL = ("array_to_string(list_filter(list_transform(range(1, len(cells) + 1), lambda i: case when cells[i] = '' "
           "then null when i <= len(headers) and headers[i] <> '' and regexp_matches(headers[i], " + O.q(CTX_HEADER) +
           ") then headers[i] || ': ' || cells[i] else cells[i] end), lambda p: p is not null), ' | ')")

LINES = CELLS + [
    "jl as (select d.*, x.header_row, x.headers from hd d left join hx x on d.file = x.file and d.sheet_idx = x.sheet_idx)",
    f"ln as (select file, sheet_idx, sheet, row_number, case when row_number = header_row then array_to_string(cells, ' | ') "
    f"when header_row is null or row_number < header_row then array_to_string(cells, ' | ') "
    f"else (case when {ROW_SQL} = '' then '' else 'Row ' || cast(row_number as varchar) || ': ' || {ROW_SQL} end) end "
    f"as line from jl)"]


@query("format_cells", O.with_([f"cb as ({CELLS_BASE})"], "select c_custkey, c_name as name, bal as balance, "
                                                          "case when c_acctbal > 0 then 'YES' else 'NO' end as positive "
                                                          "from cb"))
def q_format_cells(spark, sf):
    corpus.register(spark, sf, ["customer"])
    return spark.sql(CELLS_BASE).select(
        "c_custkey", TB.format_cell_value(F.col("c_name")).alias("name"), TB.format_cell_value(F.col("bal")).alias("balance"),
        TB.format_cell_value(F.col("c_acctbal") > 0, T.BooleanType()).alias("positive"))


@query("trim_cells", O.with_(CELLS + [], "select file, cast(sheet_idx as bigint) as sheet_idx, cast(row_number as bigint) "
                                        "as row_number, array_to_string(cells, '|') as cells from tr"))
def q_trim_cells(spark, sf):
    c = _cells(spark, sf).select("file", "sheet_idx", "row_number", TB.trim_cells(F.col("cells")).alias("cells"))
    return longs(c.where(TB.has_content(F.col("cells"))).select("file", "sheet_idx", "row_number",
                                                                 F.array_join("cells", "|").alias("cells")))


@query("header_detect", O.with_(CELLS, "select file, cast(sheet_idx as bigint) as sheet_idx, cast(row_number as bigint) "
                                       "as row_number, is_header from hd"))
def q_header_detect(spark, sf):
    c = _cells(spark, sf).select("file", "sheet_idx", "row_number", TB.trim_cells(F.col("cells")).alias("cells"))
    c = c.where(TB.has_content(F.col("cells")))
    return longs(c.select("file", "sheet_idx", "row_number", TB.looks_like_header(F.col("cells")).alias("is_header")))


@query("header_carry", O.with_(CELLS, "select file, cast(sheet_idx as bigint) as sheet_idx, cast(header_row as bigint) "
                                      "as header_row, array_to_string(headers, '|') as headers from hx"))
def q_header_carry(spark, sf):
    c = _cells(spark, sf).select("file", "sheet_idx", "row_number", TB.trim_cells(F.col("cells")).alias("cells"))
    c = c.where(TB.has_content(F.col("cells"))).withColumn("is_header", TB.looks_like_header(F.col("cells")))
    h = TB.sheet_headers(c)
    return longs(h.select("file", "sheet_idx", "header_row", F.array_join("headers", "|").alias("headers")))


@query("row_context", O.with_(LINES, "select file, cast(sheet_idx as bigint) as sheet_idx, cast(row_number as bigint) "
                                     "as row_number, line from ln where line <> ''"))
def q_row_context(spark, sf):
    return longs(TB.render_sheet_rows(_cells(spark, sf)).select("file", "sheet_idx", "row_number", "line"))


@query("render_sheets", O.with_(LINES + [
    "ps as (select file, sheet_idx, sheet, '[Sheet: ' || sheet || ']' || chr(10) || "
    "string_agg(line, chr(10) order by row_number) as b from ln where line <> '' group by file, sheet_idx, sheet)"],
    "select file, string_agg(b, chr(10) order by sheet_idx) as text from ps group by file"))
def q_render_sheets(spark, sf):
    return TB.assemble_sheets(TB.render_sheet_rows(_cells(spark, sf)))


CSV_LINES = CELLS + [
    "cf as (select regexp_replace(file, '[.]xlsx$', '') || '_' || cast(sheet_idx as varchar) || '.csv' as file, row_number, cells "
    "from cells)",
    "f1 as (select file, cells as headers, len(list_filter(cells, lambda x: x <> '')) >= 2 and "
    "len(list_filter(list_filter(cells, lambda x: x <> ''), lambda x: regexp_matches(x, '[A-Za-z]'))) >= "
    "greatest(2, len(list_filter(cells, lambda x: x <> '')) // 2) as has_header from cf where row_number = 1)",
    "c1 as (select c.file, c.row_number, c.cells, coalesce(f.has_header, false) as has_header, f.headers from cf c "
    "left join f1 f on c.file = f.file)",
    "c2 as (select file, row_number, has_header, headers, list_filter(cells, lambda x: true)[1:coalesce(list_max("
    "list_transform(range(1, len(cells) + 1), lambda i: case when cells[i] <> '' then i else 0 end)), 0)] as cells "
    "from c1 where not (has_header and row_number = 1))",
    f"c3 as (select file, row_number, case when not has_header then array_to_string(cells, ' | ') else "
    f"(case when {ROW_SQL} = '' then '' else 'Row ' || cast(row_number as varchar) || ': ' || {ROW_SQL} end) end as line "
    f"from c2 where len(cells) > 0)",
    "csvl as (select file, row_number, line from c3 where line <> '' union all select file, 1, "
    "array_to_string(headers, ' | ') from f1 where has_header)"]


@query("render_csv_rows", O.with_(CSV_LINES, "select file, cast(row_number as bigint) as row_number, line from csvl"))
def q_render_csv(spark, sf):
    """Every sheet as a delimited file of its own."""
    name = F.concat(F.regexp_replace("file", "[.]xlsx$", ""), F.lit("_"), F.col("sheet_idx").cast("string"), F.lit(".csv"))
    c = _cells(spark, sf).select(name.alias("file"), "row_number", "cells")
    return longs(TB.render_delimited_rows(c).select("file", "row_number", "line"))


PARTS_SQL = ("select concat('conv_', lpad(cast(conv_id as string), cast(greatest(6, length(cast(conv_id as string))) as int), '0'), '.docx') as file, turn, text "
             "from conversations")


def _parts(spark, sf):
    corpus.register(spark, sf, ["conversations"])
    return spark.sql(PARTS_SQL)


@query("assemble_docx_parts", O.with_([f"pa as ({PARTS_SQL})"],
                                      "select file, string_agg(text, chr(10) order by turn) as text from pa "
                                      "where trim(text) <> '' group by file"))
def q_assemble_docx(spark, sf):
    p = _parts(spark, sf).where(F.trim(F.col("text")) != "")
    return TB.assemble_lines(p.select("file", F.col("turn").alias("row_number"), F.col("text").alias("line")))


@query("assemble_pages", O.with_([f"pa as ({PARTS_SQL})"],
                                 "select file, string_agg(text || chr(10), '' order by turn) as text from pa "
                                 "where text <> '' group by file"))
def q_assemble_pages(spark, sf):
    return TB.assemble_pages(_parts(spark, sf), order="turn")


# ---------------------------------------------------------------------------
# Run log rows and profile payload
# ---------------------------------------------------------------------------

@query("run_log", O.with_(FORMS_RES + [spans_cte(LABELS_SQL)],
                          "select 'summary' as section, k as key, v as value from (select 'processed_files' as k, "
                          "cast((select count(*) from forms) as varchar) as v union all select 'total_spans', "
                          "cast(count(*) as varchar) from sp union all select 'redacted_spans', cast(count(*) as varchar) "
                          "from sp where will_redact union all select 'kept_spans', cast(count(*) as varchar) from sp "
                          "where not will_redact) "
                          "union all select 'input_file', file, '' from forms "
                          "union all select 'redactions_by_label', label, cast(count(*) as varchar) from sp "
                          "where will_redact group by label"))
def q_run_log(spark, sf):
    from .sinks.writers import run_log_rows
    f = forms(spark, sf)
    errors = spark.createDataFrame([], "file string, message string")
    return run_log_rows(f.select("file"), forms_spans(spark, sf, labels=LABELS_SUBSET), errors)


PAYLOAD_SQL = ("select s_suppkey, case s_suppkey % 3 when 0 then 'complete' when 1 then 'selective' "
               "else 'recommended' end as mode, concat(s_name, ', ', n_name) as exceptions, "
               "s_suppkey % 2 = 0 as include_kept from supplier join nation on s_nationkey = n_nationkey")


@query("profile_payload", O.with_([f"pp as ({PAYLOAD_SQL})"],
                                  "select s_suppkey, to_json({'labels': case when s_suppkey % 2 = 0 then "
                                  "['private_email', 'private_id'] else ['private_email', 'private_id', "
                                  "'private_person'] end, 'detection_mode': mode, 'exceptions': exceptions, "
                                  "'include_kept_in_index': include_kept}) as payload from pp"))
def q_profile_payload(spark, sf):
    from .sources.profile import profile_payload
    corpus.register(spark, sf, ["supplier", "nation"])
    p = spark.sql(PAYLOAD_SQL)
    labels = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("private_id"), F.lit("private_email"))).otherwise(
        F.array(F.lit("private_person"), F.lit("private_id"), F.lit("private_email")))
    return p.select("s_suppkey", profile_payload(labels, F.col("mode"), F.col("exceptions"),
                                                 F.col("include_kept")).alias("payload"))
