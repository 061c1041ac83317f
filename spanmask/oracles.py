"""DuckDB SQL oracles: the same results as ``queries.py``, written independently in SQL.

Regexes are RE2 (no look-around, ASCII ``\\b``); the phone rule is written with
consuming guards instead of look-around.  Folds (greedy selection, rank
replacement) use ``list_reduce``; numbering uses plain window functions.
"""
from __future__ import annotations

from .sources.corpus import FINDINGS_SQL, FORMS_SQL

# RE2 versions of the rule patterns (single quotes doubled when embedded)
P_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
P_VAT = r"(?i)\b(?:P\.?\s*IVA\s*:?\s*)?(\d{11})\b"
P_TAX = r"(?i)\b[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]\b"
P_IBAN = r"(?i)\bIT\s*\d{2}\s*[A-Z]\s*(?:\d\s*){10}(?:[A-Z0-9]\s*){12}\b"
P_PHONE = r"(?i)(?:^|[^0-9A-Za-z_])((?:\+39\s*)?(?:0\d{1,4}|3\d{2})[\s./-]?\d{3,4}[\s./-]?\d{3,4})(?:$|[^0-9A-Za-z_])"
P_CTX = (r"(?im)\b(supplier|vendor|customer|client|company|organization|entity|business\s+name|"
         r"fornitore|ragione\s+sociale|azienda|ditta|societ[aà]|cliente)\s*[:=\-]\s*([^\n\r|;]{2,120})")
P_CUT = (r"(?i)\s+(?:VAT(?:\s+number)?|Tax\s+ID|Fiscal\s+ID|P\.?\s*IVA|Partita\s+IVA|"
         r"Codice\s+fiscale|CF|Email|Mail|Phone|Mobile|Telefono|Tel\.?|IBAN|Address|Indirizzo)\s*[:=\-]")
P_STREET = (r"(?i)\b(Via|Viale|Vicolo|Corso|Piazza|Largo|Strada|Contrada|Borgata|Borgo|"
            r"Localita|Località|Loc\.?|Frazione|Fraz\.?|V\.le|C\.so|P\.za|Sp(?:\.|\b)|"
            r"S\.?S\.?|Statale|Provinciale)\b[\s\S]{1,80}?\d+\s*[A-Za-z]?(?:\s*/\s*[A-Za-z\d]+)?")

ODD = "[1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]"
ALIASES = ("'account_number','bank_account','credit_card','fiscal_id','iban','id_number','tax_id','vat_number',"
           "'private_account_number','private_bank_account','private_credit_card','private_fiscal_id',"
           "'private_iban','private_tax_id','private_vat_number'")
PREFIX = ("case label when 'private_person' then 'PERSON' when 'private_organization' then 'ORGANIZATION' "
          "when 'private_email' then 'EMAIL' when 'private_phone' then 'PHONE' when 'private_address' then 'ADDRESS' "
          "when 'private_id' then 'ID' when 'private_date' then 'DATE' when 'private_location' then 'LOCATION' "
          "else upper(label) end")
LABEL_PRIO = ("case label when 'private_id' then 5 when 'private_email' then 4 when 'private_phone' then 3 "
              "when 'private_address' then 2 else 0 end")
SRC_PRIO = ("case {s} when 'manual' then 4 when 'regex' then 3 when 'context' then 3 when 'opf' then 2 "
            "when 'merged' then 1 else 0 end")
DISPLAY = ("case {l} when 'private_person' then 'People names' when 'private_email' then 'Emails' "
           "when 'private_phone' then 'Phone numbers' when 'private_address' then 'Addresses' "
           "when 'private_organization' then 'Companies and organizations' "
           "when 'private_id' then 'Personal and business IDs' when 'private_date' then 'Dates' "
           "when 'private_location' then 'Places' else {l} end")
SRC_DISPLAY = ("case {s} when 'opf' then 'model' when 'regex' then 'rule' when 'context' then 'field' "
               "when 'manual' then 'manual' when 'merged' then 'merged' else {s} end")
MODEL_TRIM = "(' ' || chr(9) || chr(13) || chr(10) || ',;|')"
CTX_TRIM = "(' ' || chr(9) || ':-=;|')"
DEFAULT_LABELS = ("'private_person','private_email','private_phone','private_address',"
                  "'private_organization','private_id'")
SPAN_T = "STRUCT(st INTEGER, en INTEGER, label VARCHAR, text VARCHAR, score DOUBLE, source VARCHAR, p INTEGER, sc DOUBLE, n INTEGER)"


def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(label: str, text: str) -> str:
    v = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (f"(case when {label} = 'private_email' then lower({v}) "
            f"when {label} = 'private_phone' then (case when starts_with({d}, '39') and length({d}) > 10 "
            f"then substr({d}, 3) else {d} end) "
            rf"when {label} = 'private_id' then upper(regexp_replace({v}, '[\s./-]', '', 'g')) "
            f"else lower({v}) end)")


def v_vat(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    dig = f"cast(substr({d}, i, 1) as integer)"
    total = (f"list_sum(list_transform(range(1, 11), lambda i: case when i % 2 = 1 then {dig} "
             f"else (case when {dig} * 2 > 9 then {dig} * 2 - 9 else {dig} * 2 end) end))")
    return f"(length({d}) = 11 and (10 - {total} % 10) % 10 = cast(substr({d}, 11, 1) as integer))"


def v_tax(x: str) -> str:
    cf = rf"upper(regexp_replace({x}, '\s', '', 'g'))"
    ch = f"substr({cf}, i, 1)"
    idx = f"(case when {ch} between '0' and '9' then ascii({ch}) - 48 else ascii({ch}) - 65 end)"
    total = f"list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 1 then {ODD}[{idx} + 1] else {idx} end))"
    return (f"(regexp_full_match({cf}, '[A-Z]{{6}}[0-9]{{2}}[A-EHLMPRST][0-9]{{2}}[A-Z][0-9]{{3}}[A-Z]') "
            f"and coalesce(chr(cast(65 + {total} % 26 as integer)) = substr({cf}, 16, 1), false))")


def v_iban(x: str) -> str:
    ib = rf"upper(regexp_replace({x}, '\s', '', 'g'))"
    rot = f"(substr({ib}, 5) || substr({ib}, 1, 4))"
    rem = (f"list_reduce(string_split({rot}, ''), lambda acc, c: case when c between 'A' and 'Z' "
           f"then (acc * 100 + ascii(c) - 55) % 97 else (acc * 10 + ascii(c) - 48) % 97 end, 0)")
    return f"(regexp_full_match({ib}, 'IT[0-9]{{2}}[A-Z][0-9]{{10}}[A-Z0-9]{{12}}') and coalesce({rem} = 1, false))"


def v_phone(x: str) -> str:
    d0 = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    d = f"(case when starts_with({x}, '+39') and starts_with({d0}, '39') then substr({d0}, 3) else {d0} end)"
    return f"(length({d}) between 8 and 11 and substr({d}, 1, 1) in ('0', '3'))"


def matches(name: str, src: str, pattern: str, group: int = 0, guard_group: bool = False) -> str:
    """CTE ``name``: (doc_id, file, text, i, mt, gt, gs, ge) — every match with group offsets."""
    p = q(pattern)
    gstart = ("mstart + strpos(mt, gt) - 1" if guard_group else "mstart + length(mt) - length(gt)")
    return f"""{name}_a as (
  select doc_id, file, text, regexp_extract_all(text, {p}, 0) ms, regexp_extract_all(text, {p}, {group}) gs,
         string_split_regex(text, {p}) gaps from {src}),
{name}_b as (select *, unnest(range(1, len(ms) + 1)) as i from {name}_a where len(ms) > 0),
{name}_c as (
  select doc_id, file, text, i, ms[i] as mt, gs[i] as gt,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as mstart
  from {name}_b),
{name} as (select doc_id, file, text, i, mt, gt, cast({gstart} as integer) as gs,
                  cast({gstart} + length(gt) as integer) as ge from {name}_c)"""


RULES = [  # (cte, pattern, group, validator, label, guard_group, rule_idx)
    ("m_email", P_EMAIL, 0, None, "private_email", False, 0),
    ("m_vat", P_VAT, 1, v_vat, "private_id", False, 1),
    ("m_tax", P_TAX, 0, v_tax, "private_id", False, 2),
    ("m_iban", P_IBAN, 0, v_iban, "private_id", False, 3),
    ("m_phone", P_PHONE, 1, v_phone, "private_phone", True, 4),
]

FORMS = f"forms as ({FORMS_SQL})"
DOCS = "docs as (select doc_id, concat('doc_', lpad(cast(doc_id as varchar), cast(greatest(9, length(cast(doc_id as varchar))) as int), '0'), '.txt') as file, text from documents)"
FINDINGS = f"findings as (select doc_id, label, f_start as s0, f_end as e0, score, seq from ({FINDINGS_SQL}))"


def rule_ctes(src: str, rules=RULES) -> list[str]:
    out = []
    for cte, pat, grp, val, label, guard, idx in rules:
        out.append(matches(cte, src, pat, grp, guard))
        cond = val(strip("gt")) if val else "true"
        out.append(f"""{cte}_v as (select doc_id, file, '{label}' as label, {strip('gt')} as text, gs as st, ge as en,
  {idx} as rule_idx, i from {cte} where {cond})""")
    return out


def regex_cands(rules=RULES) -> str:
    return "rx as (" + " union all ".join(f"select * from {r[0]}_v" for r in rules) + ")"


def greedy() -> list[str]:
    """E1 per document -> rxg(doc_id, file, st, en, label, text)."""
    return [
        f"""rx_l as (select doc_id, file, list({{'st': st, 'en': en, 'label': label, 'text': text}}
     order by st, {LABEL_PRIO} desc, (en - st) desc, rule_idx, i) as l from rx group by doc_id, file)""",
        """rx_f as (select doc_id, file, list_reduce(l, lambda acc, x: case when x.st >= acc.le
     then {'le': greatest(acc.le, x.en), 'out': list_append(acc.out, x)} else acc end,
     {'le': 0, 'out': []::STRUCT(st INTEGER, en INTEGER, label VARCHAR, text VARCHAR)[]}).out as l from rx_l)""",
        "rxg_u as (select doc_id, file, unnest(l) as s from rx_f)",
        "rxg as (select doc_id, file, s.st as st, s.en as en, s.label as label, s.text as text from rxg_u)",
    ]


def context_ctes(src: str) -> list[str]:
    return [
        matches("m_ctx", src, P_CTX, 2),
        f"""ctx_a as (select doc_id, file, gs, gt,
   trim(string_split_regex(trim(gt, {CTX_TRIM}), {q(P_CUT)})[1], {CTX_TRIM}) as cleaned,
   length(gt) - length(ltrim(gt, {CTX_TRIM})) as lead from m_ctx)""",
        """ctx as (select doc_id, file, cast(gs + lead as integer) as st, cast(gs + lead + length(cleaned) as integer) as en,
   'private_organization' as label, cleaned as text from ctx_a where length(cleaned) >= 2)""",
    ]


def model_ctes(src: str, min_score: float | None) -> list[str]:
    cond = "true" if min_score is None else f"(f.score is null or f.score >= {min_score})"
    return [
        FINDINGS,
        f"""md_a as (select f.doc_id, f.label as raw_label, f.score, f.seq, d.text,
   least(greatest(f.s0, 0), length(d.text)) as s1, f.e0 from findings f join {src} d on f.doc_id = d.doc_id where {cond})""",
        "md_b as (select *, least(greatest(e0, s1), length(text)) as e1 from md_a)",
        f"""md_c as (select doc_id, raw_label, score, seq, s1 + length(substr(text, s1 + 1, e1 - s1))
     - length(ltrim(substr(text, s1 + 1, e1 - s1), {MODEL_TRIM})) as s2,
   length(trim(substr(text, s1 + 1, e1 - s1), {MODEL_TRIM})) as core,
   {strip(f"trim(substr(text, s1 + 1, e1 - s1), {MODEL_TRIM})")} as t from md_b)""",
        f"""md_d as (select doc_id, score, seq, s2, t,
   case when raw_label in ({ALIASES}) then 'private_id' else raw_label end as label from md_c where t <> '')""",
        f"""md as (select doc_id, label, score, seq,
   case when label = 'private_address' and regexp_matches(t, {q(P_STREET)})
     then s2 + length(string_split_regex(t, {q(P_STREET)})[1]) else s2 end as st,
   case when label = 'private_address' and regexp_matches(t, {q(P_STREET)})
     then s2 + length(string_split_regex(t, {q(P_STREET)})[1]) + length(regexp_extract(t, {q(P_STREET)}, 0))
     else s2 + length(t) end as en,
   case when label = 'private_address' and regexp_matches(t, {q(P_STREET)})
     then {strip(f"regexp_extract(t, {q(P_STREET)}, 0)")} else t end as text from md_d)""",
    ]


def span_struct(st="st", en="en", label="label", text="text", score="score", source="source") -> str:
    return (f"{{'st': cast({st} as integer), 'en': cast({en} as integer), 'label': {label}, 'text': {text}, "
            f"'score': cast({score} as double), 'source': {source}, 'p': {SRC_PRIO.format(s=source)}, "
            f"'sc': coalesce(cast({score} as double), 0.0), 'n': cast({en} - {st} as integer)}}")


def resolved(src: str, with_model: bool, min_score: float | None = None, with_context: bool = True) -> list[str]:
    """Full per-document resolution -> ``res``(doc_id, file, label, text, st, en, score, source)."""
    ctes = rule_ctes(src) + [regex_cands()] + greedy()
    if with_context:
        ctes += context_ctes(src)
    else:
        ctes.append("ctx as (select doc_id, file, 0 as st, 0 as en, '' as label, '' as text from rx where false)")
    if with_model:
        ctes += model_ctes(src, min_score)
        ctes.append(f"""md_l as (select doc_id, list({span_struct(source="'opf'")} order by seq, st, en, label) as l
   from md group by doc_id)""")
    else:
        ctes.append(f"md_l as (select doc_id, []::{SPAN_T}[] as l from {src} where false)")
    ctes += [
        f"""cand_u as (select doc_id, 0 as grp, st, en, label, text from ctx
   union all select doc_id, 1 as grp, st, en, label, text from rxg)""",
        f"""cand_l as (select doc_id, list({span_struct(score="null", source="case when grp = 0 then 'context' else 'regex' end")}
   order by grp, st, en, label) as l from cand_u group by doc_id)""",
        f"""fold as (select d.doc_id, d.file, list_reduce(coalesce(c.l, []::{SPAN_T}[]), lambda acc, c:
     case when coalesce(list_bool_and(list_transform(acc, lambda o: not (greatest(o.st, c.st) < least(o.en, c.en))
       or {{'p': c.p, 's': c.sc, 'n': c.n}} > {{'p': o.p, 's': o.sc, 'n': o.n}})), true)
     then list_append(list_filter(acc, lambda o: not (greatest(o.st, c.st) < least(o.en, c.en))), c) else acc end,
     coalesce(m.l, []::{SPAN_T}[])) as l
   from {src} d left join cand_l c on d.doc_id = c.doc_id left join md_l m on d.doc_id = m.doc_id)""",
        "fold_u as (select doc_id, file, unnest(l) as s from fold)",
        f"""fold_r as (select doc_id, file, s.label as label, s.text as text, s.st as st, s.en as en, s.score as score,
   s.source as source, s.p as p, s.sc as sc, s.n as n,
   row_number() over (partition by doc_id, s.label, s.st, s.en, {norm('s.label', 's.text')}
                      order by s.p desc, s.sc desc, s.n desc) as rk from fold_u)""",
        "res as (select doc_id, file, label, text, st, en, score, source from fold_r where rk = 1 and st >= 0 and en > st)",
    ]
    return ctes


def flag(labels: str = DEFAULT_LABELS, exceptions: list[str] | None = None) -> str:
    cond = f"label in ({labels})"
    if exceptions:
        terms = ", ".join(q(" ".join(t.split()).lower()) for t in exceptions)
        cond += (rf" and not (lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) in ({terms})"
                 f" or {norm('label', 'text')} in ({terms}))")
    return f"({cond})"


def with_(ctes: list[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def registry_ctes(spans: str, redacted_only: bool) -> list[str]:
    cond = "where will_redact" if redacted_only else ""
    return [
        f"""reg_a as (select label, {norm('label', 'text')} as normalized, file, doc_id, st, en, text from {spans} {cond})""",
        """reg_b as (select *, row_number() over (partition by label, normalized order by file, doc_id, st, en) as rk,
   count(*) over (partition by label, normalized) as n_spans from reg_a)""",
        f"""reg as (select label, normalized, text, n_spans, {PREFIX} as prefix,
   row_number() over (order by file, doc_id, st, en, label) as entity_id,
   {PREFIX} || '_' || cast(row_number() over (partition by {PREFIX} order by file, doc_id, st, en, label) as varchar)
     as placeholder from reg_b where rk = 1)""",
    ]


def coded_ctes(spans: str, redacted_only: bool = True) -> list[str]:
    code = "case when s.will_redact then coalesce(r.placeholder, '') else '' end" if redacted_only \
        else "coalesce(r.placeholder, '')"
    return registry_ctes(spans, redacted_only) + [
        f"""coded as (select s.*, {code} as code from {spans} s
   left join reg r on s.label = r.label and {norm('s.label', 's.text')} = r.normalized)"""]


def island_ctes(spans: str) -> list[str]:
    """E5 + E6 over ``spans``(doc_id, file, label, text, st, en, score, source, code)."""
    return [
        f"""isl_a as (select *, max(en) over (partition by doc_id order by st, en, label
     rows between unbounded preceding and 1 preceding) as prev_end from {spans})""",
        """isl_b as (select *, sum(case when prev_end is null or st >= prev_end then 1 else 0 end)
     over (partition by doc_id order by st, en, label rows between unbounded preceding and current row) as island
   from isl_a)""",
        f"""isl_c as (select * exclude (island), min(st) over (partition by doc_id, island) as island, {SRC_PRIO.format(s='source')} as p, coalesce(score, 0.0) as sc,
   min(st) over (partition by doc_id, island) as i_st, max(en) over (partition by doc_id, island) as i_en,
   count(*) over (partition by doc_id, island) as n_members from isl_b)""",
        """isl_d as (select *, row_number() over (partition by doc_id, island
     order by p desc, sc desc, (en - st) desc, st, en, label) as rk from isl_c)""",
        """isl as (select doc_id, file, island, label, code, score, i_st as st, i_en as en, n_members,
   case when n_members = 1 then source else 'merged' end as source, text as member_text from isl_d where rk = 1)""",
    ]


def rewrite_ctes(docs: str, spans: str) -> list[str]:
    """K1 over coded ``spans`` (will_redact, code) -> ``redacted``(doc_id, file, redacted_text, n_redactions)."""
    return [f"red_in as (select * from {spans} where will_redact and st >= 0 and en > st)"] + island_ctes("red_in") + [
        """ivs as (select doc_id, list({'st': st, 'en': en, 'ph': '[' || case when coalesce(code, '') <> '' then code
     else upper(label) end || ']'} order by st) as l, count(*) as n from isl group by doc_id)""",
        f"""redacted as (select d.doc_id, d.file, case when v.l is null then d.text else
     array_to_string(list_transform(range(1, len(v.l) + 1), lambda i: substr(d.text,
       (case when i = 1 then 0 else v.l[i - 1].en end) + 1,
       v.l[i].st - (case when i = 1 then 0 else v.l[i - 1].en end)) || v.l[i].ph), '')
     || substr(d.text, v.l[len(v.l)].en + 1) end as redacted_text, coalesce(v.n, 0) as n_redactions
   from {docs} d left join ivs v on d.doc_id = v.doc_id)""",
    ]
