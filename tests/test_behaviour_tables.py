"""Behaviour to be met, as tables of inputs and results by subject."""
import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from spanmask.functions.text import canonical_label
from spanmask.functions.validators import valid_iban, valid_vat
from spanmask.operators.redact import redact_documents
from spanmask.operators.registry import entity_registry
from spanmask.operators.tabular import assemble_sheets, render_sheet_rows
from spanmask.plans.publish import save_outputs
from spanmask.plans.scan import scan
from spanmask.sinks.writers import output_name
from spanmask.sources.files import collect_files, collect_unsupported_files, read_documents
from spanmask.sources.profile import read_profiles, write_profiles


def span(text, start, label="private_person", code="", doc=1, file="a.txt", score=None, redact=True, source="opf"):
    return (doc, file, label, text, start, start + len(text), score, redact, code, source)


# text, selected labels, (label, text, start) of the spans to be redacted
DETECTED = [
    ("P.IVA 01114601006", ["private_id", "private_phone"], [("private_id", "01114601006", 6)]),
    ("Fornitore: ACME Srl | P.IVA: 01114601006", ["private_organization"], [("private_organization", "ACME Srl", 11)]),
    ("Supplier: ACME Training Srl | VAT number: 01114601006", ["private_organization"],
     [("private_organization", "ACME Training Srl", 10)]),
]


@pytest.mark.parametrize("text, labels, want", DETECTED)
def test_detected(spark, docs_df, text, labels, want):
    found = scan(docs_df([(1, "a.txt", text)]), labels=labels).where("will_redact").collect()
    assert [(s.label, s.text, s.start) for s in found] == want
    assert all(s.end == s.start + len(s.text) for s in found)


# column function, value, result
VALUES = [
    *[(valid_vat, v, v == "01114601006") for v in ("01114601006", "01114601007", "IT60X0542811101000000123456")],
    *[(valid_iban, v, v.startswith("IT60")) for v in ("01114601006", "IT60X0542811101000000123456", "IT61X0542811101000000123456")],
    (canonical_label, "account_number", "private_id"),
    (canonical_label, "private_person", "private_person"),
    *[(output_name, name, want + "_anonymized.txt") for name, want in (
        ("contract.pdf", "contract_pdf"), ("contract.docx", "contract_docx"), ("README", "README_file"), ("a.", "a_file"),
        (".bashrc", ".bashrc_file"), ("x.tar.GZ", "x.tar_gz"), ("..x", "..x_file"))],
]


def test_values(spark):
    for of in {f for f, _, _ in VALUES}:
        cases = [(v, w) for f, v, w in VALUES if f is of]
        rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string").select("i", of(F.col("v")).alias("r")).collect()
        assert {r.i: r.r for r in rows} == {i: w for i, (_, w) in enumerate(cases)}


def test_overlapping_redactions_become_one(spark, spans_df, docs_df):
    spans = spans_df([span("cdefg", 2, code="PERSON_1"), span("fghi", 5, code="PERSON_2")])
    assert redact_documents(docs_df([(1, "a.txt", "abcdefghij")]), spans).first().redacted_text == "ab[PERSON_1]j"


def test_one_code_for_spellings_of_an_address(spark, spans_df):
    spans = spans_df([span("INFO@EXAMPLE.COM", 0, "private_email", source="regex"),
                      span("info@example.com", 0, "private_email", doc=2, file="b.txt", source="regex")])
    assert [(r.placeholder, r.text) for r in entity_registry(spans).collect()] == [("EMAIL_1", "INFO@EXAMPLE.COM")]


def test_saved_outputs_keep_originals_apart(spark, spans_df, docs_df, tmp_path):
    docs = docs_df([(1, "input.txt", "Mario Rossi incontra Luca Bianchi")])
    save_outputs(str(tmp_path), docs, spans_df([span("Mario Rossi", 0, file="input.txt", score=0.95),
                                                span("Luca Bianchi", 21, file="input.txt", score=0.95, redact=False)]))
    safe, reserved = tmp_path / "01_LLM_SAFE_FILES", tmp_path / "99_RESERVED_DO_NOT_UPLOAD"
    assert [(r.out_name, r.text) for r in spark.read.parquet(str(safe / "texts")).collect()] == \
        [("input_txt_anonymized.txt", "[PERSON_1] incontra Luca Bianchi")]
    mapping = [json.loads(line) for f in glob.glob(str(reserved / "mapping_json" / "*.json")) for line in open(f)]
    index = [r for f in glob.glob(str(reserved / "index_csv" / "*.csv")) for r in csv.DictReader(open(f, newline=""))]
    assert [m["text"] for m in mapping] == ["Mario Rossi"]
    assert [(r["text"], r["score"]) for r in index] == [("Mario Rossi", "0.950")]
    assert os.listdir(safe) == ["texts"]


def test_sheet_lines(spark):
    cells = [("clienti.xlsx", 0, "Clienti", 1, ["Nome", "Email"]),
             ("clienti.xlsx", 0, "Clienti", 2, ["Mario Rossi", "mario.rossi@example.com"])]
    df = spark.createDataFrame(cells, "file string, sheet_idx int, sheet string, row_number int, cells array<string>")
    assert assemble_sheets(render_sheet_rows(df)).first().text.split("\n") == [
        "[Sheet: Clienti]", "Nome | Email", "Row 2: Nome: Mario Rossi | Email: mario.rossi@example.com"]


# file name, bytes, how it is listed, its text (None: an error row)
FILES = [
    ("suppliers.csv", b"Supplier,Contact,Email,VAT\nACME Training Srl,Mario Rossi,mario.rossi@example.com,01114601006\n", "supported",
     "Supplier | Contact | Email | VAT\nRow 2: Supplier: ACME Training Srl | Contact: Mario Rossi | "
     "Email: mario.rossi@example.com | VAT: 01114601006"),
    ("broken.xlsx", b"not really xlsx", "supported", None),
    ("fine.txt", "caff\xe8 Email: a@b.it\r\n".encode("cp1252"), "supported", "caff\xe8 Email: a@b.it\n"),
    ("foto.jpg", b"i", "unsupported", None),
    ("note.rtf", b"r", "unsupported", None),
    ("README", b"n", "ignored", None),
]


def test_files(spark, tmp_path):
    for name, content, _, _ in FILES:
        (tmp_path / name).write_bytes(content)
    listed = {"supported": collect_files(spark, str(tmp_path)), "unsupported": collect_unsupported_files(spark, str(tmp_path))}
    for status, rows in listed.items():
        assert [r.name for r in rows.collect()] == sorted(n for n, _, s, _ in FILES if s == status)
    docs, errors = read_documents(spark, str(tmp_path))
    assert {r.file: r.text for r in docs.collect()} == {n: t for n, _, _, t in FILES if t is not None}
    assert [r.message.split(": ")[0] for r in errors.collect()] == ["broken.xlsx"]


def test_profile_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"labels": ["private_email"], "detection_mode": "bogus"}')
    source, out = str(tmp_path / "a.json"), str(tmp_path / "out")
    write_profiles(read_profiles(spark, source), out)
    for p in (read_profiles(spark, source).first(), read_profiles(spark, out).first()):
        assert (p.labels, p.detection_mode) == (["private_email"], "recommended")
    assert (read_profiles(spark, source).first().exceptions, read_profiles(spark, source).first().include_kept_in_index) == ("", False)
