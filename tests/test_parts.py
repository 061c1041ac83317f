"""Texts in parts against the same texts whole: decoding, seams, spans, written files."""
import os
import random

import pytest

from spanmask.plans.publish import save_files, save_parts, scan_parts
from spanmask.plans.scan import scan
from spanmask.sources.files import decode_bytes, read_documents
from spanmask.sources.parts import read_parts

BITS = ["info@example.com", "+39 333 1234567", "333\n1234567", "P.IVA\n01114601006", "P.\nIVA: 01114601006", "01114601006", "RSSMRA85T10A562S", "Supplier:\nACME Srl, Torino", "Azienda = Rossi",
        "IT60 X054\n2811 1010 0000 0123 456", "IT60X0542811101000000123456", "è", "漢字", "😀", ";", "|", ".\n", "!\n", "\n", "\r\n", "\r", " ", " ", "\t", "a", "Z.", "9", "business", "ragione sociale", "name: Bianchi", "IT", "60 X", "P.", "IVA", "-", "lungo testo\n", "'", ", ", "(", ")\n\n"]


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.choice([0, 3, 40, 150, 150]))) for _ in range(7)]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i, t in enumerate(texts(1)):
        for e in ("utf-8", "utf-8-sig", "utf-16", "utf-16-be"):
            raw = ("﻿" + t).encode(e) if e == "utf-16-be" else t.encode(e)
            (d / f"{i:02d}_{e}.txt").write_bytes(raw)
        plain = t.replace("漢字", "").replace("😀", "€")
        (d / f"{i:02d}_cp1252.txt").write_bytes(plain.encode("cp1252"))
        (d / f"{i:02d}_latin.txt").write_bytes(plain.replace("€", "\x81").encode("latin-1") + b"\xe9\x81")
    (d / "rows.csv").write_text("Email,Phone\ninfo@example.com,+39 333 1234567\n")
    (d / "bad.xlsx").write_text("no container")
    (d / "broken.txt").write_bytes(b"\xef\xbb\xbf" + b"ok " * 40 + b"\xff\xff")
    return d


@pytest.mark.parametrize("size", [4, 64, 1 << 20])
def test_parts_are_the_text(spark, folder, size):
    parts, errors = read_parts(spark, str(folder), size)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (r.file, r.part)):
        whole = got.get(r.file, "")
        assert r.at == len(whole)
        got[r.file] = whole + r.text
    docs, failed = read_documents(spark, str(folder))
    assert got == {r.file: r.text for r in docs.collect()}
    assert {r.file for r in errors.collect()} == {r.file for r in failed.collect()} == {"bad.xlsx", "broken.txt"}
    assert got["03_utf-16.txt"] == decode_bytes((folder / "03_utf-16.txt").read_bytes())


@pytest.mark.parametrize("size", [4, 48])
def test_spans_across_parts(spark, folder, size):
    columns = ["file", "label", "text", "start", "end", "will_redact", "source"]
    parts, _ = read_parts(spark, str(folder), size)
    docs, _ = read_documents(spark, str(folder))
    want = sorted(map(repr, map(tuple, scan(docs).select(columns).collect())))
    got = sorted(map(repr, map(tuple, scan_parts(parts).select(columns).collect())))
    assert got == want and len(want) > 100
    assert parts.where("part > 0").count() > 50


def test_one_file_from_many_parts(spark, folder, tmp_path):
    parts, errors = read_parts(spark, str(folder), 64)
    docs, failed = read_documents(spark, str(folder))
    save_parts(str(tmp_path / "a"), parts, scan_parts(parts), errors)
    save_files(str(tmp_path / "b"), docs, scan(docs), failed)
    a, b = (tmp_path / x / "01_LLM_SAFE_FILES" for x in "ab")
    assert {n: (a / n).read_bytes() for n in os.listdir(a)} == {n: (b / n).read_bytes() for n in os.listdir(b)}

    def table(x, name):
        return sorted(map(repr, spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / x / "99_RESERVED_DO_NOT_UPLOAD" / name)).collect()))
    assert table("a", "index_csv") == table("b", "index_csv") and table("a", "mapping_csv") == table("b", "mapping_csv")


def test_a_stretch_without_a_seam_is_an_error(spark, folder, monkeypatch):
    (folder / "long.txt").write_text("1" * 100_000)
    monkeypatch.setattr("spanmask.sources.parts.MAX_STRETCH", 90_000)
    parts, errors = read_parts(spark, str(folder), 4096)
    assert {r.file: r.message for r in errors.collect()}["long.txt"] == "long.txt: 100000 characters without a place to cut"
    assert parts.where("file = 'long.txt'").count() == 0 and parts.where("file = '01_utf-8.txt'").count() > 0


def test_sizes_are_checked(spark, folder):
    with pytest.raises(ValueError):
        read_parts(spark, str(folder), 5)
