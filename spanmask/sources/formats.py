"""Per-file container parsers used inside ``mapInArrow`` (A5-A10).

Only containers are opened here (stdlib ``csv``, ``zipfile`` and ``xml``);
rendering and assembly are the DataFrame code in ``operators.tabular``, which
rows from any ingest can use.  PDF glyph layout is not
parsed (no parser is available); page assembly is ``assemble_pages``.
"""
from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree as ET

from .files import decode_bytes

W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def delimited_cells(text: str, delimiter: str) -> list[list[str]]:
    """Rows of the text's lines: a quoted cell does not span lines (part of the behaviour to be met)."""
    return [list(r) for r in csv.reader(text.splitlines(), delimiter=delimiter)]


def xlsx_cells(raw: bytes) -> list[tuple[int, str, int, list[str]]]:
    """(sheet_idx, title, row_number, cells) of every sheet row, cached values only.

    Numbers stand as in the file, so a date is its serial number.
    """
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S_NS}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{S_NS}t")))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    out = []
    for idx, sh in enumerate(wb.iter(f"{S_NS}sheet")):
        target = targets[sh.get(f"{R_NS}id")].lstrip("/")
        path = target if target.startswith("xl/") else "xl/" + target
        root = ET.fromstring(z.read(path))
        rn = 0
        for row in root.iter(f"{S_NS}row"):
            rn = int(row.get("r") or rn + 1)
            cells: dict[int, str] = {}
            col = -1
            for c in row.iter(f"{S_NS}c"):
                col = _col_index(re.sub(r"\d", "", c.get("r"))) if c.get("r") else col + 1
                t = c.get("t")
                v = c.find(f"{S_NS}v")
                if t == "inlineStr":
                    val = "".join(x.text or "" for x in c.iter(f"{S_NS}t"))
                elif v is None:
                    val = ""
                elif t == "s":
                    val = shared[int(v.text)]
                elif t == "b":
                    val = "YES" if v.text == "1" else "NO"
                else:
                    val = v.text or ""
                cells[col] = val.strip()
            width = max(cells) + 1 if cells else 0
            out.append((idx, sh.get("name"), rn, [cells.get(i, "") for i in range(width)]))
    return out


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1



BREAKS = {f"{W_NS}t": None, f"{W_NS}tab": "\t", f"{W_NS}br": "\n", f"{W_NS}cr": "\n", f"{W_NS}noBreakHyphen": "-"}


def paragraph_text(p) -> str:
    return "".join((e.text or "") if BREAKS[e.tag] is None else BREAKS[e.tag] for e in p.iter() if e.tag in BREAKS)


def docx_roots(z: zipfile.ZipFile) -> list:
    """The body, then each section's header and footer (a section without its own takes the one before)."""
    body = ET.fromstring(z.read("word/document.xml")).find(f"{W_NS}body")
    sections = list(body.iter(f"{W_NS}sectPr"))
    if not sections:
        loose = sorted((n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n)),
                       key=lambda n: ("footer" in n, n))
        return [body, *(ET.fromstring(z.read(n)) for n in loose)]
    rels = "word/_rels/document.xml.rels"
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read(rels))} if rels in z.namelist() else {}
    roots, current = [body], {}
    for s in sections:
        for kind in ("header", "footer"):
            for ref in s.findall(f"{W_NS}{kind}Reference"):
                if ref.get(f"{W_NS}type", "default") == "default":
                    current[kind] = ET.fromstring(z.read("word/" + target[ref.get(f"{R_NS}id")].removeprefix("/word/")))
            if kind in current:
                roots.append(current[kind])
    return roots


def docx_rows(raw: bytes):
    """Every paragraph with its place: section, table depth, table, row, cell, and the cell that holds the table.

    A cell has at least one row, so empty cells are known.  Tables are numbered
    through the document; place 0 is outside tables.
    """
    tables = 0
    for section, root in enumerate(docx_roots(zipfile.ZipFile(io.BytesIO(raw)))):
        todo = [(root, 0, (0, 0, 0), (0, 0, 0))]
        while todo:
            holder, depth, place, above = todo.pop(0)
            where = dict(zip(("section", "depth", "tbl", "row", "cell", "up_tbl", "up_row", "up_cell"), (section, depth, *place, *above)))
            if depth:
                yield "part", 0, "", -1, [], "", where
            for seq, e in enumerate(holder):
                if e.tag == f"{W_NS}p":
                    yield "part", 0, "", seq, [], paragraph_text(e), where
                elif e.tag == f"{W_NS}tbl":
                    tables += 1
                    todo += [(tc, depth + 1, (tables, r, c), place) for r, tr in enumerate(e.findall(f"{W_NS}tr"))
                             for c, tc in enumerate(tr.findall(f"{W_NS}tc"))]


def _delimited(mark: str):
    return lambda raw: (("cells", 0, "", n, [v.strip() for v in r], None, None)
                        for n, r in enumerate(delimited_cells(decode_bytes(raw), mark), start=1))


READERS = {
    ".txt": lambda raw: [("text", 0, "", 0, [], decode_bytes(raw), None)],
    ".csv": _delimited(","),
    ".tsv": _delimited("\t"),
    ".xlsx": lambda raw: (("cells", i, t, n, c, None, None) for i, t, n, c in xlsx_cells(raw)),
    ".docx": docx_rows,
}


def read_rows(raw: bytes, ext: str):
    """One file's content as rows (kind, sheet_idx, sheet, seq, cells, text, part)."""
    if ext not in READERS:
        raise ValueError(f"no reader for {ext} files is installed")
    return READERS[ext](raw)
