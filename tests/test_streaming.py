"""Streaming scan over files arriving in a folder."""
import os
import tempfile

from spanmask.streaming.scan_stream import read_stream_spans, start_stream_scan


def test_stream_scan_picks_up_new_files(spark):
    root = tempfile.mkdtemp(prefix="spanmask-stream-")
    inbox, out, ckpt = (os.path.join(root, x) for x in ("in", "spans", "ckpt"))
    os.makedirs(inbox)
    with open(os.path.join(inbox, "a.txt"), "w") as f:
        f.write("Fornitore: ACME Srl | P.IVA: 01114601006\r\nmail info@example.com")
    q = start_stream_scan(spark, inbox, out, ckpt, available_now=True)
    q.awaitTermination(120)
    first = sorted((r.file, r.label, r.text, r.start) for r in read_stream_spans(spark, out).collect())
    assert first == [("a.txt", "private_email", "info@example.com", 46),
                     ("a.txt", "private_id", "01114601006", 29),
                     ("a.txt", "private_organization", "ACME Srl", 11)]
    with open(os.path.join(inbox, "b.txt"), "w") as f:
        f.write("tel +39 333 1234567")
    q = start_stream_scan(spark, inbox, out, ckpt, available_now=True)
    q.awaitTermination(120)
    rows = read_stream_spans(spark, out).collect()
    assert len(rows) == 4
    assert sorted(r.file for r in rows).count("a.txt") == 3      # not rescanned after restart


def test_stream_scan_reads_csv_and_reports_errors(spark):
    root = tempfile.mkdtemp(prefix="spanmask-stream2-")
    inbox, out, ckpt = (os.path.join(root, x) for x in ("in", "spans", "ckpt"))
    os.makedirs(inbox)
    with open(os.path.join(inbox, "s.csv"), "w") as f:
        f.write("Supplier,Email\nACME Srl,info@acme.it\n")
    with open(os.path.join(inbox, "bad.xlsx"), "w") as f:
        f.write("not a workbook")
    q = start_stream_scan(spark, inbox, out, ckpt, available_now=True)
    q.awaitTermination(120)
    got = sorted((r.file, r.label, r.text) for r in read_stream_spans(spark, out).collect())
    assert got == [("s.csv", "private_email", "info@acme.it"), ("s.csv", "private_organization", "ACME Srl")]
    errs = [r.message for r in spark.read.parquet(out + "_errors").collect()]
    assert len(errs) == 1 and errs[0].startswith("bad.xlsx: ")
