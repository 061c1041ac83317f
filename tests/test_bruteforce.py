"""Randomised span sets: Spark resolution/merging vs a brute-force model of the semantics."""
import random

from pyspark.sql import functions as F

from spanmask.operators.redact import redact_documents
from spanmask.operators.resolve import resolve_document

PRIO = {"manual": 4, "regex": 3, "context": 3, "opf": 2, "merged": 1}
LABEL_PRIO = {"private_id": 5, "private_email": 4, "private_phone": 3, "private_address": 2}
LABELS = ["private_id", "private_email", "private_phone", "private_person"]


def rank(s):
    return (PRIO.get(s["source"], 0), s["score"] if s["score"] is not None else 0.0, s["end"] - s["start"])


def overlap(a, b):
    return max(a["start"], b["start"]) < min(a["end"], b["end"])


def brute_resolve(model, context, regex):
    accepted = []
    for s in sorted(regex, key=lambda s: (s["start"], -LABEL_PRIO.get(s["label"], 0), s["start"] - s["end"])):
        if not any(overlap(s, o) for o in accepted):
            accepted.append(s)
    cands = sorted(context, key=lambda s: (s["start"], s["end"], s["label"])) + \
        sorted(accepted, key=lambda s: (s["start"], s["end"], s["label"]))
    out = list(model)
    for c in cands:
        hits = [o for o in out if overlap(c, o)]
        if not hits:
            out.append(c)
        elif all(rank(c) > rank(o) for o in hits):
            out = [o for o in out if o not in hits] + [c]
    best = {}
    for s in out:
        k = (s["label"], s["start"], s["end"], s["text"].lower())
        if k not in best or rank(s) > rank(best[k]):
            best[k] = s
    return sorted((s["start"], s["end"], s["label"], s["source"]) for s in best.values() if s["end"] > s["start"] >= 0)


def brute_redact(text, spans):
    # spans arrive in (start, end, label) order (the de-duplicated span list order)
    cands = sorted(spans, key=lambda s: (s["start"], s["end"], s["label"]))
    groups, cur, end = [], [], -1
    for s in cands:
        if cur and s["start"] < end:
            cur.append(s)
            end = max(end, s["end"])
        else:
            if cur:
                groups.append(cur)
            cur, end = [s], s["end"]
    if cur:
        groups.append(cur)
    for g in reversed(groups):
        st, en = min(s["start"] for s in g), max(s["end"] for s in g)
        best = g[0]
        for s in g[1:]:
            if rank(s) > rank(best):
                best = s
        ph = f"[{best['code']}]" if best["code"] else f"[{best['label'].upper()}]"
        text = text[:st] + ph + text[en:]
    return text


def _span(rnd, source, n=60):
    st = rnd.randrange(0, n - 1)
    en = st + rnd.randrange(1, 12)
    score = round(rnd.random(), 2) if source == "opf" and rnd.random() < 0.7 else None
    label = rnd.choice(LABELS)
    return {"start": st, "end": en, "label": label, "text": f"t{st}-{en}", "score": score, "source": source}


def test_resolution_matches_brute_force(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for doc in range(300):
        m = [_span(rnd, "opf") for _ in range(rnd.randrange(0, 4))]
        c = [_span(rnd, "context") for _ in range(rnd.randrange(0, 3))]
        r = [_span(rnd, "regex") for _ in range(rnd.randrange(0, 6))]
        rows.append((doc, m, c, r))
        want[doc] = brute_resolve(m, c, r)
    t = "array<struct<start:int,end:int,label:string,text:string,score:double,source:string>>"
    df = spark.createDataFrame(rows, f"doc_id long, m {t}, c {t}, r {t}")
    out = df.select("doc_id", resolve_document(F.col("m"), F.col("c"), F.col("r")).alias("s")).collect()
    got = {r.doc_id: sorted((x.start, x.end, x.label, x.source) for x in r.s) for r in out}
    assert got == want


def test_redaction_matches_brute_force(spark):
    rnd = random.Random(5)
    docs, spans, want = [], [], {}
    for doc in range(200):
        text = "".join(rnd.choice("abcdefgh ") for _ in range(70))
        ss = []
        for _ in range(rnd.randrange(0, 6)):
            s = _span(rnd, rnd.choice(["opf", "regex", "context", "manual"]))
            s["code"] = rnd.choice(["", f"P_{rnd.randrange(5)}"])
            ss.append(s)
        docs.append((doc, "f", text))
        spans += [(doc, "f", s["label"], s["text"], s["start"], s["end"], s["score"], True, s["code"], s["source"])
                  for s in ss]
        want[doc] = brute_redact(text, ss)
    d = spark.createDataFrame(docs, "doc_id long, file string, text string")
    sp = spark.createDataFrame(spans, "doc_id long, file string, label string, text string, start int, end int, "
                                      "score double, will_redact boolean, code string, source string")
    got = {r.doc_id: r.redacted_text for r in redact_documents(d, sp).collect()}
    assert got == want
