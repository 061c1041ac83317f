"""Operator 7: edges are folded for all segments of a batch at once, and segments are told apart by their UTF-8 bytes."""
import random

import numpy as np

from spanmask.llm import sentencepieces as SP
from spanmask.session import ship_package


def plain_path(size, edges, score):
    """Ids of the best path over (end, start, id); the earliest start on ties."""
    best = {0: (0, 0, [])}
    for e in range(1, size + 1):
        best[e] = max(((best[s - 1][0] + score[i], -s, best[s - 1][2] + [-s if i == SP.NO_PIECE else i]) for end, s, i in edges if end == e),
                      key=lambda o: o[:2])
    return best[size][2]


def test_best_paths_with_ties_and_unknown_characters():
    rng, score = random.Random(4), np.zeros(SP.NO_PIECE + 1, np.int64)
    score[:40], score[SP.NO_PIECE] = [rng.randint(-3, 0) for _ in range(40)], -9
    sizes = [rng.randint(1, SP.LONG) for _ in range(60)] + [1, SP.LONG]
    all_ = []
    for size in sizes:
        edges = [(p, p, rng.choice([SP.NO_PIECE, rng.randrange(40)])) for p in range(1, size + 1)]
        edges += {(s + n, s): (s + n, s, rng.randrange(40)) for s in range(1, size) for n in [rng.randint(1, 15)] if s + n <= size}.values()
        rng.shuffle(edges)
        all_.append(edges)
    flat = np.array([e << SP.END | s << SP.START | i for edges in all_ for e, s, i in edges], np.int64)
    ids, many = SP.best_paths(np.array(sizes), np.cumsum([0, *map(len, all_)]), flat, score)
    want = [plain_path(n, edges, score) for n, edges in zip(sizes, all_)]
    assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    none = SP.best_paths(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), score)
    assert [len(x) for x in none] == [0, 0]


def test_paths_are_not_folded_row_by_row(spark):
    ship_package(spark)
    path, rng = SP.vocabulary_path(), random.Random(5)
    v = SP.vocabulary(path)
    words = {"".join(rng.choice("▁▁the漢éق𝄞ing\n") for _ in range(rng.randint(2, SP.LONG))) for _ in range(200)}
    paths = SP.lattice(spark.createDataFrame([(w,) for w in words], "segment string"), path)
    assert {r.segment: v.spelled(r.segment, r.ids) for r in paths.collect()} == {w: v.path_ids(w) for w in words}
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_segments_are_hashed_by_their_bytes():
    for text in ("▁plain▁word", "▁é漢▁𝄞x", ""):
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        raw, place = SP.spelling(c)
        assert raw.tobytes() == text.replace("▁", " ").encode() and place.tolist() == [len(text[:i].replace("▁", " ").encode()) for i in range(len(text) + 1)]
    raw = np.frombuffer(b"abcdefghij abcdefghij abcdefghiX", np.uint8)
    start, end = np.array([0, 11, 22]), np.array([10, 21, 32])
    assert SP.same_spans(raw, start, end, np.array([0, 0, 2])) and not SP.same_spans(raw, start, end, np.array([0, 0, 0]))
    v = SP.vocabulary(SP.vocabulary_path())
    texts = ["the the▁the  é漢 é漢\x00 \x00", "", None, "the é漢 𝄞𝄞"]
    assert v.segments(texts) == [s for t in texts for s in v.segments([t])]
