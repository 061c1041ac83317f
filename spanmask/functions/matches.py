"""All regex matches of a pattern with their code-point offsets, as one Column.

Spark has no function returning match positions.  ``split(text, re)`` and
``regexp_extract_all(text, re, 0)`` walk the same left-to-right,
non-overlapping matches, so the pieces interleave as
``gap0 m0 gap1 m1 ... gapk``; the start of match *i* is the length of
everything before it.  Valid for patterns that cannot match the empty string
(all rules here).  A capture group that ends the pattern is a suffix of its
match, so its start is ``match_end - length(group)``.

The running lengths are summed in blocks of about sqrt(n) pieces; documents
without any match skip the ``split`` entirely.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

MATCH_TYPE = "array<struct<start:int,end:int,match:string,grp:string>>"


def match_arrays(text: Column, pattern: str, group: int = 0) -> tuple[Column, Column]:
    """(all matches, all group texts): materialise both as columns before ``match_offsets``."""
    t = F.coalesce(text, F.lit(""))
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    grp = whole if group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    return whole, grp


def match_offsets(text: Column, whole: Column, grp: Column, pattern: str) -> Column:
    """``array<struct<start,end,match,grp>>`` from materialised match arrays.

    ``start``/``end`` are 0-based half-open code-point offsets of the group
    (group 0 = whole match); ``whole`` and ``grp`` should be column references
    (not expressions) so the regex runs once per row.
    """
    t = F.coalesce(text, F.lit(""))
    empty = F.array().cast(MATCH_TYPE)
    gaps = F.slice(F.split(t, pattern, -1), 1, F.size(whole))
    ends = running_sums(F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.length(m)))

    def item(p):
        return F.struct((p["e"] - F.length(p["g"])).cast("int").alias("start"), p["e"].cast("int").alias("end"),
                        p["m"].alias("match"), p["g"].alias("grp"))

    folded = F.transform(F.arrays_zip(ends.alias("e"), whole.alias("m"), grp.alias("g")), item)
    return F.when(F.size(whole) > 0, folded).otherwise(empty)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an int array: sums inside blocks of about sqrt(n) values plus the blocks before."""
    def total(arr):
        return F.aggregate(arr, F.lit(0), lambda acc, x: acc + x)

    def blocked(v):
        n = F.size(v)
        step = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        block = lambda i: F.floor(i / step).cast("int")
        sums = F.transform(F.sequence(F.lit(0), block(F.greatest(n - 1, F.lit(0)))), lambda b: total(F.slice(v, b * step + 1, step)))
        before = bind(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return bind(before, lambda q: F.transform(v, lambda _, i: F.get(q, block(i)) + total(F.slice(v, block(i) * step + 1, i % step + 1))))

    return bind(values, blocked)


def regex_matches_df(df, text_col: str, specs: list[tuple[str, int, str | None, str]]):
    """Add one match-offsets column per spec ``(pattern, group, guard, out)``.

    Two projections in total: all match arrays first, then all offsets, so
    every regex runs once per row and the plan stays small.
    """
    from .memo import memo_columns
    arrays, groups, offs = memo_columns(("matches", text_col, tuple(specs)), lambda: _match_columns(text_col, specs))
    staged = df.select("*", *arrays)
    if groups:
        staged = staged.select("*", *groups)
    drop = [f"_{out}_w" for _, _, _, out in specs] + [f"_{out}_g" for _, g, _, out in specs if g]
    return staged.select("*", *offs).drop(*drop)


def _match_columns(text_col: str, specs):
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    arrays = []
    for pattern, group, guard, out in specs:
        whole, _ = match_arrays(F.col(text_col), pattern, group)
        if guard is not None:
            whole = F.when(text.rlike(guard), whole).otherwise(none)
        arrays.append(whole.alias(f"_{out}_w"))
    groups = []
    for pattern, group, guard, out in specs:
        if group:
            g = F.when(F.size(F.col(f"_{out}_w")) > 0,
                       F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
            groups.append(g.alias(f"_{out}_g"))
    offs = [match_offsets(F.col(text_col), F.col(f"_{out}_w"), F.col(f"_{out}_g" if group else f"_{out}_w"),
                          pattern).alias(out) for pattern, group, guard, out in specs]
    return arrays, groups, offs


def regex_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Single-expression form for small inputs (the match array is evaluated more than once)."""
    whole, grp = match_arrays(text, pattern, group)
    return match_offsets(text, whole, grp, pattern)


def first_match(text: Column, pattern: str) -> Column:
    """``struct<start,end,match>`` of the first match (``re.search``), or null."""
    t = F.coalesce(text, F.lit(""))
    m = F.regexp_extract(t, pattern, 0)
    found = t.rlike(pattern)
    start = F.length(F.element_at(F.split(t, pattern, 2), 1))
    return F.when(found, F.struct(start.cast("int").alias("start"),
                                  (start + F.length(m)).cast("int").alias("end"),
                                  m.alias("match")))
