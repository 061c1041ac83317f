"""Scalar text helpers as Spark Columns (all JVM-side, no Python UDF)."""
from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import LABEL_ALIASES, LABEL_PREFIX, WS_CLASS


def col_or_lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bind(col: Column, then: Callable[[Column], Column]) -> Column:
    """``then(col)`` with ``col`` evaluated once per row, however often ``then`` uses it inside lambdas."""
    return F.get(F.transform(F.array(col), lambda x: then(x)), F.lit(0))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Unicode case folding: characters that fold to one character, what they fold to, and those that fold to more."""
    pairs = [(chr(c), chr(c).casefold()) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    changed = [(c, f) for c, f in pairs if c != f]
    one = [(c, f) for c, f in changed if len(f) == 1]
    return "".join(c for c, _ in one), "".join(f for _, f in one), {c: f for c, f in changed if len(f) > 1}


def fold(c: Column) -> Column:
    """``str.casefold()``: one translation, and a look-up of the few characters that fold to several.

    Texts of one byte a character need ``lower`` only.
    """
    single, folded, several = _fold_tables()
    cut = F.regexp_extract_all(c, F.lit(f"[{''.join(several)}]|[^{''.join(several)}]+"), F.lit(0))
    spelt = F.array_join(F.transform(cut, lambda x: F.coalesce(_map_lit(several)[x], x)), "")
    spelt = F.when(c.rlike(f"[{''.join(several)}]"), spelt).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(spelt, single, folded))


def py_strip(c: Column) -> Column:
    """``str.strip()`` with no argument: Unicode whitespace on both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS_CLASS}+|{WS_CLASS}+$", "")


def collapse_ws(c: Column) -> Column:
    """Whitespace runs become one space, ends stripped (split/join idiom)."""
    return F.btrim(F.regexp_replace(c, rf"(?U){WS_CLASS}+", " "), F.lit(" "))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def lstrip_len(c: Column, chars: str) -> Column:
    """Number of leading characters of ``c`` that belong to ``chars``."""
    return F.length(c) - F.length(F.ltrim(c, F.lit(chars)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def normalize_free_text(c: Column) -> Column:
    return fold(collapse_ws(c))


def normalize_entity(label: Column, text: Column) -> Column:
    """Key under which two surface forms are the same entity."""
    value = collapse_ws(text)
    d = digits(value)
    phone = F.when(d.startswith("39") & (F.length(d) > 10), F.substring(d, 3, 1 << 30)).otherwise(d)
    return (
        F.when(label == "private_email", fold(value))
        .when(label == "private_phone", phone)
        .when(label == "private_id", F.upper(F.regexp_replace(value, r"(?U)[\s./-]", "")))
        .otherwise(fold(value))
    )


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def canonical_label(label: Column) -> Column:
    return F.coalesce(_map_lit(LABEL_ALIASES)[label], label)


def label_prefix(label: Column) -> Column:
    return F.coalesce(_map_lit(LABEL_PREFIX)[label], F.upper(label))


def map_lookup(d: dict, key: Column, default: Column | None = None) -> Column:
    return F.coalesce(_map_lit(d)[key], key if default is None else default)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_with_dot(name: Column) -> Column:
    """``os.path.splitext(name)[1]``: ``''`` when there is none, ``'.'`` for ``a.``.

    Leading dots of the name are not an extension (``.bashrc`` has none).
    """
    return F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)


def extension(name: Column) -> Column:
    """Lower-cased extension without the dot."""
    return F.lower(F.substring(extension_with_dot(name), 2, 1 << 30))


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension_with_dot(name)))
