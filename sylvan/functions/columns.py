"""Scalar helpers used by several operators."""
from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters the list normaliser trims (Unicode white space, not only blanks).
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_path(c: Column | str) -> Column:
    """Forward slashes and no leading ``./``; null stays null."""
    return F.regexp_replace(F.translate(_col(c), "\\", "/"), r"^(?:\./+)+", "")


def blank_to_null(c: Column | str) -> Column:
    """Text trimmed of white space; empty becomes null."""
    t = F.btrim(_col(c), F.lit(WHITE))
    return F.when(t != "", t)


def lower_ascii(c: Column | str) -> Column:
    """Lower case of A-Z only, whatever the locale."""
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def dirname(c: Column | str) -> Column:
    """Everything before the last slash, '' for files at the root."""
    return F.regexp_extract(_col(c), r"(?s)^(.*)/[^/]*$", 1)


def test_key(c: Column | str) -> Column:
    """Name of the function that a test's name points to, null if it is no test name.

    First rule that fits: prefix ``test_``, suffix ``_test``, prefix ``Test`` with something behind it.
    """
    c = _col(c)
    return (
        F.when(c.startswith("test_"), F.substring(c, 6, 1 << 30))
        .when(c.endswith("_test"), F.regexp_extract(c, r"(?s)^(.*)_test$", 1))
        .when(c.startswith("Test") & (F.length(c) > 4), F.substring(c, 5, 1 << 30))
    )


def normalize_list(c: Column | str, sep: str = ",") -> Column:
    """Split, trim, drop empty parts, keep the first of equal parts, join again."""
    parts = F.transform(F.split(_col(c), f"\\Q{sep}\\E"), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), sep)
