"""Source text to rows of the extracted tables, one extractor for each language.

Extractors are lenient: a file that does not parse gives the rows of what can be recognised in it.
"""
from __future__ import annotations

from collections.abc import Callable

from .golang import extract_go
from .python import extract_python
from .rows import Rows
from .rust import extract_rust
from .typescript import extract_typescript

#: Extractor of every language; further ones may be registered here.
EXTRACTORS: dict[str, Callable[[str, Rows], None]] = {"go": extract_go, "rust": extract_rust, "typescript": extract_typescript, "python": extract_python}
#: Goes up with every change of the rows an extractor gives, so cached rows of older versions are not used.
VERSION = 2


def extract(language: str, file: str, text: str) -> Rows:
    """Rows of one file; Windows line ends are kept inside texts."""
    rows = Rows(file)
    EXTRACTORS[language](text.removeprefix("﻿"), rows)
    return rows


__all__ = ["EXTRACTORS", "VERSION", "Rows", "extract"]
