"""Files of a source tree: ignore rules, languages, snapshots. Runs on the driver; only names and sizes are held."""
from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

#: Names that are always skipped, below the root; ignore files in rising precedence; languages by extension.
SKIPPED = frozenset(["target", "node_modules", ".venv", "venv", ".git", "vendor", "dist", "build", "__pycache__"])
IGNORE_FILES = (".gitignore", ".ignore", ".qlignore")
LANGUAGES = {".go": "go", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript", ".py": "python"}


class Found(NamedTuple):
    path: str
    file: str
    mtime_ns: int
    size: int


def language_of(path: str) -> str | None:
    """Language by the last extension, letters' case counts."""
    return LANGUAGES.get(os.path.splitext(os.path.basename(path))[1])


def supported_languages() -> list[str]:
    """``name (.ext, .ext)`` of every language."""
    by: dict[str, list[str]] = {}
    for ext, name in LANGUAGES.items():
        by.setdefault(name, []).append(ext)
    return [f"{name} ({', '.join(exts)})" for name, exts in by.items()]


@lru_cache(maxsize=4096)
def _glob(pattern: str) -> re.Pattern[str]:
    """An ignore pattern without its leading and trailing slash as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while pattern.startswith("**", i):
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out, re.DOTALL)


class IgnoreRules:
    """Rules of one ignore file; later lines win, ``!`` takes back."""

    def __init__(self, text: str):
        self.rules: list[tuple[bool, bool, re.Pattern[str], bool]] = []
        for line in text.removeprefix("﻿").splitlines():
            if not line or line.startswith("#"):
                continue
            line = re.sub(r"(?<!\\)[ \t]+$", "", line)
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/") if only_dirs else line
            anchored = "/" in line
            line = line.removeprefix("/")
            if line:
                self.rules.append((keep, only_dirs, _glob(line), anchored))

    def verdict(self, rel: str, is_dir: bool) -> bool | None:
        """True: ignored, False: taken back, None: nothing said. ``rel`` is relative to the file's folder."""
        name = rel.rpartition("/")[2]
        for keep, only_dirs, rx, anchored in reversed(self.rules):
            if (is_dir or not only_dirs) and rx.fullmatch(rel if anchored else name):
                return not keep
        return None


def _ignored(chain: list[tuple[str, list[IgnoreRules]]], rel: str, is_dir: bool) -> bool:
    """The nearest folder's files decide first, in each the strongest kind of file."""
    for base, files in reversed(chain):
        inside = rel[len(base) + 1 :] if base else rel
        for rules in reversed(files):
            said = rules.verdict(inside, is_dir)
            if said is not None:
                return said
    return False


def walk(root: str | Path) -> Iterator[Found]:
    """Regular files under ``root``, in name order: no hidden ones, none that is ignored, no links followed, what can't be read is passed over.

    A root that is a file is found as itself, under its own name.
    """
    root = os.fspath(root)
    if os.path.isfile(root):
        st = os.stat(root)
        yield Found(root, os.path.basename(root), st.st_mtime_ns, st.st_size)
        return

    def folder(path: str, rel: str, chain: list[tuple[str, list[IgnoreRules]]]) -> Iterator[Found]:
        try:
            with os.scandir(path) as it:
                entries = sorted(it, key=lambda e: e.name)
        except OSError:
            return
        names = {e.name for e in entries}
        files = []
        for n in IGNORE_FILES:
            if n in names:
                try:
                    files.append(IgnoreRules(Path(path, n).read_text(errors="replace")))
                except OSError:
                    pass
        here = [*chain, (rel, files)] if files else chain
        for e in entries:
            if e.name in SKIPPED or e.name.startswith("."):
                continue
            sub = f"{rel}/{e.name}" if rel else e.name
            try:
                is_dir, is_file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
                if not (is_dir or is_file) or _ignored(here, sub, is_dir):
                    continue
                if is_dir:
                    yield from folder(e.path, sub, here)
                else:
                    st = e.stat(follow_symlinks=False)
                    yield Found(e.path, sub, st.st_mtime_ns, st.st_size)
            except OSError:
                continue

    yield from folder(root, "", [])


def source_files(root: str | Path, warn: bool = False) -> list[Found]:
    """Files of a supported language; with ``warn`` every other extension is named once on stderr."""
    out, told = [], set()
    for f in walk(root):
        if language_of(f.file):
            out.append(f)
        elif warn and (ext := os.path.splitext(os.path.basename(f.file))[1]) not in told:
            told.add(ext)
            print(f"warning: no adapter for {ext}, skipping" if ext else "warning: no adapter for files without an extension, skipping", file=sys.stderr)
    return out


def detect_languages(root: str | Path) -> list[str]:
    """Languages present, sorted."""
    return sorted({language_of(f.file) for f in walk(root)} - {None})


def snapshot(root: str | Path) -> dict[str, int]:
    """Modification time of every source file; two snapshots are equal if nothing came, went or changed."""
    return {f.file: f.mtime_ns for f in source_files(root)}
