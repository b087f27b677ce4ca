"""Source files made from a table of numbers, in four languages: text whose rows are known without reading it.

Every row gives a Go, a Rust, a TypeScript and a Python file. ``k`` numbers the file, ``s`` stands in some of its texts, and
``n`` repeats one block, so that counts, lines and measures differ from file to file.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SCHEMAS

#: Texts of the four files: $k and $s stand for the numbers, the part between << and >> is repeated n times.
TEXTS = {
    "go": """// Package made holds part $k.
package made

import (
	"fmt"
	store "example.com/store/v$s"
)

// Part$k is one part.
type Part$k struct {
	Width, Height int
	Name string
<<	Note string
>>}

var limit map[string]int

func (p *Part$k) Check(low, high int, name string) (int, error) {
	defer store.Close()
	total := low
<<	if total > high {
		total = fmt.Len(name)
	}
>>	for i := range name {
		total = add(total, i)
	}
	// adds no more
	return total, nil
}
""",
    "rs": """use std::fmt;
use crate::store::Shelf as Rack;

/// Part number $k.
pub struct Part$k {
    width: u32,
<<    note: u8,
>>}

impl fmt::Display for Part$k {}
impl Priced<u32> for Part$k {}

static LIMIT: u32 = $s;

fn check(part: &Part$k, low: u32) -> Result<u32, Fault> {
    let mut total: u32 = load(low)?;
<<    if total > low {
        total = low;
    }
>>    while total < LIMIT {
        for step in 0..low {
            total = part.grow(step);
        }
        total += 1;
    }
    // the end
    return Ok(total);
}
""",
    "ts": """import { open } from "fs";
import * as rack from "./rack$s";

/** Part $k in a box. */
export class Part$k extends Thing implements Priced, Named {
  width = 1;
<<  note: string;
>>  private check(low: number, high?: number): number {
    if (low && high) {
      return rack.find(low);
    }
    throw new Fault();
  }
}

export function load(path: string): string {
  const file = open(path);
<<  for (const part of file) {
    close(part);
  }
>>  // done
  return file;
}
""",
    "py": """import os
from store.rack import Shelf

#: Part number $k
class Part$k(Thing, Priced):
    def check(self, low, *rest, high=1):
        try:
            total = low + $s
        except ValueError:
            raise
<<        if total and low:
            total = len(rest)
>>        return total

    def _load(self) -> int:
        while self.more():
            self.step()
        # done
        return 0
""",
}


def _text(template: str, k: Column, s: Column, n: Column) -> Column:
    pieces = []
    for i, part in enumerate(template.replace(">>", "<<").split("<<")):
        filled = F.replace(F.replace(F.lit(part), F.lit("$k"), k.cast("string")), F.lit("$s"), s.cast("string"))
        pieces.append(F.repeat(filled, n.cast("int")) if i % 2 else filled)
    return F.concat(*pieces)


def made_sources(df: DataFrame, k: str, s: str, n: Column) -> DataFrame:
    """(file, text): four files for each row, in folders by the hundred of ``k``; built in the JVM, without a shuffle."""
    files = [F.struct(F.format_string(f"made%d/p%d.{end}", F.floor(F.col(k) / 100), F.col(k)).alias("file"), _text(t, F.col(k), F.col(s), n).alias("text")) for end, t in TEXTS.items()]
    return df.select(F.explode(F.array(*files)).alias("f")).select("f.*")


#: What the files hold, as SQL over p (k, s, n) and t (j) for what is repeated: {table: [(ending, columns behind the file, repeated?)]}.
ROWS = {
    "functions": [
        ("go", "17 + n AS line, 'Check' AS name, 'public' AS visibility, 2 AS param_count, '(int, error)' AS return_type, 3 + n AS complexity, false AS has_test", False),
        ("rs", "14 + n, 'check', 'private', 2, 'Result<u32, Fault>', 3 + n, false", False),
        ("ts", "7 + n, 'check', 'private', 2, '', 3, false", False),
        ("ts", "15 + n, 'load', 'public', 1, 'string', 1 + n, false", False),
        ("py", "6, 'check', 'public', 4, '', 2 + 2 * n, false", False),
        ("py", "13 + 2 * n, '_load', 'private', 1, 'int', 2, false", False),
    ],
    "calls": [
        ("go", "18 + n AS line, 'Check' AS caller, 'store.Close' AS callee, true AS is_external", False),
        ("go", "21 + n + 3 * j, 'Check', 'fmt.Len', true", True),
        ("go", "21 + 4 * n, 'Check', 'add', false", False),
        ("rs", "15 + n, 'check', 'load', false", False),
        ("rs", "18 + 4 * n, 'check', 'part.grow', true", False),
        ("rs", "23 + 4 * n, 'check', 'Ok', false", False),
        ("ts", "9 + n, 'check', 'rack.find', true", False),
        ("ts", "16 + n, 'load', 'open', false", False),
        ("ts", "18 + n + 3 * j, 'load', 'close', false", True),
        ("py", "12 + 2 * j, 'check', 'len', false", True),
        ("py", "14 + 2 * n, '_load', 'self.more', true", False),
        ("py", "15 + 2 * n, '_load', 'self.step', true", False),
    ],
    "imports": [
        ("go", "5 AS line, 'fmt' AS module, '' AS alias, true AS is_std", False),
        ("go", "6, 'example.com/store/v' || s, 'store', false", False),
        ("rs", "1, 'std::fmt', '', true", False),
        ("rs", "2, 'crate::store::Shelf', 'Rack', false", False),
        ("ts", "1, 'fs', '', true", False),
        ("ts", "2, './rack' || s, 'rack from \"./rack' || s || '\"', false", False),
        ("py", "1, 'os', '', true", False),
        ("py", "2, 'store.rack', '', false", False),
    ],
    "structs": [
        ("go", "10 AS line, 'Part' || k AS name, 2 + n AS field_count, 'public' AS visibility, '' AS implements", False),
        ("rs", "5, 'Part' || k, 1 + n, 'public', 'Display,Priced'", False),
        ("ts", "5, 'Part' || k, 2 + n, 'public', 'Priced,Named'", False),
        ("py", "5, 'Part' || k, 2, 'public', 'Thing,Priced'", False),
    ],
    "variables": [
        ("go", "15 + n AS line, 'limit' AS name, 'map[string]int' AS type_hint, 'package' AS scope, false AS is_mutated", False),
        ("go", "19 + n, 'total', '', 'function', true", False),
        ("rs", "12 + n, 'LIMIT', 'u32', 'module', true", False),
        ("rs", "15 + n, 'total', 'u32', 'function', true", False),
        ("ts", "16 + n, 'file', '', 'function', false", False),
        ("py", "8, 'total', '', 'function', true", False),
        ("py", "12 + 2 * j, 'total', '', 'function', true", True),
    ],
    "comments": [
        ("go", "1 AS line, '// Package made holds part ' || k || '.' AS text, '' AS attached_to, true AS is_doc", False),
        ("go", "9, '// Part' || k || ' is one part.', '', true", False),
        ("go", "23 + 4 * n, '// adds no more', '', false", False),
        ("rs", "4, '/// Part number ' || k || '.', '', true", False),
        ("rs", "22 + 4 * n, '// the end', '', false", False),
        ("ts", "4, '/** Part ' || k || ' in a box. */', '', true", False),
        ("ts", "17 + 4 * n, '// done', '', false", False),
        ("py", "4, '#: Part number ' || k, '', true", False),
        ("py", "16 + 2 * n, '# done', '', false", False),
    ],
    "fn_fingerprints": [
        ("go", "17 + n AS line, 'Check' AS name, 2 AS param_count, 3 + n AS complexity, 0 AS nesting_depth, n AS branch_count, 1 AS loop_count, 2 + n AS call_count, 0 AS unique_callee_count, 1 AS return_count, 5 + 2 * n AS stmt_count, true AS has_error_handling", False),
        ("rs", "14 + n, 'check', 2, 3 + n, 1, n, 2, 3, 0, 1, 9 + 3 * n, true", False),
        ("ts", "7 + n, 'check', 2, 3, 0, 1, 0, 1, 0, 1, 3, true", False),
        ("ts", "15 + n, 'load', 1, 1 + n, 0, 0, n, 1 + n, 0, 1, 2 + 2 * n, false", False),
        ("py", "6, 'check', 4, 2 + 2 * n, 0, 1 + n, 0, n, 0, 1, 5 + 3 * n, true", False),
        ("py", "13 + 2 * n, '_load', 1, 2, 0, 0, 1, 2, 0, 1, 3, false", False),
    ],
}


def made_sql(table: str, source: str) -> str:
    """SQL of a table extracted from the files of ``source``, a SELECT of k, s and n."""
    rows = [f"SELECT 'made' || k // 100 || '/p' || k || '.{end}' AS file, {columns} FROM p{', range(n::BIGINT) AS t(j)' if repeated else ''}" for end, columns, repeated in ROWS[table]]
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    columns = ", ".join(f"{f.name}::{kinds[f.dataType.simpleString()]} AS {f.name}" for f in SCHEMAS[table].fields)
    return f"SELECT {columns} FROM (WITH p AS ({source}) {' UNION ALL '.join(rows)})"
