"""The nine code tables: one source of truth for columns, order and types."""
from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"S": T.StringType(), "L": T.LongType(), "B": T.BooleanType(), "D": T.DoubleType()}

#: Columns of the tables in their order; S text, L bigint, B boolean, D double.
COLUMNS = {
    "functions": "file S, line L, name S, visibility S, param_count L, return_type S, complexity L, has_test B",
    "calls": "file S, line L, caller S, callee S, is_external B",
    "imports": "file S, line L, module S, alias S, is_std B",
    "structs": "file S, line L, name S, field_count L, visibility S, implements S",
    "variables": "file S, line L, name S, type_hint S, scope S, is_mutated B",
    "comments": "file S, line L, text S, attached_to S, is_doc B",
    "fn_fingerprints": "file S, line L, name S, param_count L, complexity L, nesting_depth L, branch_count L, loop_count L, call_count L, unique_callee_count L, return_count L, stmt_count L, has_error_handling B",
    "fn_callsets": "file S, line L, name S, callee S",
    "similarities": "file_a S, line_a L, name_a S, file_b S, line_b L, name_b S, structural_score D, behavioral_score D, combined_score D",
}
SCHEMAS = {t: T.StructType([T.StructField(n, _TYPES[k], False) for n, k in (c.split() for c in cols.split(", "))]) for t, cols in COLUMNS.items()}
#: Tables that extraction writes; the others derive from them.
EXTRACTED = ("functions", "calls", "imports", "structs", "variables", "comments", "fn_fingerprints")


def function_columns() -> list[str]:
    """Columns of ``functions`` in order."""
    return SCHEMAS["functions"].names
