"""The query dialect: text to syntax tree to DataFrame plan."""
from .compiler import compile_query
from .diagnostics import EngineError, PlanError, QuerySyntaxError
from .parser import parse_query
from .render import plan_text

__all__ = ["EngineError", "PlanError", "QuerySyntaxError", "compile_query", "parse_query", "plan_text"]
