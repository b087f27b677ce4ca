"""Command line: ``python -m sylvan.cli [--format table|json|csv] [--langs] [--watch] [--cache] <query> [path]``."""
from __future__ import annotations

import sys
from pathlib import Path

from .plans import EngineError, PlanError, QuerySyntaxError, parse_query
from .sinks import validate_format, write_result
from .sources.cache import default_folder
from .sources.walk import detect_languages, supported_languages


class Usage(Exception):
    pass


def parse_args(argv: list[str]) -> dict[str, object]:
    opts: dict[str, object] = {"format": "table", "langs": False, "watch": False, "cache": False}
    rest: list[str] = []
    args = iter(argv)
    for a in args:
        if a == "--format":
            opts["format"] = next(args, None)
            if opts["format"] is None:
                raise Usage("--format requires a value")
        elif a in ("--langs", "--watch", "--cache"):
            opts[a[2:]] = True
        elif a.startswith("--"):
            raise Usage(f"unknown flag {a}")
        else:
            rest.append(a)
    if opts["langs"]:
        return opts
    if not rest:
        raise Usage("query is required")
    if len(rest) > 2:
        raise Usage("expected <query> [path]")
    try:
        validate_format(str(opts["format"]))
    except ValueError as e:
        raise Usage(str(e)) from e
    root = Path(rest[1] if len(rest) == 2 else ".")
    if not root.exists():
        raise Usage(f'path "{root}" does not exist')
    return opts | {"query": rest[0], "root": root.resolve()}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sylvan").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    try:
        o = parse_args(sys.argv[1:] if argv is None else argv)
    except Usage as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if o["langs"]:
        out.writelines(f"{x}\n" for x in supported_languages())
        return 0
    query, root, form = str(o["query"]), o["root"], str(o["format"])
    cache = default_folder(root) if o["cache"] else None
    try:
        if o["watch"]:
            from .streaming.watch import watch

            watch(spark or session(), query, root, form, out, cache)
            return 0
        if not detect_languages(root):
            print(f"warning: no supported source files found in {root}", file=sys.stderr)
        parse_query(query)  # no session is started for a query that does not parse
        from .engine import Engine

        engine = Engine.from_path(spark or session(), root, cache=cache, warn=True)
        write_result(engine.sql(query), form, out)
        engine.close()
    except QuerySyntaxError as e:
        print(e.render(), file=sys.stderr)
        return 1
    except (PlanError, EngineError) as e:
        print(e, file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001
        print(e if str(e).startswith("error") else f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
