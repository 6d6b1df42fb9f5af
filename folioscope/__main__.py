"""The command line: ``python -m folioscope <tool> [--input value ...]``, ``serve``, ``index`` or ``audit <files>``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions import text as T
from .service import DocumentMemory
from .sources import files
from .surface.settings import Settings
from .surface.tools import TOOLS, failure, render


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="folioscope")
    commands = out.add_subparsers(dest="command", required=True)
    for name, tool in TOOLS.items():
        one = commands.add_parser(name.replace("_", "-"), help=tool.title)
        one.add_argument("--json", action="store_true", dest="as_json")
        for key, field in tool.takes.items():
            flag = f"--{key.replace('_', '-')}"
            one.add_argument(flag, action=argparse.BooleanOptionalAction, default=None) if field.kind is bool else one.add_argument(flag, type=field.kind)
    commands.add_parser("serve", help="HTTP")
    commands.add_parser("index", help="an index of all documents")
    commands.add_parser("audit", help="secrets and paths that may not be tracked").add_argument("pattern")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    command, as_json = given.pop("command"), given.pop("as_json", False)
    settings = Settings.read()
    spark = spark or SparkSession.builder.appName(settings.name).getOrCreate()
    memory = DocumentMemory(spark, settings.root, settings.authors, settings.imports)
    try:
        if command == "serve":
            from wsgiref.simple_server import make_server

            from .surface.web import Application

            make_server(settings.host, settings.port, Application(memory, settings)).serve_forever()
        elif command == "index":
            memory.reindex()
        elif command == "audit":
            n = 0
            for n, r in enumerate(T.audit_files(files.whole(spark, given["pattern"])).orderBy("path", "problem").toLocalIterator(), 1):
                print(f"{r['path']}: {r['problem']}")
            if not n:
                print("nothing found")
            return int(n > 0)
        else:
            name = command.replace("-", "_")
            out = TOOLS[name].call(memory, **{k: v for k, v in given.items() if v is not None})
            print(json.dumps(out, default=str) if as_json else render(name, out, settings.max_response_chars))
    except Exception as e:
        status, said = failure(e)
        if status == 500:
            raise
        print(f"{said['code']}: {said['error']}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
