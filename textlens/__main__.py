"""Command line for one document: colored text, interchange JSON or findings.

textlens [--no-color] [FILE] | ir [FILE] | diagnose --json [FILE] | lint [FILE]; no
FILE or "-" is standard input, "--" ends the options. Markdown files are coloured and
linted without their code, markup and destinations. lint exits 1 when it finds
anything; wrong usage and text that isn't UTF-8 exit 2.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass
from pathlib import Path

FLAGS = {"color": {"--no-color"}, "ir": set(), "diagnose": {"--json"}, "lint": set()}


class UsageError(ValueError):
    pass


@dataclass(frozen=True)
class Call:
    command: str
    path: str | None = None
    flags: frozenset = frozenset()


def parse(args: list[str]) -> Call:
    """A command may only come first; a flag may be repeated; one FILE at most."""
    command, rest = (args[0], args[1:]) if args and args[0] in ("ir", "diagnose", "lint") else ("color", args)
    flags, files, options = set(), [], True
    for arg in rest:
        if options and arg == "--":
            options = False
        elif options and arg in ("-h", "--help", "-V", "--version"):
            return Call("version" if "V" in arg or "version" in arg else "help")
        elif options and arg.startswith("-") and arg != "-":
            if arg not in FLAGS[command]:
                raise UsageError(f"unknown option {arg}")
            flags.add(arg)
        else:
            files.append(arg)
    if command == "diagnose" and "--json" not in flags:
        raise UsageError("diagnose needs --json")
    if len(files) > 1:
        raise UsageError(f"unexpected argument {files[1]}")
    return Call(command, None if not files or files[0] == "-" else files[0], frozenset(flags))


def _print(call: Call, text: str) -> int:
    from pyspark.sql import SparkSession

    from pyspark.sql import functions as F

    from .operators import diagnose, interchange, lint, prose, render
    from .sources import documents

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    name = call.path or ("stdin" if call.command in ("ir", "diagnose") else "<stdin>")
    docs = documents.from_text(spark, text, name)
    read = prose.prose(docs.withColumn("format", documents.format_of_path(F.col("name"))))
    if call.command == "lint":
        lines = [r["line"] for r in lint.report_lines(read).orderBy("start", "rule").select("line").collect()]
        sys.stdout.writelines(line + "\n" for line in lines)
        return int(bool(lines))
    if call.command == "ir":
        good, refused = interchange.project(docs)
        found = interchange.canonical_json(good).first()
        if found is None:
            print(f"textlens: {refused.first()['message']}", file=sys.stderr)
            return 2
        sys.stdout.write(found["json"] + "\n")
    elif call.command == "diagnose":
        sys.stdout.write(diagnose.diagnose(docs).first()["report"] + "\n")
    else:
        sys.stdout.write(render.ansi(read).first()["colored"])
    return 0


def main(args: list[str]) -> int:
    try:
        call = parse(args)
        if call.command in ("help", "version"):
            print(__doc__ if call.command == "help" else "textlens 0.1")
            return 0
        text = (Path(call.path).read_bytes() if call.path else sys.stdin.buffer.read()).decode("utf-8")
    except (UsageError, OSError, UnicodeDecodeError) as e:
        print(f"textlens: {e}", file=sys.stderr)
        return 2
    if call.command == "color" and ("--no-color" in call.flags or os.environ.get("NO_COLOR")):
        sys.stdout.write(text)
        return 0
    return _print(call, text)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
