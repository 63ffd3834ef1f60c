"""Command line: select from one page and print.

    python -m sparkdom.cli --selector "h1" --format text page.html

The page goes through the same parse stage as tables do, as a table of one row, unless
--local asks for no Spark.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from sparkdom import __version__
from sparkdom.plans.css import SelectorError, parse_selector
from sparkdom.plans.targeted import compile_targeted, stops_early
from sparkdom.ship import ship

USAGE = """Usage: sparkdom [options] <path|->

Options:
  --selector <css>         select nodes (default: the document)
  --format <fmt>           html, text or markdown (default: html)
  --outer, --inner         html with or without the node's own tags (default: outer)
  --attr <name>            print attribute values; may be repeated
  --missing <value>        stands for a missing attribute (default: __MISSING__)
  --first                  the first match only
  --limit <n>              the first n matches only
  --separator <s>          between records (escapes: \\n \\r \\t \\\\ \\0)
  --field-separator <s>    between attributes (default: \\t)
  --whitespace <mode>      normalize or preserve, for text (default: normalize)
  --count                  print the number of matches
  --local                  without Spark
  --version, -h, --help"""
VALUED = ("selector", "format", "attr", "missing", "limit", "separator", "field-separator", "whitespace")
FLAGS = ("outer", "inner", "first", "count", "local")
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", "0": "\0"}
MOST = 2**63 - 1


class Stop(Exception):
    def __init__(self, code: int, message: str = "", out: str = ""):
        super().__init__(message)
        self.code, self.out = code, out


@dataclass
class Options:
    given: dict[str, str | bool] = field(default_factory=dict)
    attrs: list[str] = field(default_factory=list)
    path: str | None = None
    inner: bool = False
    limit: int | None = None
    separator: str | None = None
    field_separator: str = "\t"

    def get(self, name: str, default=None):
        return self.given.get(name, default)


def escapes(value: str, option: str) -> str:
    out, chars = [], iter(value)
    for c in chars:
        if c == "\\":
            e = next(chars, None)
            if e is None:
                raise Stop(1, f"Invalid --{option} value: incomplete escape at end")
            if e not in ESCAPES:
                raise Stop(1, f"Invalid --{option} escape: \\{e}")
            c = ESCAPES[e]
        out.append(c)
    return "".join(out)


def limit_of(raw: str) -> int:
    if not (raw.isascii() and raw.isdigit()) or int(raw) < 1:
        raise Stop(1, f"Invalid value for --limit: {raw}")
    if int(raw) > MOST:
        raise Stop(1, f"Value for --limit is too large: {raw}")
    return int(raw)


def read_args(argv: list[str]) -> Options:
    o, rest = Options(), iter(argv)
    for arg in rest:
        if arg in ("-h", "--help"):
            raise Stop(0, out=USAGE)
        if arg == "--version":
            raise Stop(0, out=f"sparkdom {__version__}")
        name, eq, value = arg[2:].partition("=") if arg.startswith("--") else ("", "", "")
        if name in FLAGS and not eq:
            o.given[name] = True
            if name in ("inner", "outer"):
                o.inner = name == "inner"
        elif name in VALUED:
            if not eq:
                value = next(rest, None)
                if value is None:
                    raise Stop(1, f"Missing value for --{name}")
            if name == "attr":
                if not value:
                    raise Stop(1, "Invalid value for --attr: ")
                o.attrs.append(value.lower())
            elif name == "limit":
                o.limit = limit_of(value)
            elif name == "separator":
                o.separator = escapes(value, name)
            elif name == "field-separator":
                o.field_separator = escapes(value, name)
            o.given[name] = value
        elif arg.startswith("--"):
            raise Stop(1, f"Unknown option: {arg}\n{USAGE}")
        elif o.path is None:
            o.path = arg
        else:
            raise Stop(1, f"Unexpected argument: {arg}\n{USAGE}")
    validate(o)
    return o


def validate(o: Options) -> None:
    def any_of(*names: str) -> bool:
        return any(n in o.given for n in names)

    if o.path is None:
        raise Stop(1, USAGE)
    if (mode := o.get("whitespace", "normalize")) not in ("normalize", "preserve"):
        raise Stop(1, f"Invalid value for --whitespace: {mode} (expected normalize or preserve)")
    if any_of("count") and any_of("first", "limit", "format", "attr", "separator"):
        raise Stop(1, "--count cannot be combined with --first, --limit, --format, --attr, or --separator")
    if any_of("first") and any_of("limit"):
        raise Stop(1, "--first cannot be combined with --limit")
    if any_of("attr") and any_of("format", "inner", "outer", "count"):
        raise Stop(1, "--attr cannot be combined with --format, --inner, --outer, or --count")
    if any_of("field-separator") and not o.attrs:
        raise Stop(1, "--field-separator requires --attr")
    if any_of("whitespace") and (o.get("format", "html") != "text" or o.attrs or any_of("count")):
        raise Stop(1, "--whitespace requires --format text")
    if (fmt := o.get("format", "html")) not in ("html", "text", "markdown"):
        raise Stop(1, f"Unknown format: {fmt}\n{USAGE}")


def matches(o: Options, data: bytes) -> list[dict]:
    """The matches' fields, through Spark or without it."""
    selector = o.get("selector") or None
    limit = 1 if o.get("first") else o.limit
    targeted = False
    if selector is not None:
        try:
            targeted = not o.get("count") and stops_early(compile_targeted(selector), limit)
        except SelectorError:
            parse_selector(selector)
    fields = ["pos", "attrs"] if o.attrs else ["pos"] if o.get("count") else ["pos", {"html": "pretty_children" if o.inner else "pretty_html", "text": "extracted" if o.get("whitespace") == "preserve" else "text", "markdown": "markdown"}[o.get("format", "html")]]
    text = data.decode("utf-8", "replace")
    from sparkdom.operators.select import select, select_local

    if o.get("local"):
        return select_local(text, selector, fields, limit)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").getOrCreate()
    ship(spark)
    df = spark.createDataFrame([(0, text)], "page_id long, html string")
    return [r.asDict() for r in select(df, selector, fields, limit=limit, targeted=targeted, prefilter=False).orderBy("pos").collect()]


def run(argv: list[str], stdin: bytes | None = None) -> tuple[int, str, str]:
    """(exit code, output, message): 0 fine, 1 no match or wrong use, 2 a bad selector."""
    try:
        o = read_args(argv)
        try:
            data = (sys.stdin.buffer.read() if stdin is None else stdin) if o.path == "-" else open(o.path, "rb").read()
        except OSError:
            raise Stop(1, f"Failed to read file: {o.path}") from None
        try:
            found = matches(o, data)
        except SelectorError as e:
            raise Stop(2, str(e)) from None
        if o.get("count"):
            return 0, f"{len(found)}\n", ""
        if not found:
            return 1, "", ""
        if o.attrs:
            missing = o.get("missing", "__MISSING__")
            records = [o.field_separator.join((r["attrs"] or {}).get(a, missing) or "" if a in (r["attrs"] or {}) else missing for a in o.attrs) for r in found]
        else:
            records = [next(v for k, v in r.items() if k not in ("page_id", "pos")) or "" for r in found]
        between = o.separator if o.separator is not None else "\n\n" if o.get("format") == "markdown" else "\n"
        return 0, between.join(records) + "\n", ""
    except Stop as e:
        return e.code, e.out + "\n" * bool(e.out), f"{e}\n" if str(e) else ""


def main() -> None:
    code, out, message = run(sys.argv[1:])
    sys.stdout.write(out)
    sys.stderr.write(message)
    sys.exit(code)


if __name__ == "__main__":
    main()
