"""Command line: audit transcripts, or read the history log."""

from __future__ import annotations

import argparse
import os
import posixpath
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from castellan import __version__
from castellan.rules.catalog import LETTERS, SEVERITIES
from castellan.sources import history, transcripts

PROG = "castellan"
# Exit codes.
FINE, REACHED, WRONG = 0, 1, 2
NEVER = ("none", "off", "never")

#: (flags, settings) of every option.
OPTIONS: tuple[tuple[tuple[str, ...], dict], ...] = (
    (("targets",), {"nargs": "*", "help": "transcript files, globs or folders; also URIs of any file system Spark reads"}),
    (("--project-root",), {"metavar": "PATH", "help": "project root of every session, instead of the inferred one"}),
    (("--tail-limit",), {"type": int, "default": 0, "metavar": "N", "help": "with --tail: only the N newest entries"}),
    (("--sort",), {"choices": ("severity", "path"), "default": "severity", "help": "with --summary: order of the rows"}),
    (("--min-grade",), {"metavar": "LETTER", "help": "with --summary: only sessions of this grade or worse"}),
    (("--fail-on",), {"default": "high", "metavar": "SEVERITY", "help": "exit 1 if any finding is this severe (none: never)"}),
    (("--out",), {"metavar": "PATH", "help": "write the report to a file"}),
    (("--documents",), {"metavar": "FOLDER", "help": "write one JSON document a session into a folder, from the executors"}),
    (("--no-color",), {"action": "store_true", "help": "no ANSI colors"}),
    (("--version",), {"action": "version", "version": f"{PROG} {__version__}"}),
)
FORMS = {"json": "JSON report", "summary": "one line per session", "tail": "print the history log, newest first"}


class Misuse(Exception):
    """What is wrong with a call, a line each."""

    def __init__(self, *complaints: str):
        super().__init__("\n".join(complaints))
        self.complaints = complaints


@dataclass
class Request:
    """A call whose options hold."""

    form: str
    paths: list[str]
    root: str | None
    threshold: int | None
    floor: str
    options: argparse.Namespace = field(repr=False)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=PROG, description="Audit of coding-agent session transcripts.")
    for flags, settings in OPTIONS:
        p.add_argument(*flags, **settings)
    forms = p.add_mutually_exclusive_group()
    for name, help_ in FORMS.items():
        forms.add_argument(f"--{name}", action="store_const", dest="form", const=name, default="human", help=help_)
    return p


# -- what each option must be: a value, or Misuse ---------------------------------------


def _threshold(text: str) -> int | None:
    name = text.strip().lower()
    if name not in (*NEVER, *SEVERITIES):
        raise Misuse(f"--fail-on takes {', '.join(SEVERITIES)} or none, not {text!r}")
    return None if name in NEVER else SEVERITIES.index(name)


def _floor(text: str | None, form: str) -> str:
    if text is None:
        return ""
    if form != "summary":
        raise Misuse("--min-grade needs --summary")
    letter = text.strip().upper()
    if letter not in dict(LETTERS):
        raise Misuse(f"--min-grade takes {', '.join(x for x, _ in LETTERS)}, not {text!r}")
    return letter


def _root(text: str | None) -> str | None:
    """The root in the form that paths of transcripts have."""
    if text is None:
        return None
    full = os.path.expanduser(text)
    drive = re.fullmatch(r"([A-Za-z]):[\\/]+(.*)", full, re.DOTALL)
    if drive:
        full = f"/{drive[1].lower()}/" + drive[2].replace("\\", "/")
    if not full.startswith("/"):
        raise Misuse(f"--project-root takes a whole path, as transcripts have it, not {text!r}")
    return posixpath.normpath(full)


def _paths(targets: list[str]) -> list[str]:
    if not targets:
        raise Misuse("name transcripts to audit, or --tail for the history log")
    lost = [t for t in targets if "://" not in t and not set(t) & set(transcripts.PATTERN_SIGNS) and not os.path.exists(t)]
    if lost:
        raise Misuse(*(f"nothing at {t}" for t in lost))
    found = transcripts.discover(targets, _session() if any("://" in t for t in targets) else None)
    if not found:
        raise Misuse("the targets hold no .jsonl transcripts")
    shut = [p for p in found if "://" not in p and not os.access(p, os.R_OK)]
    if shut:
        raise Misuse(*(f"no right to read {p}" for p in shut))
    return found


def _request(argv: list[str] | None) -> Request:
    o = _parser().parse_args(argv)
    if o.form == "tail":
        return Request(o.form, [], None, None, "", o)
    return Request(form=o.form, threshold=_threshold(o.fail_on), floor=_floor(o.min_grade, o.form), root=_root(o.project_root), paths=_paths(o.targets), options=o)


# -- answers ----------------------------------------------------------------------------


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(PROG).config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _history(limit: int) -> Iterator[str]:
    """The log as it is shown: a heading, then entries from the newest on."""
    path = history.default_log()
    if not os.path.exists(path):
        yield f"{PROG}: no history log yet at {path}\n"
        return
    if not os.access(path, os.R_OK):
        raise Misuse(f"no right to read {path}")
    entries = history.newest_first(_session(), path)
    total = entries.count()
    if not total:
        yield f"{PROG}: history log at {path} is empty\n"
        return
    shown = min(limit, total) if limit > 0 else total
    yield f"{PROG}: {shown} of {total} logged session(s), newest first\n\n"
    for r in entries.limit(shown).toLocalIterator():
        yield r.entry + "\n"


def _put(parts: Iterable[str], path: str | None) -> None:
    """Writes a report part by part, with one line end behind it."""
    try:
        out = open(path, "w", encoding="utf-8") if path else sys.stdout
    except OSError as e:
        raise Misuse(f"--out can't be written: {e}") from None
    held = ""
    for part in parts:
        whole = held + part
        kept = whole.rstrip("\n") if path else whole
        out.write(kept)
        held = whole[len(kept) :]
    out.write("\n")
    if path:
        out.close()


def _audited(request: Request) -> int:
    from pyspark.sql import functions as F

    from castellan.operators.tables import cut
    from castellan.plans import audit, report

    o = request.options
    done = audit.scan(_session(), request.paths, request.root)
    done = done._replace(findings=cut(done.findings), results=cut(done.results))
    if o.documents:
        report.write_documents(done, o.documents)
    color = not (o.no_color or o.out or "NO_COLOR" in os.environ) and sys.stdout.isatty()
    forms = {
        "json": lambda: report.render_json(done),
        "summary": lambda: report.render_summary(done, color, o.sort, request.floor),
        "human": lambda: report.render_human(done, color),
    }
    _put(forms[request.form](), o.out)
    worst = done.findings.agg(F.max("severity").alias("worst")).first().worst
    return REACHED if None not in (request.threshold, worst) and worst >= request.threshold else FINE


def main(argv: list[str] | None = None) -> int:
    """0; 1 if a finding reaches --fail-on; 2 for wrong use or unreadable files."""
    try:
        request = _request(argv)
        if request.form != "tail":
            return _audited(request)
        for part in _history(request.options.tail_limit):
            sys.stdout.write(part)
        return FINE
    except Misuse as e:
        for line in e.complaints:
            print(f"{PROG}: {line}", file=sys.stderr)
        return WRONG


if __name__ == "__main__":
    raise SystemExit(main())
