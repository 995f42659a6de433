"""Command line: ``python -m tsledger COMMAND ...``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from .errors import InvalidArgumentError, LedgerError
from .functions.timeconv import format_time
from .store import open as open_store
from .types import DataType, DeviceSchema


class UsageError(Exception):
    """A wrong command line."""


def count_of(n: int, what: str) -> str:
    return f"{n:,} {what}{'' if n == 1 else 's'}".replace(",", " ")


def size_of(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"


def _is_number(text: str) -> bool:
    return text.lstrip("-").isdigit()


def time_arg(text: str | None):
    """Whole numbers are raw stamps."""
    return None if text is None else int(text) if _is_number(text) else text


def assignments(schema: DeviceSchema, pairs: Sequence[str]) -> dict:
    from .sources.text import parse_cell

    out, types = {}, schema.types
    for pair in pairs:
        name, sign, text = pair.partition("=")
        if not sign:
            raise UsageError(f"{pair!r} is not COLUMN=VALUE")
        if name not in types:
            raise UsageError(f"device {schema.name!r} has no column {name!r}")
        out[name] = parse_cell(name, types[name], text)
    return out


def _stamp(schema: DeviceSchema, raw: int) -> str:
    return format_time(raw, schema.time_unit, schema.timezone)


def info(a) -> int:
    from .sources.footers import storage_by_column

    f = open_store(a.file)
    reader = f.reader()
    print(f"store:    {a.file} ({size_of(f.size)}{'' if f.finalized else ', with an unfinished commit: run recover'})")
    head = reader.head
    print("history:  no commits" if head is None else f"history:  {count_of(head.number, 'commit')}, head {head.hash}")
    for k, v in f.metadata.items():
        print(f"metadata: {k} = {v}")
    for d in reader.devices:
        n = f.count(d.name)
        print(f"\ndevice {d.name!r}: {count_of(n, 'point')}")
        if span := f.time_range(d.name):
            print(f"  time range:  {_stamp(d, span[0])} … {_stamp(d, span[1])}")
        blocks = reader.blocks(d.name)
        print(f"  storage:     {count_of(len(blocks), 'file')}, {size_of(sum(b.size for b in blocks))}")
        print(f"  {d.time_name:<20} time, unit {d.time_unit}" + (f", time zone {d.timezone}" if d.timezone else ""))
        for c in d.columns:
            print(f"  {c.name:<20} {c.type}")
        if blocks:
            print("  storage by column (all files, superseded rows too):")
            stored = {r.column: r for r in storage_by_column(reader.catalog, d.name).collect()}
            for name, kind in [("t", None), *((c.name, c.type) for c in d.columns)]:
                r = stored.get(name)
                if r:
                    plain = 0 if kind in (DataType.STRING, DataType.BOOL) else r.rows * (8 if kind is None else kind.plain_width)
                    ratio = f", K = {plain / r.stored:.2f}" if plain else ""
                    print(f"    {d.time_name if kind is None else name:<18} {size_of(r.stored)}, B = {r.bits:.2f} bit/point{ratio}; {r.encodings} {r.codec}")
    return 0


def cat(a) -> int:
    from .sources import text

    f = open_store(a.file)
    d = f.device(a.device)
    frame = f.dataframe(d.name, columns=a.columns.split(",") if a.columns else None, start=time_arg(a.start), end=time_arg(a.end), as_of=a.as_of)
    if a.format == "csv":
        text.export_csv(frame, d, sys.stdout, a.raw_time, limit=a.limit)
    elif a.format == "json":
        text.export_json(frame, d, sys.stdout, a.raw_time, a.limit)
    else:
        print(text.render_table([d.time_name, *frame.columns[1:]], list(text.rows_of(frame, d, a.raw_time, a.limit))))
    return 0


def convert(a) -> int:
    from .sources import text

    if os.path.isdir(a.input):
        if os.path.exists(a.output) and not a.force:
            raise UsageError(f"{a.output} exists; use --force to replace it")
        f = open_store(a.input)
        d = f.device(a.device)
        with open(a.output, "w", newline="", encoding="utf-8") as out:
            n = text.export_csv(f.dataframe(d.name, as_of=a.as_of), d, out, a.raw_time, a.delimiter)
    else:
        n = text.import_csv(a.input, a.output, a.device, a.time, a.unit, a.delimiter, a.append, a.force, a.message, a.author, codec=a.codec)
    print(f"{a.output}: {count_of(n, 'row')}")
    return 0


def _done(result) -> int:
    print("nothing to commit" if result is None else f"commit {result.number} {result.short_hash}")
    return 0


def _edit(a, change) -> int:
    f = open_store(a.file)
    with f.edit(a.message, a.author) as tx:
        change(f, tx)
    return _done(tx.result)


def point(a) -> int:
    def change(f, tx):
        d = f.device(a.device)
        getattr(tx, a.command)(d.name, time_arg(a.time), assignments(d, a.values))

    return _edit(a, change)


def delete(a) -> int:
    if (a.time is None) == (a.start is None and a.end is None):
        raise UsageError("give either --time, or --from and/or --to")

    def change(f, tx):
        name = f.device(a.device).name
        if a.time is not None:
            tx.delete(name, time_arg(a.time))
        else:
            tx.delete_range(name, time_arg(a.start), time_arg(a.end))

    return _edit(a, change)


def annotate(a) -> int:
    if a.id is None and (a.start is None or a.label is None):
        raise UsageError("a new annotation needs --start and --label")

    def change(f, tx):
        if a.id is not None:
            tx.update_annotation(a.id, time_arg(a.start), time_arg(a.end), a.label, a.note)
        else:
            tx.annotate(f.device(a.device).name, time_arg(a.start), time_arg(a.start if a.end is None else a.end), a.label, a.note)

    return _edit(a, change)


def unannotate(a) -> int:
    return _edit(a, lambda f, tx: tx.remove_annotation(a.id))


def annotations(a) -> int:
    f = open_store(a.file)
    for x in f.annotations(a.device, a.as_of):
        d = f.device(x.device)
        print(f"{x.id}  {x.device}  {_stamp(d, x.start)} … {_stamp(d, x.end)}  {x.label}" + (f"  ({x.note})" if x.note else ""))
    return 0


def log(a) -> int:
    for c in reversed(open_store(a.file).commits()):
        x = c.changes
        parts = [*(f"device {n}" for n in x.devices_created)]
        parts += [count_of(n, what) for n, what in ((x.rows_written, "row"), (x.ranges_deleted, "deletion"), (x.annotation_ops, "annotation change")) if n]
        parts += ["metadata"] if x.metadata_changed else []
        print(f"commit {c.number} {c.short_hash}  {c.time:%Y-%m-%d %H:%M:%S}  {c.author or '-'}  {c.message or ''}\n    {', '.join(parts) or 'no change'}")
    return 0


def diff(a) -> int:
    f = open_store(a.file)
    d = f.device(a.device)
    found = f.diff(a.start, a.end, d.name)
    sign = {"added": "+", "removed": "-", "changed": "~"}
    for p in found.points:
        if p.kind == "changed":
            cells = ", ".join(f"{n}: {p.before[n]} → {p.after[n]}" for n in p.before if p.before[n] != p.after[n])
        else:
            cells = ", ".join(f"{n}={v}" for n, v in (p.after or p.before).items() if v is not None)
        print(f"{sign[p.kind]} {_stamp(d, p.time)}  {cells}")
    for n in found.annotations:
        x = n.after or n.before
        print(f"{sign[n.kind]} annotation {n.id}  {_stamp(d, x.start)} … {_stamp(d, x.end)}  {x.label}")
    if not found:
        print("no differences")
    return 0


def verify(a) -> int:
    from .maintenance import verify as check

    r = check(a.file)
    for line in [*(f"problem: {p}" for p in r.problems), *(f"warning: {w}" for w in r.warnings)]:
        print(line)
    print(f"{'ok' if r else 'DAMAGED'}: {count_of(r.commits, 'commit')}, {count_of(r.files, 'file')}, {count_of(r.rows, 'row')}")
    return 0 if r else 1


def recover(a) -> int:
    from .maintenance import recover as mend

    r = mend(a.file, a.force)
    print(f"removed {count_of(r.removed_files, 'file')} ({size_of(r.removed_bytes)}), {count_of(r.removed_commits, 'commit')}")
    return 0


def compact(a) -> int:
    from .maintenance import compact as squeeze

    if os.path.exists(a.target) and not a.force:
        raise UsageError(f"{a.target} exists; use --force to replace it")
    r = squeeze(a.source, a.target, a.as_of, a.force)
    print(f"{a.target}: {count_of(r.rows, 'row')}, {count_of(r.annotations, 'annotation')}, {size_of(r.source_bytes)} → {size_of(r.target_bytes)}")
    return 0


_FILE, _DEVICE, _VERSION = ("file", {}), ("--device", {}), ("--as-of", {"type": int})
_SPAN = (("--from", {"dest": "start"}), ("--to", {"dest": "end"}))
_COMMIT = (("--message", {}), ("--author", {}))
_POINT = (_FILE, _DEVICE, ("--time", {"required": True}), ("values", {"nargs": "+", "metavar": "COLUMN=VALUE"}), *_COMMIT)
_FLAG = {"action": "store_true"}
COMMANDS = {
    "info": (info, "devices, columns, history and storage", (_FILE,)),
    "cat": (cat, "points of a device", (_FILE, _DEVICE, ("--columns", {}), *_SPAN, _VERSION, ("--format", {"choices": ("csv", "table", "json"), "default": "csv"}), ("--limit", {"type": int}), ("--raw-time", _FLAG))),
    "convert": (convert, "CSV to a store, or a store to CSV", (("input", {}), ("output", {}), _DEVICE, ("--time", {}), ("--unit", {"choices": ("s", "ms", "us", "ns")}), ("--delimiter", {"default": ","}), ("--append", _FLAG), ("--force", _FLAG), ("--codec", {"choices": ("none", "lz4", "zstd"), "default": "zstd"}), ("--raw-time", _FLAG), _VERSION, *_COMMIT)),
    "insert": (point, "add or replace a point", _POINT),
    "update": (point, "change cells of a point", _POINT),
    "delete": (delete, "delete a point or a range", (_FILE, _DEVICE, ("--time", {}), *_SPAN, *_COMMIT)),
    "annotate": (annotate, "label an interval, or change a label", (_FILE, _DEVICE, ("--id", {"type": int}), ("--start", {}), ("--end", {}), ("--label", {}), ("--note", {}), *_COMMIT)),
    "unannotate": (unannotate, "remove an annotation", (_FILE, ("id", {"type": int}), *_COMMIT)),
    "annotations": (annotations, "list annotations", (_FILE, _DEVICE, _VERSION)),
    "log": (log, "commits", (_FILE,)),
    "diff": (diff, "changes between versions", (_FILE, _DEVICE, ("--from", {"dest": "start", "type": int, "required": True}), ("--to", {"dest": "end", "type": int}))),
    "verify": (verify, "check hashes, chain and data", (_FILE,)),
    "recover": (recover, "remove what an unfinished commit left", (_FILE, ("--force", _FLAG))),
    "compact": (compact, "copy a version without history", (("source", {}), ("target", {}), _VERSION, ("--force", _FLAG))),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tsledger", description="Versioned time-series tables.")
    commands = out.add_subparsers(dest="command", required=True, metavar="COMMAND")
    for name, (run, text, options) in COMMANDS.items():
        p = commands.add_parser(name, help=text)
        p.set_defaults(run=run)
        for flag, how in options:
            p.add_argument(flag, **how)
    return out


def main(argv: Sequence[str] | None = None) -> int:
    """Exit status: 0, 1 for damage that verify found, 2 for errors, which are one line each."""
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (LedgerError, UsageError, InvalidArgumentError, OSError, KeyError, TypeError) as e:
        print(f"tsledger: {e.args[0] if isinstance(e, KeyError) and e.args else e}", file=sys.stderr)
        return 2
