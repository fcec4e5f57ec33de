"""Names, call specifications and report texts as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def class_name(name: Column) -> Column:
    """Of ``pkg.Cls.meth`` or ``<pkg.Cls: ret meth(params)>``."""
    return F.when(F.startswith(name, F.lit("<")), F.regexp_extract(name, r"^<([^:]*):", 1)).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def method_name(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("<")), F.regexp_extract(name, r"^<[^:]*: *\S+ +([^(]*)\(", 1)).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def covers_line(start: Column, end: Column, wanted: Column) -> Column:
    """Whether a position covers a line, or starts there; -1 stands for no line and is never covered."""
    return F.coalesce((start != -1) & (wanted != -1) & ((start == wanted) | ((start <= wanted) & (end >= wanted))), F.lit(False))


def line_number(lines: Column) -> Column:
    """The least of a unit's lines, -1 if there is none."""
    return F.coalesce(F.array_min(lines), F.lit(-1))


def call_text(caller: Column, callee: Column, line: Column) -> Column:
    return F.concat(caller, F.lit("/"), callee, F.lit("/"), line.cast("string"))


def unit_text(text: Column, line: Column) -> Column:
    return F.format_string("  %s {line: %d}", text, line)


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def elapsed(ms: Column) -> Column:
    """Whole minutes and seconds."""
    return F.format_string("%d min. %d sec.", F.floor(ms / 60000), F.floor(ms / 1000) % 60)


def elapsed_text(ms: int) -> str:
    return f"{ms // 60000} min. {ms // 1000 % 60} sec."


def parse_boolean(option: str) -> bool:
    return option.lower() == "true"
