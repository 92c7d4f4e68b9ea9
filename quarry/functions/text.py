"""Column functions of names, paths and texts; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(candidate: Column, query: Column) -> Column:
    """1 if equal, 0.9 if either holds the other, else the share of the candidate's
    characters (repeats counted) that the query has, over the longer length; in lower
    case. Not symmetric; an empty name is held by any."""
    c, q = F.lower(candidate), F.lower(query)
    shared = F.size(F.filter(F.split(c, ""), lambda x: (x != "") & (F.instr(q, x) > 0)))
    return F.when(c == q, 1.0).when((F.instr(c, q) > 0) | (F.instr(q, c) > 0), 0.9).otherwise(shared / F.greatest(F.length(c), F.length(q)))


def similarity_to(candidate: Column, query: str) -> Column:
    """``similarity`` with a fixed query."""
    c, q = F.lower(candidate), query.lower()
    letters = F.array(*(F.lit(x) for x in sorted(set(q)))) if q else F.array().cast("array<string>")
    shared = F.size(F.filter(F.split(c, ""), lambda x: (x != "") & F.array_contains(letters, x)))
    return F.when(c == q, 1.0).when(c.contains(q) | F.lit(q).contains(c), 0.9).otherwise(shared / F.greatest(F.length(c), F.lit(len(q))))


def similar_entry(name: Column, kind: Column, signature: Column) -> Column:
    """``name (type)``, and `` - signature`` if there is one."""
    tail = F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(" - "), signature)).otherwise("")
    return F.concat(name, F.lit(" ("), kind, F.lit(")"), tail)


def suffix(path: Column) -> Column:
    """The last extension of a path's name with its dot; a leading dot is no extension."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def excluded(path: Column, names: tuple[str, ...]) -> Column:
    """Whether any component of the path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in names)))


def language_of_path(path: Column) -> Column:
    ext = suffix(F.coalesce(path, F.lit("")))
    return F.when(ext.isin(".ts", ".tsx"), "typescript").when(ext.isin(".js", ".jsx"), "javascript").otherwise("python")


def default_extension(path: Column) -> Column:
    """The path's own extension if it is one of TypeScript or JavaScript, else ``.ts``."""
    ext = suffix(F.coalesce(path, F.lit("")))
    return F.when(ext.isin(".ts", ".tsx", ".js", ".jsx"), ext).otherwise(".ts")


def is_test_file(path: Column, language: str) -> Column:
    """Whether the name is a test's and a directory named tests, test or __tests__ holds it."""
    name = F.element_at(F.split(path, "/"), -1)
    inside = path.rlike(r"(^|/)(tests|test|__tests__)/")
    if language == "python":
        return inside & name.rlike(r"^test_.*\.py$")
    return inside & name.rlike(r"\.(ts|tsx|js|jsx)$") & name.rlike(r"^(test_|spec_)|\.(test|spec)\.(ts|tsx|js|jsx)$")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def url_valid(url: Column) -> Column:
    """Scheme http or https and a host part; nothing is fetched."""
    return F.coalesce(url, F.lit("")).rlike(r"^(?i:https?)://[^/?#]+")


def cache_key(library: Column, symbol: Column, symbol_type: Column, language: Column) -> Column:
    return F.concat_ws(":", *(F.coalesce(c, F.lit("")) for c in (library, symbol, symbol_type, language)))


def python_import(relative_path: Column, symbol: Column) -> Column:
    """``from a.b import s`` for a path below its search directory."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace(relative_path, r"[/\\]", "."), r"\.py$", ""), r"\.pyi$", "")
    return F.concat(F.lit("from "), module, F.lit(" import "), symbol)


def ts_import(library: Column, relative_path: Column, symbol: Column) -> Column:
    """An import of the symbol from the library, by file if one is known."""
    source = F.when(relative_path.isNull(), library).otherwise(F.concat(library, F.lit("/"), relative_path))
    return F.concat(F.lit("import { "), symbol, F.lit(" } from '"), source, F.lit("'"))


def title_name(name: Column) -> Column:
    """``a-b_c`` as ``A B C``."""
    return F.initcap(F.translate(name, "-_", "  "))


def description(content: Column) -> Column:
    """Of a skill's main file: its ``description:`` line among the first 20, else its
    first heading that a line end follows, else empty; 120 characters at most."""
    lines = F.slice(F.split(content, "\n"), 1, 20)
    line = F.get(F.filter(lines, lambda x: x.startswith("description:")), 0)
    value = F.trim(F.substr(line, F.lit(13)))
    unquoted = F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")
    at = F.instr(content, "# ")
    rest = F.when(at > 0, F.substr(content, at + 2))
    heading = F.when(F.instr(rest, "\n") > 0, F.trim(F.substring_index(rest, "\n", 1)))
    found = F.when(content.contains("description:") & line.isNotNull(), unquoted).otherwise(heading)
    return F.coalesce(F.substring(found, 1, 120), F.lit(""))


def api_url(url: Column) -> Column:
    return F.replace(url, F.lit("github.com"), F.lit("api.github.com/repos"))


def raw_url(url: Column, branch: Column) -> Column:
    return F.concat(F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com")), F.lit("/"), branch)


def percent(ratio: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", ratio * 100)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def line_of_match(content: Column, literal: str) -> Column:
    """Line (from 1) of the first place where the literal occurs; null if nowhere."""
    at = F.instr(content, literal)
    before = F.substring(content, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.translate(before, "\n", "")) + 1)
