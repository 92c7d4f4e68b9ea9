"""What the names of a file stand for in other files: imports, exports and their aliases.

A binding is (local, level, module, name, line): in this file ``local`` is ``name`` of a module, or
the module itself if ``name`` is None, or all of its names if both are ``*``. ``module`` is a path with
slashes; ``level`` is 0 for one that is looked up from the folders above the file, n for one
below the n-th folder above it (1: the file's own), and -1 for the file itself.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from quarry.sources import python_code, ts_code

Binding = tuple[str, int, str, str | None, int]


def python_bindings(source: str) -> Iterator[Binding]:
    tree = python_code.parse(source)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Import):
            for a in node.names:
                path = a.name.replace(".", "/")
                yield a.asname or a.name, 0, path, None, node.lineno
                if not a.asname and "." in a.name:
                    yield a.name.partition(".")[0], 0, path.partition("/")[0], None, node.lineno
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield a.asname or a.name, node.level, (node.module or "").replace(".", "/"), a.name, node.lineno


def _place(module: str) -> tuple[int, str]:
    """Level and path of a module as written."""
    parts = module.split("/")
    if parts[0] not in (".", ".."):
        return 0, module
    up = 0
    while parts and parts[0] in (".", ".."):
        up += parts.pop(0) == ".."
    return up + 1, "/".join(parts)


class _Bindings:
    """The bindings of one source, by its tokens."""

    def __init__(self, source: str):
        self.scanner = ts_code.Scanner(source)
        self.toks = self.scanner.toks

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def names(self, i: int, colon: bool = False) -> tuple[list[tuple[str, str]], int]:
        """(name, local) pairs of the braces that open at i, and the place behind them."""
        end, out, j = self.scanner.close.get(i, len(self.toks)), [], i + 1
        while j < end:
            if self.text(j) == "type" and self.scanner.word(j + 1) and self.text(j + 1) != "as":
                j += 1
            if not self.scanner.word(j):
                j += 1
                continue
            name = local = self.text(j)
            if self.text(j + 1) == ("as", ":")[colon] and j + 2 < end:
                local = self.text(j + 2)
                j += 2
            out.append((name, local))
            j += 1
        return out, end + 1

    def source_of(self, i: int) -> str | None:
        """The module string behind ``from`` at i."""
        return self.text(i + 1).strip("\"'`") if self.text(i) == "from" and i + 1 < len(self.toks) and self.toks[i + 1].kind == "str" else None

    def rows(self) -> Iterator[Binding]:
        for i, t in enumerate(self.toks):
            if t.kind != "id" or self.text(i - 1) == ".":
                continue
            if t.text in ("import", "export"):
                yield from self.statement(i, t.text == "export")
            elif t.text == "require" and self.text(i + 1) == "(" and i + 2 < len(self.toks) and self.toks[i + 2].kind == "str" and self.text(i - 1) == "=":
                level, path = _place(self.text(i + 2).strip("\"'`"))
                if self.scanner.word(i - 2):
                    yield self.text(i - 2), level, path, None, self.scanner.line(i)
                elif self.text(i - 2) == "}" and (opens := self.scanner.open.get(i - 2)) is not None:
                    for name, local in self.names(opens, colon=True)[0]:
                        yield local, level, path, name, self.scanner.line(i)

    def statement(self, i: int, export: bool) -> Iterator[Binding]:
        line, j = self.scanner.line(i), i + 1
        if self.text(j) == "type" and self.text(j + 1) in ("{", "*"):
            j += 1
        if export and self.text(j) == "default":
            named = next((k for k in range(j + 1, min(j + 5, len(self.toks))) if self.scanner.word(k) and self.text(k) not in ("async", "function", "class", "abstract", "new")), None)
            if named is not None and self.text(named - 1) in ("function", "class", "default", "*"):
                yield "default", -1, "", self.text(named), line
            return
        found: list[tuple[str | None, str]] = []
        while j < len(self.toks):
            if self.text(j) == "{":
                pairs, j = self.names(j)
                found += pairs
            elif self.text(j) == "*":
                alias = self.text(j + 2) if self.text(j + 1) == "as" else None
                found.append((None, alias) if alias else ("*", "*"))
                j += 3 if alias else 1
            elif self.text(j) == ",":
                j += 1
            elif self.text(j) != "from" and self.scanner.word(j) and not export and self.text(j + 1) in (",", "from"):
                found.append(("default", self.text(j)))
                j += 1
            else:
                break
        module = self.source_of(j)
        if module is not None:
            level, path = _place(module)
            yield from ((local, level, path, name, line) for name, local in found)
        elif export:
            yield from ((local, -1, "", name, line) for name, local in found if name not in ("*", None) and name != local)


def typescript_bindings(source: str) -> Iterator[Binding]:
    return _Bindings(source).rows()
