"""Python source: graph rows, symbols, syntax and import checks, from ``ast`` alone.

Analysed code is parsed, never imported or run. One pass over a file gives tagged rows.
"""

from __future__ import annotations

import ast
import importlib.util
from collections.abc import Iterator

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(source: str) -> ast.Module | None:
    """The tree of a source; none if it has syntax errors or is nested too deeply to parse."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


def dotted(node: ast.AST | None) -> str:
    """The text of a plain expression; empty for the rest (unions, calls, tuples...)."""
    tail: list[str] = []
    while isinstance(node, ast.Attribute | ast.Subscript):
        tail.append(f".{node.attr}" if isinstance(node, ast.Attribute) else f"[{dotted(node.slice)}]")
        node = node.value
    head = node.id if isinstance(node, ast.Name) else str(node.value) if isinstance(node, ast.Constant) else ""
    return head + "".join(reversed(tail))


def class_signature(node: ast.ClassDef) -> str:
    bases = ", ".join(filter(None, map(dotted, node.bases)))
    return f"class {node.name}({bases})" if bases else f"class {node.name}"


def function_signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Plain positional arguments only, with plain annotations."""
    args = ", ".join(a.arg + (f": {dotted(a.annotation)}" if a.annotation else "") for a in node.args.args)
    head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{head} {node.name}({args})" + (f" -> {dotted(node.returns)}" if node.returns else "")


def graph_rows(source: str) -> Iterator[tuple]:
    """("node", name, type, line, signature) and ("edge", source, target, type, line).

    A function inside a class, at any depth, is ``Class.f``; nested classes aren't
    qualified. Calls count inside functions only, and belong to the innermost one, its
    decorators and defaults included; a file that doesn't parse has no rows."""
    tree = parse(source)
    pending: list[tuple[ast.AST, str, str]] = [(tree, "", "")] if tree else []
    while pending:
        node, owner, function = pending.pop()
        if isinstance(node, ast.ClassDef):
            yield "node", node.name, "class", node.lineno, class_signature(node)
            for base in filter(None, map(dotted, node.bases)):
                yield "edge", node.name, base, "inherits", node.lineno
            owner = node.name
        elif isinstance(node, DEFS):
            function = f"{owner}.{node.name}" if owner else node.name
            yield "node", function, "method" if owner else "function", node.lineno, function_signature(node)
        elif isinstance(node, ast.Call) and function:
            callee = dotted(node.func) if isinstance(node.func, ast.Name | ast.Attribute) else ""
            if callee:
                yield "edge", function, callee, "calls", node.lineno
        pending += [(child, owner, function) for child in reversed(list(ast.iter_child_nodes(node)))]


def symbols(source: str) -> Iterator[tuple]:
    """(name, type, line, signature, docstring, parent): functions, classes and
    module-level variables. A function with any parent, function or class, is a method."""
    tree = parse(source)
    pending: list[tuple[ast.AST, str]] = [(tree, "")] if tree else []
    while pending:
        node, parent = pending.pop()
        inner = parent
        if isinstance(node, (*DEFS, ast.ClassDef)):
            doc = ast.get_docstring(node) or ""
            if isinstance(node, ast.ClassDef):
                yield node.name, "class", node.lineno, class_signature(node), doc, ""
            else:
                yield node.name, "method" if parent else "function", node.lineno, function_signature(node), doc, parent
            inner = node.name
        elif isinstance(node, ast.Assign | ast.AnnAssign) and not parent:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    yield target.id, "variable", node.lineno, "", "", ""
            continue
        pending += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]


def identifiers(source: str) -> set[str]:
    """Every plain name and attribute that a file mentions."""
    tree = parse(source)
    return {n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(tree) if isinstance(n, ast.Name | ast.Attribute)} if tree else set()


def syntax_issues(source: str) -> list[dict]:
    try:
        ast.parse(source)
    except SyntaxError as e:
        return [{"line": e.lineno, "column": e.offset, "code": "SyntaxError", "message": str(e.msg), "severity": "error"}]
    except (ValueError, MemoryError, RecursionError) as e:
        return [{"line": None, "column": None, "code": "SyntaxError", "message": str(e) or "nested too deeply to parse", "severity": "error"}]
    return []


def module_found(name: str) -> bool:
    """Whether the top-level module can be found; nothing is imported."""
    try:
        return importlib.util.find_spec(name.partition(".")[0]) is not None
    except (ImportError, ValueError):
        return False


def import_issues(source: str) -> list[dict]:
    """A warning for each imported module that can't be found; relative imports are
    looked up by their written name, as absolute ones."""
    tree = parse(source)
    if tree is None:
        return [{"line": None, "column": None, "code": "SKIP", "message": "Cannot check imports: syntax errors present", "severity": "warning"}]
    out = []
    for node in ast.walk(tree):
        wanted = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module] if isinstance(node, ast.ImportFrom) and node.module else []
        out += [{"line": node.lineno, "column": node.col_offset, "code": "ImportError", "message": f"Module '{m}' not found", "severity": "warning"} for m in wanted if not module_found(m)]
    return out


def lint_issues(source: str) -> list[dict]:
    """A few rules of our own, for where no linter's output is at hand: unused imports,
    bare except, comparison to None, and lines over 120 characters. All warnings."""
    tree = parse(source)
    if tree is None:
        return []
    used, out = identifiers(source), []
    add = lambda line, column, code, message: out.append({"line": line, "column": column, "code": code, "message": message, "severity": "warning"})
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom) and not (isinstance(node, ast.ImportFrom) and node.module == "__future__"):
            for a in node.names:
                name = (a.asname or a.name).partition(".")[0]
                if name not in used and name != "*":
                    add(node.lineno, node.col_offset + 1, "F401", f"`{name}` imported but unused")
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            add(node.lineno, node.col_offset + 1, "E722", "Do not use bare `except`")
        elif isinstance(node, ast.Compare) and any(isinstance(o, ast.Eq | ast.NotEq) and isinstance(c, ast.Constant) and c.value is None for o, c in zip(node.ops, node.comparators, strict=True)):
            add(node.lineno, node.col_offset + 1, "E711", "Comparison to `None`")
    for i, line in enumerate(source.split("\n"), 1):
        if len(line) > 120:
            add(i, 121, "E501", f"Line too long ({len(line)} > 120)")
    return sorted(out, key=lambda x: (x["line"], x["column"], x["code"]))
