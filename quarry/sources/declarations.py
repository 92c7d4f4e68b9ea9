"""TypeScript declaration files: symbols by pattern, grouped in the order of kinds."""

from __future__ import annotations

import re
from collections.abc import Iterator

# What a declaration of each kind looks like, in the order of the results.
_HEAD = r"(?:export\s+)?(?:declare\s+)?"
PATTERNS = {
    "function": _HEAD + r"(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)(?:\s*:\s*([^\{;]+))?",
    "class": _HEAD + r"class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w\s,]+))?",
    "interface": _HEAD + r"interface\s+(\w+)(?:\s+extends\s+([\w\s,]+))?",
    "const": _HEAD + r"const\s+(\w+)\s*:\s*([^\n;]+)",
    "type": _HEAD + r"type\s+(\w+)\s*=\s*([^\n;]+)",
    "enum": _HEAD + r"enum\s+(\w+)",
}


def _signature(kind: str, name: str, rest: list[str]) -> str:
    if kind == "function":
        return f"function {name}({rest[0]}): {rest[1] or 'void'}"
    if kind in ("const", "type"):
        return f"{kind} {name} = {rest[0] or 'unknown'}"
    words = zip(("extends", "implements"), rest, strict=False)
    return " ".join([f"{kind} {name}", *(f"{word} {text}" for word, text in words if text)])


def symbols(source: str) -> Iterator[tuple]:
    """(name, type, line, signature, docstring, parent); matches in comments count."""
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, source):
            rest = [(g or "").strip() for g in m.groups()[1:]]
            yield m[1], kind, source.count("\n", 0, m.start()) + 1, _signature(kind, m[1], rest), "", ""
