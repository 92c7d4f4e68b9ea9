"""TypeScript and JavaScript source: graph rows from a scanner of our own.

Tokens first (strings, templates, comments and regular expressions told apart), then one
walk that recognises declarations, imports, calls and decorators by their tokens. It
never fails on bad syntax; what it can't recognise, it walks over.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_LEX = re.compile(r"""(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<id>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|\#[A-Za-z_$][\w$]*)|(?P<num>\.?[0-9][\w.]*)|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<op>=>|\.\.\.|\?\.(?![0-9])|[=!]==?|[<>]=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|.)""", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
# Words that aren't called, and words after which an operand follows.
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "in", "of", "do", "else", "case", "throw", "void", "delete", "yield", "import", "super", "with", "instanceof"}
_OPERAND_NEXT = {"return", "typeof", "case", "in", "of", "do", "else", "throw", "void", "delete", "new", "await", "yield", "instanceof"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "*", "export", "default", "accessor"}
_OPEN = {"(": ")", "[": "]", "{": "}"}


class Tok(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def tokenize(source: str) -> list[Tok]:
    """The tokens of a source. A template is a string token, behind it its substitutions in
    brackets; templates inside substitutions may be nested to any depth."""
    out: list[Tok] = []
    depth, at, n = 0, 0, len(source)
    template: tuple[int, list[Tok]] | None = None  # of the template being read: its start, and its substitutions' tokens
    around: list[tuple] = []  # what was being read around each open substitution, and where that opened
    while True:
        if template:
            begin, inner = template
            while at < n and source[at] != "`" and not source.startswith("${", at):
                at += 2 if source[at] == "\\" else 1
            if at < n and source[at] == "$":
                around.append((out, depth, begin, inner, at))
                out, depth, at, template = [], 0, at + 2, None
            else:
                at = min(n, at + 1)
                out += [Tok("str", source[begin:at], begin, at), *inner]
                template = None
            continue
        ends = at >= n
        if around and (ends or (source[at] == "}" and depth == 0)):
            part = out
            out, depth, begin, inner, opened = around.pop()
            inner += [Tok("op", "(", opened, opened + 2), *part, Tok("op", ")", at, at + 1)]
            at, template = at + 1, (begin, inner)
            continue
        if ends:
            return out
        ch = source[at]
        if ch == "`":
            at, template = at + 1, (at, [])
            continue
        before = out[-1] if out else None
        if ch == "/" and source[at + 1 : at + 2] not in ("/", "*") and (before is None or before.kind == "op" and before.text not in ")]}" or before.text in _OPERAND_NEXT):
            m = _REGEX.match(source, at)
            if m:
                out.append(Tok("num", m[0], m.start(), m.end()))
                at = m.end()
                continue
        m = _LEX.match(source, at)
        if m.lastgroup != "gap":
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            out.append(Tok(m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()


class Scanner:
    """Rows of one file. With ``heritage``, extends and implements clauses give edges
    and show in class signatures, which the documented intent asks for and the default
    (what the known tool persists) does not."""

    def __init__(self, source: str, heritage: bool = False):
        self.source, self.heritage = source, heritage
        self.toks = tokenize(source)
        self.rows: list[tuple] = []
        self.close = self._pairs()
        self.open = {b: a for a, b in self.close.items()}
        self.lines = [m.start() for m in re.finditer("\n", source)]

    def _pairs(self) -> dict[int, int]:
        stack, out = [], {}
        for i, t in enumerate(self.toks):
            if t.kind == "op" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                while stack and _OPEN[self.toks[stack[-1]].text] != t.text:
                    stack.pop()
                if stack:
                    out[stack.pop()] = i
        return out

    def line(self, i: int) -> int:
        import bisect

        return bisect.bisect_left(self.lines, self.toks[i].start) + 1

    def text(self, a: int, b: int) -> str:
        """Source text of tokens a..b (exclusive)."""
        return self.source[self.toks[a].start : self.toks[b - 1].end] if b > a else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind != "str" and self.toks[i].text in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "id"

    def after(self, i: int) -> int:
        """The token after the bracket that opens at i (the end, if it never closes)."""
        return self.close.get(i, len(self.toks) - 1) + 1

    def after_generics(self, i: int) -> int:
        """Past ``<...>`` if one opens at i."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.toks):
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if depth == 0:
                    return j + 1
            elif self.is_(j, ";", "=>") and depth == 1 and self.is_(j, ";"):
                return i
            j = self.after(j) if self.is_(j, "(", "[", "{") else j + 1
        return i

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """Where a type that begins at i ends: at a stop outside of brackets."""
        j = i
        while j < len(self.toks):
            if self.is_(j, "{") and "{" in stops and j > i and not self.is_(j - 1, "|", "&", ":", "=>", "<", ","):
                return j
            if self.is_(j, "(", "[", "{"):
                j = self.after(j)
            elif self.is_(j, "<") and (k := self.after_generics(j)) > j:
                j = k
            elif self.is_(j, *[s for s in stops if s != "{"], ")", "]", "}"):
                return j
            elif j > i and "\n" in stops and self.line(j) > self.line(j - 1) and not self.is_(j, "|", "&", "=>", ".", "?", ":", "[", "extends") and not self.is_(j - 1, "|", "&", "=", "=>", "?", ":", ","):
                return j
            else:
                j += 1
        return j

    # signatures

    def params(self, i: int, arrow: bool = False) -> str:
        """Parameters of the bracket at i. Optional ones end in ?, rest ones begin with
        dots; types follow a colon; defaults are left out. Arrow parameters keep their
        text, and optional and rest ones are left out."""
        end, out, a = self.close.get(i, len(self.toks) - 1), [], i + 1
        while a < end:
            b = a
            while b < end and not self.is_(b, ","):
                b = self.after(b) if self.is_(b, "(", "[", "{") else (self.after_generics(b) if self.after_generics(b) > b else b + 1)
            b = min(b, end)
            if b > a:
                rest, c = self.is_(a, "..."), a
                while self.word(c) and self.is_(c, *_MODIFIERS) and self.word(c + 1):
                    c += 1
                c += rest
                name_end = self.after(c) if self.is_(c, "{", "[") else c + 1
                optional = self.is_(name_end, "?")
                if arrow:
                    if not rest and not optional:
                        out.append(self.text(a, b))
                else:
                    kind = ""
                    if self.is_(name_end + optional, ":"):
                        kind = f": {self.text(name_end + optional + 1, self.type_end(name_end + optional + 1, ('=', ',')))}"
                    out.append("..." * rest + self.text(c, name_end) + kind + "?" * optional)
            a = b + 1
        return ", ".join(out)

    # the walk

    def node(self, name: str, kind: str, i: int, signature: str) -> None:
        self.rows.append(("node", name, kind, self.line(i), signature))

    def edge(self, source: str, target: str, kind: str, i: int) -> None:
        self.rows.append(("edge", source, target, kind, self.line(i)))

    def starts_statement(self, i: int) -> bool:
        return i == 0 or self.is_(i - 1, ";", "{", "}", ")") or self.is_(i - 1, "export", "default", "declare", "async", "abstract") or self.line(i) > self.line(i - 1)

    def scan(self) -> list[tuple]:
        if self.toks:
            self.walk(0, len(self.toks), "", "")
        return self.rows

    def walk(self, i: int, end: int, owner: str, function: str) -> None:
        while i < end:
            i = max(i + 1, self.step(i, end, owner, function))

    def step(self, i: int, end: int, owner: str, function: str) -> int:
        """Handles what begins at token i; returns where to go on."""
        t = self.toks[i]
        if t.kind == "id" and not self.is_(i - 1, ".", "?."):
            if t.text == "import" and self.starts_statement(i) and not self.is_(i + 1, "(", "."):
                return self.import_(i, end, function)
            if t.text == "function" and self.word(i + 1) and self.starts_statement(i - self.is_(i - 1, "async")):
                return self.function_(i, owner, function)
            if t.text == "class" and self.word(i + 1) and not self.is_(i + 1, "extends", "implements") and self.starts_statement(i):
                return self.class_(i, owner, function)
            if t.text == "interface" and self.word(i + 1) and self.starts_statement(i):
                return self.interface_(i)
            if t.text == "type" and self.word(i + 1) and self.starts_statement(i) and self.is_(self.after_generics(i + 2), "="):
                return self.type_(i)
            if t.text == "enum" and self.word(i + 1) and self.is_(i + 2, "{"):
                return self.enum_(i)
            if t.text in ("const", "let", "var"):
                return i + 1
        method = self.method_at(i, end)
        if method:
            return self.method_(i, *method, owner, function)
        arrow = self.arrow_at(i)
        if arrow:
            return self.arrow_(i, *arrow, end, owner, function)
        if self.is_(i, "@") and self.word(i + 1):
            return self.decorator_(i, owner, function)
        if self.is_(i, "(") and function:
            self.call_(i, function)
        return i + 1

    def import_(self, i: int, end: int, function: str) -> int:
        j = i + 1
        while j < end and not self.is_(j, ";") and not (self.toks[j].kind == "str" and self.is_(j - 1, "from", "import", "(")):
            if self.is_(j, "{"):
                for k in range(j + 1, self.close.get(j, end)):
                    if self.is_(k - 1, "{", ",", "type") and self.word(k) and not (self.is_(k, "type") and self.word(k + 1) and not self.is_(k + 1, "as")):
                        self.node(self.toks[k].text, "import", i, f"import {{ {self.toks[k].text} }}")
                j = self.after(j)
            elif j > i + 1 and self.line(j) > self.line(j - 1) and not self.is_(j, "from", "{", ",", "}"):
                return j
            else:
                j += 1
        if j < end and self.toks[j].kind == "str":
            required = self.is_(j - 1, "(")
            self.edge("(module)" if required else function or "(module)", self.toks[j].text.strip("'\""), "imports", i)
        return j + 1

    def function_(self, i: int, owner: str, function: str) -> int:
        name = self.toks[i + 1].text
        at = self.after_generics(i + 2)
        if not self.is_(at, "("):
            return i + 2
        full = f"{owner}.{name}" if owner else name
        body, result = self.result(self.after(at))
        if not self.is_(body, "{"):
            return body
        first = i - self.is_(i - 1, "async")
        self.node(full, "method" if owner else "function", first, f"{'async ' * (first < i)}function {name}({self.params(at)}){result}")
        self.walk(body + 1, self.close.get(body, len(self.toks)), owner, full)
        return self.after(body)

    def result(self, i: int) -> tuple[int, str]:
        """Where a body may begin after the parameters, and the written result type."""
        if not self.is_(i, ":"):
            return i, ""
        stop = self.type_end(i + 1, ("{", "=>", ";", "\n"))
        return stop, f" -> {self.text(i + 1, stop)}"

    def names_until(self, i: int, stops: tuple[str, ...]) -> tuple[list[str], int]:
        out = []
        while i < len(self.toks) and not self.is_(i, *stops):
            stop = i
            while stop < len(self.toks) and not self.is_(stop, ",", *stops):
                stop = max(stop + 1, self.after_generics(stop))
            out.append(self.text(i, stop))
            i = stop + self.is_(stop, ",")
        return out, i

    def clauses(self, i: int) -> tuple[dict[str, list[str]], int]:
        found: dict[str, list[str]] = {}
        while self.is_(i, "extends", "implements"):
            word = self.toks[i].text
            found[word], i = self.names_until(i + 1, ("{", "implements", "extends"))
        return found, i

    def class_(self, i: int, owner: str, function: str) -> int:
        name = self.toks[i + 1].text
        found, body = self.clauses(self.after_generics(i + 2))
        if not self.is_(body, "{"):
            return i + 2
        abstract = self.is_(i - 1, "abstract")  # another kind of node to the grammar: members stand on their own
        if not abstract:
            kept = found if self.heritage else {}
            self.node(name, "class", i, " ".join([f"class {name}", *(f"{w} {', '.join(names)}" for w, names in kept.items())]))
            for word, names in kept.items():
                for base in names:
                    self.edge(name, base, word, i)
            for d in self.decorators_before(i):
                self.decorator_(d, name, function)
        self.members(body + 1, self.close.get(body, len(self.toks)), owner if abstract else name, function)
        return self.after(body)

    def decorators_before(self, i: int) -> list[int]:
        """Decorators right before token i (an export between hides them)."""
        out, j = [], i - 1
        while j >= 0:
            k = self.open.get(j, j + 1) - 1 if self.is_(j, ")") else j
            while self.word(k) and self.is_(k - 1, "."):
                k -= 2
            if not (self.word(k) and self.is_(k - 1, "@")):
                break
            out.append(k - 1)
            j = k - 2
        return out[::-1]

    def members(self, i: int, end: int, owner: str, function: str) -> None:
        while i < end:
            if self.is_(i, "@"):
                i = self.decorator_(i, owner, function)
                continue
            method = self.method_at(i, end)
            if method:
                i = self.method_(i, *method, owner, function)
                continue
            if (self.word(i) or self.toks[i].kind == "str") and (self.is_(i + 1, ":", "=", "?", "!", ";")):
                i = self.field_(i, end, owner, function)
                continue
            i = self.after(i) if self.is_(i, "(", "[", "{") else i + 1

    def field_(self, i: int, end: int, owner: str, function: str) -> int:
        """A field: calls in its value belong to the function around; those in an arrow
        function's body to the field's name."""
        j = i + 1
        while self.is_(j, "?", "!"):
            j += 1
        if self.is_(j, ":"):
            j = self.type_end(j + 1, ("=", ";", "\n"))
        if not self.is_(j, "="):
            return j
        j += 1
        while j < end and not self.is_(j, ";"):
            if self.line(j) > self.line(j - 1) and not self.is_(j - 1, "=") and (self.method_at(j, end) or self.is_(j, "@", *_MODIFIERS) or self.word(j) and self.is_(j + 1, ":", "=", "?", ";")):
                break
            arrow = self.arrow_at(j)
            if arrow and self.is_(j - 1 - self.is_(j - 1, "async"), "="):
                j = self.arrow_body(arrow[1], end, owner, self.toks[i].text)
            else:
                j = max(j + 1, self.step(j, end, owner, function))
        return j

    def method_at(self, i: int, end: int) -> tuple[int, int, int] | None:
        """(name token, its bracket, body) if a method with a body begins at i."""
        j = i
        while self.is_(j, *_MODIFIERS) and (self.word(j + 1) or self.is_(j + 1, "[", "*") or j + 1 < len(self.toks) and self.toks[j + 1].kind in ("str", "num")):
            j += 1
        if j > i and not (i == 0 or self.is_(i - 1, "{", ",", ";", "}", ")") or self.line(i) > self.line(i - 1)):
            return None
        if j == i and not (self.is_(i - 1, "{", ",", ";", "}", ")") or i and self.line(i) > self.line(i - 1)):
            return None
        if self.is_(j, "["):
            after_name = self.after(j)
        elif j < len(self.toks) and (self.toks[j].kind == "id" and self.toks[j].text not in _NOT_CALLED - {"import", "delete", "return", "of", "in", "new", "catch"} or self.toks[j].kind in ("str", "num")):
            after_name = j + 1
        else:
            return None
        at = self.after_generics(after_name + self.is_(after_name, "?"))
        if not self.is_(at, "(") or self.is_(j, "catch", "if", "for", "while", "switch", "function"):
            return None
        body, _ = self.result(self.after(at))
        return (j, at, body) if body < end and self.is_(body, "{") and (self.is_(self.after(at), "{") or self.is_(self.after(at), ":")) else None

    def method_(self, i: int, name_at: int, at: int, body: int, owner: str, function: str) -> int:
        stop = self.after(name_at) if self.is_(name_at, "[") else name_at + 1
        name = self.text(name_at, stop)
        full = f"{owner}.{name}" if owner else name
        words = {self.toks[k].text for k in range(i, name_at)}
        access = next((f"{w} " for w in ("public", "private", "protected") if w in words), "")
        self.node(full, "method", i, f"{access}{'async ' * ('async' in words)}{name}({self.params(at)}){self.result(self.after(at))[1]}")
        self.walk(body + 1, self.close.get(body, len(self.toks)), owner, full)
        return self.after(body)

    def arrow_at(self, i: int) -> tuple[int, int] | None:
        """(parameters, body) if an arrow function's parameters begin at i."""
        if self.word(i) and self.is_(i + 1, "=>") and not self.is_(i - 1, ".", "?."):
            return i, i + 2
        if self.is_(i, "(") and not (self.word(i - 1) and not self.is_(i - 1, "async", "return", "default")):
            j = self.after(i)
            if self.is_(j, "=>"):
                return i, j + 1
            if self.is_(j, ":"):
                stop = self.type_end(j + 1, ("=>", ";", ","))
                if self.is_(stop, "=>"):
                    return i, stop + 1
        return None

    def arrow_(self, i: int, at: int, body: int, end: int, owner: str, function: str) -> int:
        first = i - self.is_(i - 1, "async")
        if self.is_(first - 1, ">"):  # type parameters of the arrow
            depth, j = 0, first - 1
            while j >= 0:
                depth += self.is_(j, ">") - self.is_(j, "<")
                if depth == 0:
                    break
                j -= 1
            first = j
        name = self.declared_name(first - 1)
        if name is not None:
            params = self.toks[at].text if self.word(at) else self.params(at, arrow=True)
            self.node(name, "function", first, f"const {name} = ({params}) => ...")
            function = name
        return self.arrow_body(body, end, owner, function)

    def declared_name(self, i: int) -> str | None:
        """The variable that ``name [: type] =`` before, with ``=`` at token i, declares."""
        if not self.is_(i, "="):
            return None
        j = i - 1
        while j >= 0 and not self.is_(j, "const", "let", "var", ";"):
            if self.is_(j, ")", "]", "}"):
                j = self.open.get(j, j)
            j -= 1
        if not self.is_(j, "const", "let", "var"):
            return None
        while True:  # the last declarator before the sign
            k = j + 1
            stop = self.after(k) if self.is_(k, "{", "[") else k + 1
            colon = stop + self.is_(stop, "!")
            sign = self.type_end(colon + 1, ("=", ",")) if self.is_(colon, ":") else stop
            if sign == i:
                return self.text(k, stop)
            j = k
            while j < i and not self.is_(j, ","):
                j = self.after(j) if self.is_(j, "(", "[", "{") else j + 1
            if j >= i:
                return None

    def arrow_body(self, body: int, end: int, owner: str, function: str) -> int:
        if self.is_(body, "{"):
            self.walk(body + 1, self.close.get(body, len(self.toks)), owner, function)
            return self.after(body)
        # an expression: it ends at a separator, and the call that is all of it doesn't count
        j = body
        while j < end and not self.is_(j, ",", ";", ")", "]", "}"):
            if j > body and self.line(j) > self.line(j - 1) and self.toks[j].kind == "id" and not self.is_(j - 1, "=>", "+", "-", "*", "/", "&&", "||", "??", "?", ":", "=", ".", "?.", "(", ","):
                break
            j = self.after(j) if self.is_(j, "(", "[", "{") else j + 1
        whole = self.open.get(j - 1) if self.is_(j - 1, ")") else None
        if whole is not None and self.chain_start(whole - 1) != body:
            whole = None
        i = body
        while i < j:
            i = i + 1 if i == whole else max(i + 1, self.step(i, j, owner, function))
        return j

    def decorator_(self, i: int, owner: str, function: str) -> int:
        j = i + 2
        while self.is_(j, ".") and self.word(j + 1):
            j += 2
        if self.is_(j, "("):
            if owner:
                self.edge(owner, self.text(i + 1, j), "decorates", i)
            return self.after(j)
        return j

    def interface_(self, i: int) -> int:
        name = self.toks[i + 1].text
        found, body = self.clauses(self.after_generics(i + 2))
        if not self.is_(body, "{"):
            return i + 2
        bases = found.get("extends", []) if self.heritage else []
        self.node(name, "interface", i, f"interface {name}" + (f" extends {', '.join(bases)}" if bases else ""))
        for base in bases:
            self.edge(name, base, "extends", i)
        j, end = body + 1, self.close.get(body, len(self.toks))
        while j < end:
            first = j
            while self.is_(j, "readonly", "get", "set") and self.word(j + 1):
                j += 1
            if not (self.word(j) or self.toks[j].kind in ("str", "num")):
                j = self.after(j) if self.is_(j, "(", "[", "{") else j + 1
                continue
            member, k = self.toks[j].text, j + 1 + self.is_(j + 1, "?")
            at = self.after_generics(k)
            if self.is_(at, "("):
                stop = self.after(at)
                last = self.type_end(stop + 1, (";", ",", "\n")) if self.is_(stop, ":") else stop
                self.node(f"{name}.{member}", "method", first, f"{member}({self.params(at)})" + (f" -> {self.text(stop + 1, last)}" if last > stop else ""))
            else:
                last = self.type_end(k + 1, (";", ",", "\n")) if self.is_(k, ":") else k
                self.node(f"{name}.{member}", "property", first, f"{member}: {self.text(k + 1, last) if last > k else 'unknown'}")
            j = max(j + 1, last)
        return end + 1

    def type_(self, i: int) -> int:
        equals = self.after_generics(i + 2)
        stop = self.type_end(equals + 1, (";", "\n"))
        name = self.toks[i + 1].text
        self.node(name, "type", i, f"type {name} = {self.text(equals + 1, stop)}")
        return stop

    def enum_(self, i: int) -> int:
        name, end = self.toks[i + 1].text, self.close.get(i + 2, len(self.toks))
        self.node(name, "enum", i - self.is_(i - 1, "const"), f"enum {name}")
        for j in range(i + 3, end):
            if self.word(j) and self.is_(j - 1, "{", ",") and (self.is_(j + 1, ",") or j + 1 == end):
                self.node(f"{name}.{self.toks[j].text}", "enum_member", j, self.toks[j].text)
        return end + 1

    def chain_start(self, i: int) -> int:
        """The first token of the call or member chain that ends at token i."""
        while i >= 0:
            if self.is_(i, ")", "]"):
                opened = self.open.get(i)
                if opened is None:
                    return i
                before = opened - 1
                if self.is_(i, ")") and not (self.word(before) and not self.is_(before, *_NOT_CALLED) or self.is_(before, ")", "]")):
                    i = opened
                else:
                    i = before
                    continue
            if self.is_(i - 1, ".", "?."):
                i -= 2
                continue
            if self.is_(i - 1, "new"):
                return i - 1
            return i
        return 0

    def call_(self, at: int, function: str) -> None:
        """A ``calls`` edge for the bracket at ``at`` if a name or member is called."""
        last = at - 1
        if self.is_(last, ">"):
            depth, j = 0, last
            while j >= 0:
                depth += self.is_(j, ">") - self.is_(j, "<")
                if depth == 0:
                    break
                j -= 1
            if not self.word(j - 1):
                return
            last = j - 1
        if self.is_(last, "?."):
            last -= 1
        if self.is_(last, ")"):  # the result of a call is called: its name counts again
            opened = self.open.get(last)
            if opened is not None and (self.word(opened - 1) and not self.is_(opened - 1, *_NOT_CALLED)):
                name = self.callee(opened - 1)
                if name:
                    self.edge(function, name, "calls", self.chain_start(opened - 1))
            return
        if not self.word(last) or self.is_(last, *_NOT_CALLED) and not self.is_(last - 1, ".", "?."):
            return
        name = self.callee(last)
        if name:
            self.edge(function, name, "calls", self.chain_start(last))

    def callee(self, last: int) -> str | None:
        first = self.chain_start(last)
        if self.is_(first, "new") and all(not self.is_(k, "(") for k in range(first, last)):
            return None  # the arguments of ``new X``
        return self.text(first, last + 1)


def graph_rows(source: str, heritage: bool = False) -> list[tuple]:
    """("node", name, type, line, signature) and ("edge", source, target, type, line)."""
    return Scanner(source, heritage).scan()
