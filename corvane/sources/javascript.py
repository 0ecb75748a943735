"""Top-level symbols of JavaScript and TypeScript by a tokenizing scanner.

Found are function declarations and arrow functions bound by let, const or
var, wherever they stand outside a function, classes with their first
base, and imports. Methods and function expressions are no symbols of
their own.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
    |(?P<name>[A-Za-z_$][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<mark>=>|\.\.\.|[^\s\w])""",
    re.VERBOSE | re.DOTALL,
)
_OPEN, _CLOSE = "([{", ")]}"
_NOT_CALLED = frozenset(("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "async", "super", "constructor", "import"))


class _Tokens:
    def __init__(self, text: str) -> None:
        self.text, self.items = text, []
        at, after_value = 0, False
        while at < len(text):
            if text[at] == "/" and not after_value and text[at : at + 2] not in ("//", "/*"):
                # a regular expression can only stand where no value stands before it
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(text, at)
                if m:
                    self.items.append(("text", m[0], at, m.end()))
                    at, after_value = m.end(), True
                    continue
            m = _TOKEN.match(text, at)
            if not m:
                at += 1
                continue
            if m.lastgroup != "skip":
                self.items.append((m.lastgroup, m[0], at, m.end()))
                after_value = m.lastgroup in ("text", "number") or m[0] in (")", "]", "}") or (m.lastgroup == "name" and m[0] not in ("return", "typeof", "case", "in", "of"))
            at = m.end()

    def is_(self, i: int, *values: str) -> bool:
        return 0 <= i < len(self.items) and self.items[i][1] in values

    def close(self, i: int) -> int:
        """The place after the bracket that closes the one at i."""
        depth = 0
        for j in range(i, len(self.items)):
            kind, value = self.items[j][:2]
            if kind == "mark" and value in _OPEN:
                depth += 1
            elif kind == "mark" and value in _CLOSE:
                depth -= 1
                if depth == 0:
                    return j + 1
        return len(self.items)

    def until(self, i: int, *values: str) -> int:
        """The place of the first of ``values`` outside brackets."""
        while i < len(self.items) and not self.is_(i, *values):
            i = self.close(i) if self.items[i][0] == "mark" and self.items[i][1] in _OPEN else i + 1
        return i

    def statement_end(self, i: int) -> int:
        """The place after a statement: at a semicolon, or where a line ends outside brackets."""
        while i < len(self.items):
            if self.is_(i, ";"):
                return i
            step = self.close(i) if self.items[i][0] == "mark" and self.items[i][1] in _OPEN else i + 1
            if step >= len(self.items) or ("\n" in self.text[self.items[step - 1][3] : self.items[step][2]] and not self.is_(step, ".", "=>", "?", ":", "+", "-", "&", "|", ",", "=")):
                return step
            i = step
        return i


def _calls(t: _Tokens, i: int, j: int) -> list[str]:
    found = []
    for k in range(i, j - 1):
        kind, value = t.items[k][:2]
        if kind == "name" and value not in _NOT_CALLED and t.is_(k + 1, "(") and not t.is_(k - 1, "function", "new"):
            # a method's head, not a call: a block follows its brackets and no dot stands before it
            if t.is_(t.close(k + 1), "{") and not t.is_(k - 1, ".", "=", "(", ","):
                continue
            found.append(value)
    return list(dict.fromkeys(found))


def symbols(text: str) -> list[dict]:
    t = _Tokens(text)
    functions, classes, imports = [], [], []

    def row(kind: str, name: str, i: int, j: int, **more) -> dict:
        start, end = t.items[i][2], t.items[j - 1][3]
        return {
            "kind": kind, "name": name, "line_start": text.count("\n", 0, start) + 1, "line_end": text.count("\n", 0, end) + 1, "source_code": text[start:end],
        } | more

    def scan(i: int, stop: int) -> None:
        while i < stop:
            kind, value = t.items[i][:2]
            if value == "function" and kind == "name" and not t.is_(i - 1, "=", "(", ",", ":", "?", "return", "=>", ".", "new"):
                at = i + 2 if t.is_(i + 1, "*") else i + 1
                start = i - 1 if t.is_(i - 1, "async") else i
                if at < stop and t.items[at][0] == "name":
                    body = t.until(t.close(t.until(at, "(")), "{")
                    end = t.close(body)
                    if at == i + 1:  # generators are another kind of node and no symbols
                        functions.append(row("function", t.items[at][1], start, end, calls=_calls(t, body, end)))
                    i = end
                    continue
            elif value == "class" and kind == "name" and not t.is_(i - 1, ".", "=", "(", ",", ":", "return") and i + 1 < stop and t.items[i + 1][0] == "name":
                body = t.until(i + 2, "{")
                bases = [t.items[k + 1][1] for k in range(i + 2, body) if t.is_(k, "extends") and k + 1 < body]
                end = t.close(body)
                classes.append(row("class", t.items[i + 1][1], i, end, base_classes=bases))
                i = end
                continue
            elif value in ("const", "let", "var") and kind == "name":
                end = t.statement_end(i + 1)
                if i + 1 < stop and t.items[i + 1][0] == "name":
                    equals = t.until(i + 2, "=", ";", ",")
                    if t.is_(equals, "=") and equals < end:
                        at = equals + 1 + t.is_(equals + 1, "async")
                        head = t.close(at) if t.is_(at, "(") else at + 1
                        arrow = t.until(head, "=>", ";", ",") if t.is_(head, ":") else head
                        if t.is_(arrow, "=>") and arrow < end:
                            functions.append(row("function", t.items[i + 1][1], equals + 1, end, calls=_calls(t, arrow, end)))
                i = max(end, i + 1)
                continue
            elif value == "import" and kind == "name" and not t.is_(i + 1, "(", "."):
                end = t.statement_end(i + 1)
                stop_at = t.items[end][3] if t.is_(end, ";") else t.items[end - 1][3]
                imports.append(row("import", text[t.items[i][2] : stop_at], i, max(end, i + 1), names=[]))
                i = max(end, i + 1)
                continue
            i += 1

    scan(0, len(t.items))
    return functions + classes + imports
