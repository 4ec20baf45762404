"""Functions, classes and other declarations of JavaScript and TypeScript sources, by their brackets and line ends.

A small reader of declarations, not a parser: it knows strings, templates, comments, regular expressions and brackets, and
says None of a source whose brackets or quotes don't match, as of one in which it finds no declaration.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Words and signs of the languages.
MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "declare", "accessor"}
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: A statement doesn't end at a line end after, or before, one of these.
GOES_ON_AFTER = set("=+-*/%&|^<>?:,.([{~!") | {"=>", "extends", "implements", "in", "of", "instanceof", "typeof", "new", "await", "async"}
GOES_ON_BEFORE = set("=+-*/%&|^<>?:,.([)]}`;") | {"=>", "extends", "implements", "in", "instanceof", "as", "satisfies"}
#: What a slash follows where it divides: a name that isn't one of these words, a number or a closing bracket; elsewhere it
#: begins a regular expression.
VALUE_END = re.compile(r"[\w$)\]}'`]\Z")
NO_VALUES = {"return", "yield", "case", "do", "else", "void", "delete", "throw", "typeof", "new", "in", "of", "instanceof", "await"}

PIECES = re.compile(
    r"""(?P<space>[^\S\n]++|\n)|(?P<comment>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<string>"(?:[^"\\\n]|\\(?:.|\n))*+"|'(?:[^'\\\n]|\\(?:.|\n))*+')
    |(?P<name>[\w$#@]++)|(?P<arrow>=>)|(?P<quote>`)|(?P<sign>.)""",
    re.VERBOSE,
)
#: Of 300 characters at most, and as many in brackets, so that a row of slashes is not looked through again and again.
PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n]){0,300}+\]){1,300}+/\w*+")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")


@dataclass
class Token:
    text: str
    line: int
    depth: int
    new_line: bool


def tokens(source: str) -> list[Token] | None:
    """The source without comments; a bracket and its partner have the depth outside. None if something isn't closed."""
    out: list[Token] = []
    stack: list[str] = []
    at, line, fresh = 0, 1, True

    def add(text: str, depth: int) -> None:
        nonlocal fresh
        out.append(Token(text, line, depth, fresh))
        fresh = False

    def template(begin: int) -> int | None:
        """Past a template's text: to its end, or into the code of its next ${."""
        found = TEMPLATE.match(source, begin)
        if found is None:
            return None
        if found[1] == "${":
            stack.append("${")
        return found.end()

    while at < len(source):
        piece = PIECES.match(source, at)
        kind, text, end = piece.lastgroup, piece[0], piece.end()
        if kind == "space":
            fresh = fresh or text == "\n"
        elif kind == "comment":
            fresh = fresh or "\n" in text
        elif kind == "quote":
            add("`", len(stack))
            end = template(end)
        elif text == "/" and not (out and VALUE_END.search(out[-1].text) and out[-1].text not in NO_VALUES) and (found := PATTERN.match(source, at)):
            add("/pattern/", len(stack))
            end = found.end()
        elif text in ('"', "'"):
            return None
        elif kind == "sign" and text == "}" and stack and stack[-1] == "${":
            stack.pop()
            end = template(end)
            if end is not None and source[end - 1] == "`":
                add("''", len(stack))  # what comes next stands behind a value
        elif kind == "sign" and text in OPENS:
            add(text, len(stack))
            stack.append(text)
        elif kind == "sign" and text in CLOSES:
            if not stack or stack.pop() != CLOSES[text]:
                return None
            add(text, len(stack))
        elif kind != "space":
            add("''" if kind == "string" else text, len(stack))
        if end is None:
            return None
        line += source.count("\n", at, end)
        at = end
    return None if stack else out


def partner(found: list[Token], at: int) -> int:
    """Where the bracket that is opened at a place is closed."""
    return next(i for i in range(at + 1, len(found)) if found[i].depth == found[at].depth and found[i].text in CLOSES)


def statement_end(found: list[Token], at: int, depth: int, last: int) -> int:
    """The last token of the statement that begins at a place, by a semicolon or a line end outside of its brackets."""
    for i in range(at, last):
        if found[i].depth > depth:
            continue
        if found[i].text == ";":
            return i
        following = found[i + 1] if i < last and found[i].text not in OPENS else None
        if following and following.depth <= depth and following.new_line and found[i].text not in GOES_ON_AFTER and following.text not in GOES_ON_BEFORE:
            return i
    return last


def body_of(found: list[Token], at: int, depth: int, stop: tuple[str, ...] = (";",)) -> int | None:
    """The brace that opens the body of a declaration; None if a stop comes first."""
    for i in range(at, len(found)):
        if found[i].depth < depth or found[i].depth == depth and found[i].text in stop:
            return None
        if found[i].depth == depth and found[i].text == "{":
            return i
    return None


def methods(found: list[Token], opening: int, closing: int) -> list[tuple[str, str, int, int]]:
    out, at, depth = [], opening + 1, found[opening].depth + 1
    while at < closing:
        start = at
        while found[at].text in MODIFIERS | {"*"} and at + 1 < closing and found[at + 1].text not in ("(", "=", ";", ":", "?"):
            at += 1
        name = found[at]
        calls = at + 1
        if calls < closing and found[calls].text == "<":
            calls = next((i for i in range(calls, closing) if found[i].depth == depth and found[i].text == "("), closing)
        if name.text.startswith("@"):  # a decorator stands before what it decorates
            at = partner(found, at + 1) + 1 if found[at + 1].text == "(" else at + 1
        elif calls < closing and found[calls].text == "(" and re.match(r"[\w$#]", name.text):
            after = partner(found, calls) + 1
            body = body_of(found, after, depth) if after < closing and found[after].text in ("{", ":") else None
            if body is not None and body < closing:
                at = partner(found, body)
                out.append(("method", name.text, found[start].line, found[at].line))
                at += 1
            else:
                at = statement_end(found, after - 1, depth, closing - 1) + 1
        else:
            at = statement_end(found, at, depth, closing - 1) + 1
    return out


def braced_entities(source: str | None, typed: bool) -> list[tuple[str, str | None, int, int]] | None:
    """(kind, name, first line, last line) of a source's top-level declarations, whether exported or not, and of the methods
    of its classes. typed: TypeScript, which has interfaces, types and enums, too."""
    found = tokens(source or "")
    if not found:
        return None
    out: list[tuple[str, str | None, int, int]] = []
    at, last = 0, len(found) - 1
    word = lambda i: found[i].text if i <= last else ""
    while at <= last:
        start = at
        if word(start) == "export":
            start += 1 + (word(start + 1) == "default")
        head = start + (word(start) == "async" and word(start + 1) == "function")
        kind, name = word(head), head + 1
        if kind == "const" and word(name) == "enum":
            kind, name = "enum", name + 1
        star = kind == "function" and word(name) == "*"
        name += star
        named = bool(re.match(r"[\w$]", word(name)))
        if named and (kind in ("function", "class") or typed and kind in ("interface", "enum")):
            body = body_of(found, name, 0)
            if body is None:
                if kind == "class":
                    return None
                at = statement_end(found, start, 0, last) + 1
                continue
            closing = partner(found, body)
            if not (star and typed):
                out.append((kind, word(name), found[start].line, found[closing].line))
            if kind == "class":
                out += methods(found, body, closing)
            at = closing + 1
        else:
            end = statement_end(found, start, 0, last)
            if kind in ("const", "let") and (named or word(name) in "{["):
                out.append(("declaration", word(name) if named else None, found[start].line, found[end].line))
            elif typed and kind == "type" and named and word(name + 1) in ("=", "<"):
                out.append(("type", word(name), found[start].line, found[end].line))
            at = end + 1
    return out or None
