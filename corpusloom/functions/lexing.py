"""Comments and literals of languages with braces: found by one pass over a text, so that brackets in them don't count."""

from __future__ import annotations

import re
from collections.abc import Iterator

_BLOCK = r"/\*(?s:.*?)(?:\*/|\Z)"
_LINE = r"//[^\n]*"
_DOUBLE = r'"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*(?:"|$|\Z)'
_SINGLE = r"'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*(?:'|$|\Z)"
_TEXT_BLOCK = r'"""(?s:[^\\]|\\.)*?(?:"""|\Z)'
#: A line of the preprocessor, with those it goes on in.
_HASH_LINE = r"^[ \t]*#(?:[^\n\\]|\\(?s:.))*"

#: By language, what is a comment or a literal. The first that fits at a place counts; a group "code" is passed over as it is.
LITERALS = {
    "java": [_BLOCK, _LINE, _TEXT_BLOCK, _DOUBLE, _SINGLE],
    "cpp": [_BLOCK, _LINE, _HASH_LINE, r'(?:u8|[uUL])?R"(?P<d>[^()\\\s"]{0,16})\((?s:.*?)(?:\)(?P=d)"|\Z)', r"(?P<code>\b\d(?:'?[\w.])*)", _DOUBLE, _SINGLE],
    "csharp": [_BLOCK, _LINE, _HASH_LINE, r'\$*(?P<q>"{3,})(?s:.*?)(?:(?P=q)|\Z)', r'(?:@\$?|\$@)"(?:[^"]|"")*(?:"|\Z)', _DOUBLE, _SINGLE],
    "rust": [r"(?P<nested>/\*)", _LINE, r'\b[bc]?r(?P<h>\#*)"(?s:.*?)(?:"(?P=h)|\Z)', r'"[^"\\]*(?:\\(?s:.)[^"\\]*)*(?:"|\Z)', r"'(?:\\(?:x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]*\}|.)|[^'\\\n])'", r"(?P<code>'\w+)"],
    "javascript": [_BLOCK, _LINE, _DOUBLE, _SINGLE, r"(?P<template>`)", r"(?P<open>\{)", r"(?P<close>\})", r"(?P<slash>/)"],
}
LITERALS["typescript"] = LITERALS["javascript"]
_COMPILED = {k: re.compile("|".join(f"(?:{p})" for p in v), re.MULTILINE) for k, v in LITERALS.items()}
_NEST = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\(?s:.)|\$(?!\{))[^`\\$]*)*(`|\$\{|\Z)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: Behind these a slash begins a regular expression; behind other words, numbers and closed brackets it divides.
_BEFORE_REGEX = re.compile(r"(?:^|[(\[{,;=:!&|?+\-*%<>~^}]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|yield|await))$")
#: Line ends as str.splitlines has them, which stay.
_VISIBLE = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+")


def literals(code: str, language: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each comment and literal, in order. What isn't closed goes on to the end, or to the end of its line. Of a template, the code in it isn't part."""
    pattern, at, held, behind = _COMPILED[language], 0, [], ""
    while m := pattern.search(code, at):
        behind = (behind + code[at : m.start()]).rstrip()[-12:]
        kind, at = m.lastgroup, m.end()
        if kind == "code":
            behind = m[0][-12:]
            continue
        if kind == "open":
            held.append("{")
            behind = "{"
            continue
        if kind == "slash":
            found = _REGEX.match(code, m.start()) if _BEFORE_REGEX.search(behind) else None
            behind = "x" if found else "/"
            if found:
                at = found.end()
                yield found.span()
            continue
        if kind == "nested":
            depth = 1
            while depth and (n := _NEST.search(code, at)):
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
            at = len(code) if depth else at
        elif kind == "template" or kind == "close" and held and held.pop() == "$":
            part = _TEMPLATE.match(code, at)
            at = part.end()
            if part[1] == "${":
                held.append("$")
                behind = "{"
            else:
                behind = "x"
        elif kind == "close":
            behind = "}"
            continue
        elif not m[0].startswith(("//", "/*")):
            behind = "x"
        yield m.start(), at


def blanked(code: str, language: str) -> str:
    """code with blanks for its comments and literals, as long as before and with the same lines."""
    out, at = [], 0
    for start, end in literals(code, language):
        out += [code[at:start], _VISIBLE.sub(lambda m: " " * len(m[0]), code[start:end])]
        at = end
    return "".join(out) + code[at:]


def depths(code: str, language: str) -> list[int]:
    """How many brackets are open behind each character, those in comments and literals aside."""
    out, depth = [], 0
    for ch in blanked(code, language):
        depth += (ch in "([{") - (ch in ")]}")
        out.append(depth)
    return out
