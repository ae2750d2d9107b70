"""String- and comment-aware lexing of nine languages with one compiled state machine per language family."""

from __future__ import annotations

import re

#: Languages by file extension (lower case, without the dot).
BY_EXTENSION = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "kt": "kotlin", "swift": "swift", "dart": "dart"}

_DQ = r'"(?:[^"\\\r\n]|\\[^\r\n]|\\\r?\n)*"'
_SQ = r"'(?:[^'\\\r\n]|\\[^\r\n]|\\\r?\n)*'"
_T3 = r'"""(?:[^"\\]|\\.|"(?!""))*"""'
_T1 = r"'''(?:[^'\\]|\\.|'(?!''))*'''"
_RAW3 = r'"""(?:[^"]|"(?!""))*"""+'
_TICK = r"`(?:[^`\\]|\\.)*`"
_LINE = r"//[^\r\n]*"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
REGEX = r"(?:(?<=[=(,:;!&|?{}\[])|(?<=return))\s*/(?![*/])(?:[^/\\\r\n\[]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*"

#: What is a comment (group c) and what is a string (group s), by language.
PIECES = {
    "python": (r"\#[^\r\n]*", rf"(?:[rRbBuUfF]{{0,2}})(?:{_T3}|{_T1}|{_DQ}|{_SQ})"),
    "javascript": (rf"{_LINE}|{_BLOCK}", rf"{_DQ}|{_SQ}|{_TICK}|{REGEX}"),
    "java": (rf"{_LINE}|{_BLOCK}", rf"{_T3}|{_DQ}|{_SQ}"),
    "go": (rf"{_LINE}|{_BLOCK}", rf"{_DQ}|`[^`]*`|{_SQ}"),
    "kotlin": (rf"{_LINE}|{_BLOCK}", rf"{_RAW3}|{_DQ}|{_SQ}"),
    "swift": (rf"{_LINE}|{_BLOCK}", rf"{_T3}|{_DQ}"),
    "dart": (rf"{_LINE}|{_BLOCK}", rf"r?(?:{_T3}|{_T1}|{_DQ}|{_SQ})"),
}
PIECES["typescript"] = PIECES["javascript"]
PIECES["rust"] = (rf"{_LINE}|{_BLOCK}", rf"b?{_DQ}|r(?P<h>\#*)\".*?\"(?P=h)|b?'(?:[^'\\\r\n]|\\[^\r\n]{{1,8}})'")
MASTER = {k: re.compile(f"(?P<c>{c})|(?P<s>{s})", re.S) for k, (c, s) in PIECES.items()}


_VISIBLE = re.compile(r"[^\r\n]")


def scan(language: str, text: str, multiline: bool = False) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """(code, comments, strings): `code` is the text with comments and strings blanked in place, so positions hold.

    With multiline, line ends within comments and strings stay.
    """
    comments, strings, out, at = [], [], [], 0
    for m in MASTER[language].finditer(text):
        a, b = m.span()
        out.append(text[at:a])
        if m.group("c") is not None:
            comments.append((a, b))
            out.append(_VISIBLE.sub(" ", text[a:b]) if multiline else " " * (b - a))
        else:
            strings.append((a, b))
            out.append(_VISIBLE.sub("\x01", text[a:b]) if multiline else "\x01" * (b - a))  # neither blank nor a word
        at = b
    out.append(text[at:])
    return "".join(out), comments, strings
