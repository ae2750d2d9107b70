"""Source files that do not parse: an error-correcting chart over brackets, and sequences of tokens that no valid file has.

Each language's grammar is split by bracket level: brackets form a context-free (Dyck) language, and what stands between
them a local language over token classes, in which a string belongs exactly if none of the forbidden class sequences
occurs in it. The cost of a file adds the least number of brackets to delete, insert or replace, by the chart over those
that don't cancel, to one edit for each forbidden sequence and each character that is no token; an edit that would mend both counts twice.
Cost 0 means it parses. Python and JSON have exact parsers at hand; what they accept costs 0 without a chart, what they reject at least 1.
The places of the edits tell truncation, merge conflicts and content of another language apart.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexing
from lodestone.session import cut

#: Extensions that are judged, with their language.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "kt": "kotlin", "swift": "swift", "dart": "dart", "json": "json", "yaml": "yaml", "yml": "yaml"}

#: Classes of words, by language. i: heads with a bracketed condition; h: heads with a bare one; l: words before
#: a block; r: words before an operand; v: words before a name; f: words before a declared name; m: modifiers;
#: p: package or import; o: operators; b: words that stand alone; c: case labels; k: between clauses.
WORDS = {
    "javascript": {"i": "if while switch with", "g": "for", "l": "else try do finally", "z": "catch", "r": "return throw new typeof delete await yield void", "v": "const let var", "f": "function class", "m": "static async get set", "p": "import", "e": "export", "o": "instanceof in of extends from as", "b": "break continue debugger", "c": "case", "d": "default"},
    "java": {"i": "if while switch for synchronized", "l": "else do finally", "t": "try", "z": "catch", "r": "return throw new assert yield", "f": "class interface enum record", "m": "public private protected static final abstract native transient volatile strictfp sealed", "p": "import package", "o": "instanceof extends implements throws", "b": "break continue", "c": "case", "d": "default"},
    "go": {"h": "if for switch select", "l": "else", "r": "return go defer range", "v": "var const", "f": "func type", "q": "struct interface map chan", "p": "import package", "b": "break continue goto fallthrough", "c": "case", "d": "default"},
    "kotlin": {"i": "if while for", "t": "when", "l": "else try do finally", "z": "catch", "r": "return throw", "v": "val var", "f": "fun class interface object typealias get set", "m": "public private protected internal open override abstract suspend inline lateinit tailrec operator infix external companion vararg crossinline noinline reified out", "p": "import package", "j": "in is as by", "b": "break continue"},
    "swift": {"h": "if for while switch guard repeat", "l": "else do", "z": "catch", "r": "return throw try await", "v": "let var", "f": "func class struct enum protocol extension actor typealias", "m": "public private fileprivate internal open static final override mutating nonmutating lazy weak unowned convenience required indirect inout some any", "p": "import", "o": "in is as where throws rethrows", "b": "break continue fallthrough", "c": "case", "d": "default"},
    "dart": {"i": "if while for switch", "l": "else try do finally", "z": "catch", "r": "return throw new await assert yield", "v": "var", "w": "final const late", "f": "class enum mixin extension typedef", "m": "static abstract external covariant required factory get set operator", "p": "import export part library", "o": "in is as extends implements with on show hide", "b": "break continue rethrow", "c": "case", "d": "default"},
}
WORDS["typescript"] = WORDS["javascript"] | {"m": "static async get set public private protected readonly abstract declare override module keyof infer unique asserts accessor", "f": "function class interface enum namespace", "o": "instanceof in of extends implements from as is satisfies", "y": "type"}

#: Operators by class. =: assigns; o: binary only; +: sign or binary; !: prefix; u: ++ and --; A: arrows; S: spread or range.
_OPERATORS = {
    "=": "= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^= ~/= ?\x00",
    "o": "== != === !== <= >= && || / % ^ | << >> >>> ** ?? ?: &^ ~/ is! as? as! !in !is .. ..< &+ &- &* ===",
    "+": "+ - * & <-", "!": "! ~", "u": "++ --", "A": "=> ->", "S": "...", "W": ":=", "<": "<", ">": ">", "?": "? ?. ::", "@": "@",
}
_OP_CLASS = {op: k for k, v in _OPERATORS.items() for op in v.split()} | {x: x for x in "()[]{},;:."}
_OP_CLASS |= {"?.": ".", "!!": "!", "!.": ".", "::": ".", "..": "S", "..<": "S", "&.": "."}
_OPS = r">>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|&\^=|===|!==|>>>|\.\.\.|\.\.<|~/=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|=>|->|<-|:=|::|\?\.|\?\?|\?:|<<|>>|\*\*|~/|&\^|\.\.|[-+*/%=<>!~&|^?:;,.(){}\[\]@]"
_WORD = r"[^\W\d][\w$]*|\$[\w$]*|#[A-Za-z_]\w*"
_NUMBER = r"\d(?:[\w.]*(?<=[eE])[+-]\d\w*|\w*(?:\.\d\w*)*)|\.\d\w*"


@cache
def _lexer(language: str) -> re.Pattern:
    comment, string = lexing.PIECES[language]
    line, pattern, word = r"|(?P<N>[\r\n]+)", "", _WORD
    if language == "dart":
        word = rf"(?!r[\"'])(?:{_WORD})"  # r before a quote belongs to the string
    if lexing.REGEX in string:  # a regular expression begins where an operand is due, before blanks are taken
        string = string.replace(f"|{lexing.REGEX}", "")
        pattern = lexing.REGEX.replace(r"\s*/", r"\s*(?P<q>/", 1) + ")|"
    return re.compile(rf"{pattern}[ \t\f\v\ufeff\u00a0]*(?:(?P<w>{word})|(?P<c>{comment})|(?P<s>{string}){line}|(?P<o>{_OPS})|(?P<n>{_NUMBER})|(?P<x>\S)|\Z)", re.S)


@cache
def _classes(language: str) -> dict[str, str]:
    table = {w: k for k, v in WORDS[language].items() for w in v.split()}
    return table


#: Languages in which a line end can end a statement.
_BY_LINE = {"javascript", "typescript", "go", "kotlin", "swift"}


class Tokens(NamedTuple):
    classes: str
    starts: list[int]


_ANNOTATION = re.compile(r"@a(?:\.a)*|@(?=f)")


def _annotations(classes: str) -> str:
    """Annotations' names become D, which stands beside anything; what is left as @ is none."""
    return _ANNOTATION.sub(lambda m: "D" * len(m.group()), classes) if "@" in classes else classes


def classes_of(language: str, text: str) -> str:
    """The class of each token as one character. Comments are left out; in languages without line-bound statements,
    line ends too. x: no token."""
    words, ops, by_line, last = _classes(language), _OP_CLASS, language in _BY_LINE, "N"
    out = []
    add = out.append
    for m in _lexer(language).finditer(text):
        k = m.lastgroup
        if k == "w":
            k = "a" if last == "." else words.get(m[k], "a") if m[k][0] != "#" or language != "swift" else "r"
        elif k == "o":
            k = ops.get(m[k], "o")
        elif k is None or k == "c" or k == "N" and (not by_line or last == "N"):
            continue
        elif k == "q":
            k = "s"
        add(k)
        last = k
    return _annotations("".join(out))


def tokens(language: str, text: str) -> Tokens:
    """As classes_of, with the position of each token."""
    words, by_line, last = _classes(language), language in _BY_LINE, "N"
    out, starts = [], []
    for m in _lexer(language).finditer(text):
        k = m.lastgroup
        if k == "w":
            k = "a" if last == "." else words.get(m.group(k), "a") if m.group(k)[0] != "#" or language != "swift" else "r"
        elif k == "o":
            k = _OP_CLASS.get(m.group(k), "o")
        elif k is None or k == "c" or k == "N" and (not by_line or last == "N"):
            continue
        elif k == "q":
            k = "s"
        out.append(k)
        starts.append(m.start(m.lastgroup))
        last = k
    return Tokens(_annotations("".join(out)), starts)


#: Class sequences that no valid file of a language has (N: line end). Operands are a n s; openers ( [ {; closers ) ] }.
_NEVER = r"x|o>|<N?[=oW]|(?:[=oW<.A]|(?<!\.)\+)N?[)\]};,]|[=oW]N?[=oW]|\.N?[^aNFfirvbcdeghjklmopqtwyz\[(<!{S+]|[(\[{,;]N?[oW.](?<!\.)|,N?,|\(N?,|@|[an\]][ns]|s[n]|[na]x|nN?\(|n\{n|u[=o]|\?[)\];,}](?<!\?[)\];,}>])"
_JS = _NEVER + r"|[ns]a|[as]s|\]a|aa|a[vfibcd]|\}=(?!=)|[ig](?!N?\()(?!m|a|r)|v(?!N?[a\[{eoms])|f(?!N?[a(*{=+o\[mf])|:=|W"
_GO = _NEVER.replace(r"[an\]][ns]|s[n]", r"[n\]][ns]|an|s[n]").replace(r"(<!{S+]", r"(<!{S+s]")
_KOTLIN = _NEVER.replace(r"[an\]][ns]|s[n]", r"nn|ns|\][ns]|sn")
_FORBIDDEN = {
    "javascript": _JS,
    "typescript": _JS,
    "java": _NEVER + r"|[ns]a|[as]s|aa[.an+o{]|[ans)\]}>]p(?<!\}p)|p(?!a|m)|W|i(?!\()|z(?!\()|\}=|m[=o+;),.\]}](?<!m\))|aA\{$|\]\(|:[;)]",
    "go": _GO + r"|^(?!N?p)|raa|[ns]a|[as]s(?<!as)|aa[.=oW(]|\}=|p(?!N?[as(]|a)|h;?[;]{3}|[ans]p|A|i|u[an(]|\)N?W|nN?W|sN?W",
    "kotlin": _KOTLIN + r"|W|i(?!N?\()|z(?!N?\()|\}=|m(?!N?[mfvaD@\[{pc(]|b)|m[a][a(<]|aa[=).;,\]}N:]|p(?!a)|v(?!N?[a(<@])|[as]s(?!N?[.)\]},+;N]|o)|A[)\],;]|f(?!N?[a(<{:f])",
    "swift": _NEVER + r"|[ns]a|[as]s|aa(?!:)|W|\}=|m(?!N?[mfvp@c(a])|p(?!N?[afv])|v(?!N?[a(])|f(?!N?[afv(+o!<=])|\]a|;N?\}{2}$",
    "dart": _NEVER + r"|[n]a|[a]s(?<!as)|aa[.an+o\]]|W|i(?!\()|z(?!\()|\}=|p(?!s|a)|[ans)\]>]p|\]a",
}
# a string literal before a bracketed prefix letter is a tag, not two operands
_FORBIDDEN["javascript"] = _FORBIDDEN["typescript"] = _JS.replace("[as]s|", "s{2}|")


@cache
def _forbidden(language: str) -> re.Pattern:
    return re.compile(_FORBIDDEN[language])


# a bracketed condition isn't empty
for _l in ("javascript", "typescript", "java", "kotlin", "dart"):
    _FORBIDDEN[_l] += r"|[ig]\(N?\)" + ("" if _l in ("javascript", "typescript") else r"|z\(N?\)") + (r"|va[ns]" if _l == "kotlin" else "")

#: Clauses and what must stand before them within the same brackets; labels and what must head their block.
_CLAUSES = {"else": ("if",), "catch": ("try",), "finally": ("try",)}
_LABELS = {"case": ("switch",)}
_OWN = {"swift": ({"else": ("if", "guard"), "catch": ("do",)}, {"case": ("switch", "enum")}), "go": ({"else": ("if",)}, {"case": ("switch", "select")}), "kotlin": (_CLAUSES, {})}


def _clauses(language: str, text: str) -> list[int]:
    """Places (as in `tokens`) of clauses without their head: else without if, catch without try, case outside a switch.

    Within one pair of brackets there are never more else than if; a case is in braces that follow a switch.
    """
    clauses, labels = _OWN.get(language, (_CLAUSES, _LABELS))
    heads = {h for v in (*clauses.values(), *labels.values()) for h in v}
    words, by_line, last, before, n, bad, due = _classes(language), language in _BY_LINE, "N", "N", 0, [], None
    levels: list[tuple[str, dict[str, int], bool]] = [("{", {}, False)]
    for m in _lexer(language).finditer(text):
        k = m.lastgroup
        if k is None or k == "c" or k == "N" and (not by_line or last == "N"):
            continue
        if k != "N":
            x = m.group(k)
            if due is not None and x not in (":", "->", "=>", "?", "?:", ",", "=", ";", ")", "}"):  # else it's a name, or a branch of `when`
                bad.append(due)
            due = None
            if k == "o" and x in "([{":
                levels.append((x, {}, any(levels[-1][1].get(h) for v in labels.values() for h in v)))
            elif k == "o" and x in ")]}":
                if len(levels) > 1:
                    levels.pop()
            elif k == "w" and _OP_CLASS.get(before) != "." and words.get(before) not in ("f", "m"):
                seen = levels[-1][1]
                if x in heads:
                    seen[x] = seen.get(x, 0) + 1
                if x in clauses:
                    own = sum(seen.get(h, 0) for h in clauses[x])
                    seen[x] = seen.get(x, 0) + 1
                    if own < (seen[x] if x == "else" else 1):
                        due = n
                elif x in labels and levels[-1][0] == "{" and not levels[-1][2] and before not in ("if", "guard", "for", "while", ","):
                    due = n
            before = x
        n, last = n + 1, k
    return bad


_PAIR = {"(": ")", "[": "]", "{": "}"}


def residue(classes: str) -> list[int]:
    """Positions of the brackets that are left after all matching neighbours have cancelled."""
    stack: list[int] = []
    for i, c in enumerate(classes):
        if c in "([{":
            stack.append(i)
        elif c in ")]}":
            if stack and _PAIR.get(classes[stack[-1]]) == c:
                stack.pop()
            else:
                stack.append(i)
    return stack


def _bounds(left: str) -> tuple[int, int]:
    """What balancing a residue costs at least and at most, in one pass over it.

    At least one edit for each opening bracket before a closing one, as they differ in kind, and one for every two brackets that have
    no partner of their kind; at most what it costs to match regardless of kind, then the rest two by two.
    """
    stack, wrong, lone, own, open_of = [], 0, 0, 0, dict.fromkeys("([{", 0)
    for c in left:
        if c in "([{":
            stack.append(c)
            open_of[c] += 1
            continue
        kind = "([{"[")]}".index(c)]
        if open_of[kind]:
            open_of[kind] -= 1
            own += 1
        if stack:
            wrong += stack.pop() != kind
        else:
            lone += 1
    n = len(left)
    differ = sum(a in "([{" and b in ")]}" for a, b in zip(left, left[1:]))
    return max(differ, (n + 1) // 2 - own), wrong + (lone + 1) // 2 + (len(stack) + 1) // 2


def dyck_cost(brackets: str) -> int:
    """The least number of deletions, insertions or replacements that balance a string of brackets, by a chart over its spans.

    Matching neighbours cancel first, which costs nothing. The chart over what is left has all spans, and any two brackets may be matched:
    rows from the last bracket up, each made from the rows below it by the partners of its first bracket. A partner counts only where
    it beats nearer ones, as else a nearer one and the span between give the same. Where the bounds meet no chart is needed.
    """
    left = "".join(brackets[i] for i in residue(brackets))
    least, most = _bounds(left)
    if least == most:
        return least
    n = len(left)
    code = np.array(["([{)]}".index(c) for c in left], dtype=np.int8)
    far = n // 2 + 2  # more than any span costs, as two neighbours cost 1 at most but for one pair of a closing and an opening one
    kind = np.int16 if 2 * far + 4 < 1 << 15 else np.int32
    # pair[c][k]: what it costs to make a bracket of code c and a later one at k partners
    pair = np.ones((6, n), dtype=kind)
    for c in range(3):
        pair[c, code == c + 3] = 0
    pair[3:, code < 3] = 2
    # chart[i][j]: the cost of the span from i up to j, less `far`; what is never written, as j < i, stays 0
    chart = np.zeros((n + 2, n + 1), dtype=kind)
    chart[n, n] = -far
    for i in range(n - 1, -1, -1):
        below, row = chart[i + 1, i + 1 :], chart[i, i:]
        row[0] = -far
        np.add(below, 1, out=row[1:])  # the first is deleted, or gets a partner
        inner = pair[code[i], i + 1 :] + below[:-1]
        ks, some = np.flatnonzero(inner < row[2:]), 4
        while ks.size:
            now, ks = ks[:some], ks[some:]
            first = now[0] + 2
            spans = chart[now + i + 2, i + first :]
            spans += (inner[now] + far).astype(kind)[:, None]
            np.minimum(row[first:], spans.min(axis=0), out=row[first:])
            ks, some = ks[inner[ks] < row[ks + 2]], min(2 * some, 64)
    return int(chart[0, n]) + far


class Verdict(NamedTuple):
    cost: int
    position: int  # of the first edit
    kind: str  # '', 'truncation', 'conflict', 'mismatch' or 'syntax'


_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: .*)?$", re.M)
_MARKUP = re.compile(r"\s*<(?:!DOCTYPE|html|\?xml)", re.I)
_PATCH = re.compile(r"(?:\A|[\r\n])(?:--- \S+[\r\n]+\+\+\+ |@@ -\d)")
VALID = Verdict(0, -1, "")


def _suspects(language: str, classes: str) -> list[int]:
    """Places of the sequences that can't be in a valid file."""
    bad = [m.start() for m in _forbidden(language).finditer(classes)]
    if language in ("javascript", "typescript"):
        bad = [i for i in bad if not _pattern_or_type(language, classes, i)]
        if language == "javascript":
            bad += _typed(classes)
    return bad


def _judged(language: str, text: str) -> Verdict:
    classes = classes_of(language, text)
    if not residue(classes) and not _suspects(language, classes) and not _clauses(language, text):
        return VALID
    t = tokens(language, text)
    left = residue(t.classes)
    bad = _suspects(language, t.classes) + ([] if left else _clauses(language, text))
    cost = dyck_cost("".join(t.classes[i] for i in left)) + len(bad)
    first = min(t.starts[i] if i < len(t.starts) else len(text) for i in [*left[:1], *bad[:1]])
    at_end = bool(left or bad) and all(c in "([{" for c in (t.classes[i] for i in left)) and all(i >= len(t.classes) - 3 or t.classes[i] == "x" and "\n" not in text[t.starts[i] :].rstrip("\r\n").replace("\r", "\n") for i in bad)
    return Verdict(cost, first, _kind(text, at_end, cost, len(t.classes)))


def _kind(text: str, at_end: bool, cost: int, size: int) -> str:
    if _MARKUP.match(text) or _PATCH.search(text):
        return "mismatch"
    if len(_CONFLICT.findall(text)) >= 2:
        return "conflict"
    if at_end:
        return "truncation"
    return "mismatch" if cost > 4 and cost > 0.02 * size else "syntax"


def _open_of(classes: str, at: int) -> int:
    """The opening bracket that matches the closing one at `at`, or -1."""
    depth = 0
    for i in range(at, -1, -1):
        if classes[i] in ")]}":
            depth += 1
        elif classes[i] in "([{":
            depth -= 1
            if depth == 0:
                return i
    return -1


def _pattern_or_type(language: str, classes: str, at: int) -> bool:
    """Whether `}=` assigns to a pattern, or a sequence belongs to a type (in TypeScript)."""
    found = classes[at : at + 2]
    if found == "}=":
        i = _open_of(classes, at)
        return i > 0 and classes[i - 1] in "v(,[=:" or i > 1 and classes[i - 1] == "N" and classes[i - 2] in "(,[="
    return language == "typescript" and found[0] in ">." and classes[at - 1 : at] in ("a", ">", "]")


def _statement(classes: str, at: int) -> int:
    """Where the statement that holds `at` begins: after the last end of a statement, block or line."""
    return max(classes.rfind(c, 0, at) for c in ";{}N") + 1


_TYPED = re.compile(r"\)N?:[a\[{r]+(?:<[a,<>\[\]]*>)?(?:\[\])*N?\{|[(,]N?a\??:a(?:<[a,<>\[\]]*>)?(?:\[\])*(?=[,)=])(?<!\{a)|[yf]a\{a:a|va:a=")
_OPEN_PAREN = re.compile(r"[(\[{]")


def _typed(classes: str) -> list[int]:
    """Places of type annotations, which JavaScript doesn't have: after a parameter within round brackets or after a signature."""
    out = []
    for m in _TYPED.finditer(classes):
        g = m.group()
        if g[0] == ",":
            depth, i = 0, m.start()
            while i >= 0 and not (depth == 0 and classes[i] in "([{"):
                depth += (classes[i] in ")]}") - (classes[i] in "([{")
                i -= 1
            if i < 0 or classes[i] != "(" or "?" in classes[i : m.end()]:
                continue
        if g[0] == ")" and classes[_open_of(classes, m.start()) - 1 : _open_of(classes, m.start())] not in ("a", "f"):
            continue
        if "?" in classes[_statement(classes, m.start()) : m.start()]:  # a colon after a question mark belongs to it
            continue
        out.append(m.start())
    return out


def _python(text: str) -> Verdict:
    deep = False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                compile(text, "f", "exec", dont_inherit=True)  # faster than the tree, and what compiles parses
            except SyntaxError:
                compile(text, "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)  # a misplaced return parses
        return VALID
    except SyntaxError as e:
        line = e.lineno or 1
    except ValueError:
        line = 1
    except (MemoryError, RecursionError):
        deep, line = True, 1  # deeper than the parser's stack, which says nothing about its grammar: the chart decides
    code, _, strings = lexing.scan("python", text)
    left = residue(code)
    bad = [m.start() for m in re.finditer(r"[\"'`$?!“”‘’](?!=)|:=\s*$|^(?:<{7}|>{7}|={7}$|@@)", code, re.M)]
    cost = max(0 if deep else 1, dyck_cost("".join(code[i] for i in left)) + len(bad))
    if not cost:
        return VALID
    lines = re.split(r"\r\n|\n|\r", text)
    position = len("\n".join(lines[: line - 1])) + 1 if line > 1 else 0
    at_end = line >= len(lines) - 1 or bool(left) and all(code[i] in "([{" for i in left) and len(lines) - line <= 1
    return Verdict(cost, position, _kind(text, at_end, cost, len(re.findall(r"\w+|[^\w\s]", code))))


def _refuse(x: str):
    raise ValueError(x)


_JSON = re.compile(r'[ \t\r\n]*(?:(?P<v>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])|true\b|false\b|null\b)|(?P<o>[\[\]{},:])|\Z)')


def _deep_json(text: str) -> int:
    """Where a JSON text breaks, -1 if it doesn't; with a stack of its own, so any depth will do."""
    stack: list[str] = []
    due, at = "value", 0  # value, first (value or ]), key, first key (or }), colon, next (, or a closing bracket), end
    while True:
        m = _JSON.match(text, at)
        if m is None:
            return at
        x = m.group("o") or ("v" if m.group("v") is not None else "")
        if not x:
            return -1 if due == "end" else m.end()
        if x in ("v", "[", "{") and due in ("value", "first"):
            if x == "v":
                due = "next" if stack else "end"
            else:
                stack.append(x)
                due = "first" if x == "[" else "first key"
        elif x == "v" and due in ("key", "first key") and m.group("v")[0] == '"':
            due = "colon"
        elif x == ":" and due == "colon":
            due = "value"
        elif x == "," and due == "next":
            due = "value" if stack[-1] == "[" else "key"
        elif x in ("]", "}") and stack and _PAIR[stack[-1]] == x and due in ("next", "first" if x == "]" else "first key"):
            stack.pop()
            due = "next" if stack else "end"
        else:
            return m.start("o") if m.group("o") else m.start("v")
        at = m.end()


def _json(text: str) -> Verdict:
    try:
        json.loads(text.removeprefix("\ufeff"), parse_constant=_refuse)
        return VALID
    except RecursionError:
        position = _deep_json(text.removeprefix("\ufeff"))
        if position < 0:
            return VALID
    except ValueError as e:
        position = getattr(e, "pos", 0)
    code, _, _ = lexing.scan("javascript", text)
    left = residue(code)
    cost = max(1, dyck_cost("".join(code[i] for i in left)))
    return Verdict(cost, position, _kind(text, position >= len(text.rstrip()) and bool(left), cost, len(code.split())))


_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|\[[^\]]*\]|\{[^}]*\}|[^\s#\-?:,\[\]{}&*!|>'\"%@`][^#]*?|[-?:](?=[^\s])[^#]*?)\s*:(?=\s|$)")
_BLOCK_SCALAR = re.compile(r"(?:^|.*?[:\-?]\s+)(?:[!&][^\s]+\s+)*[|>][-+]?\d?[-+]?\s*(?:#.*)?$")


def _flow(text: str, at: int) -> int:
    """The end of the quoted scalar or flow collection that begins at `at`; -1 if it never ends."""
    c = text[at]
    if c == '"':
        m = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(text, at)
        return m.end() if m else -1
    if c == "'":
        m = re.compile(r"'(?:[^']|'')*'", re.S).match(text, at)
        return m.end() if m else -1
    stack, i = [], at
    while i < len(text):
        c = text[i]
        if c in "\"'" and (text[i - 1] in "[{,: \t\n\r"):
            i = _flow(text, i)
            if i < 0:
                return -1
            continue
        if c == "#" and text[i - 1] in " \t\n\r":
            i = next((m.start() for m in [re.compile(r"[\r\n]").search(text, i)] if m), len(text))
            continue
        if c in "%@`" and text[at:i].rstrip()[-1:] in ("[", "{", ",", ":"):
            return -1  # no scalar begins with these
        if c in "[{":
            stack.append(c)
        elif c in "]}":
            if not stack or _PAIR[stack.pop()] != c:
                return -1
            if not stack:
                return i + 1
        i += 1
    return -1


def _yaml(text: str) -> Verdict:
    """Block structure by a stack of indents: every line opens, continues or closes a level that is there."""
    text = text.removeprefix("\ufeff")
    lines, offset = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text), 0
    levels: list[tuple[int, str]] = []  # indent and kind: 'map', 'seq', 'scalar'
    skip_until, block, pending, errors = 0, None, True, []

    def node(at: int, indent: int, rest: str) -> str:
        """What stands at `at` as a value: '' if nothing, or the kind of the node; notes errors."""
        nonlocal skip_until
        s = rest
        while m := re.match(r"[!&][^\s,\[\]{}]*\s*", s):
            at, s = at + m.end(), s[m.end() :]
        if not s or s[0] == "#":
            return ""
        if s[0] in "\"'[{":
            end = _flow(text, at)
            if end < 0:
                errors.append((at, "open"))
                skip_until = len(text)
                return "flow"
            stop = re.compile(r"[^\r\n]*").match(text, end)
            after = stop.group().strip()
            if after and not after.startswith("#") and not after.startswith(":"):
                errors.append((end, "syntax"))
            skip_until = max(skip_until, stop.end())
            return "key" if after.startswith(":") else "flow"
        if s[0] in "@`%" or s[0] == "*" and not re.match(r"\*[^\s,\[\]{}]+\s*(?::\s|#|$)", s) or s[0] in ",]}":
            errors.append((at, "syntax"))
        return "plain"

    for raw in lines:
        at, offset = offset, offset + len(raw)
        line = raw.rstrip("\r\n")
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if at < skip_until:
            continue
        if block is not None:
            if not body.strip() or indent > block:
                continue
            block = None
        if body.startswith("\t") and body.strip() and not body.strip().startswith("#"):
            errors.append((at, "syntax"))
            continue
        if not body.strip() or body.startswith("#"):
            continue
        if indent == 0 and re.match(r"(?:---|\.\.\.)(?:\s|$)", body):
            levels, pending = [], True
            continue
        if indent == 0 and body.startswith("%") and not levels:
            continue
        had = levels[-1] if levels else None
        while levels and levels[-1][0] > indent:
            levels.pop()
        position, rest = indent, body
        while m := re.match(r"-(?:\s+|$)", rest):
            top = levels[-1] if levels else None
            if top and top[0] == position and top[1] not in ("seq", "map") or top is None and had is not None and not pending:
                errors.append((at, "syntax"))
            if not (top and top == (position, "seq")):
                if top and top[0] == position and top[1] == "map" and not pending:
                    errors.append((at, "syntax"))
                levels.append((position, "seq"))
            position, rest, pending = position + m.end(), rest[m.end() :], True
            while levels and levels[-1][0] > position:
                levels.pop()
        if not rest:
            continue
        where = at + (len(line) - len(rest))
        key = _YAML_KEY.match(rest) or re.match(r"\?\s", rest)
        if key:
            if levels and levels[-1][1] == "seq" and levels[-1][0] == position and not line.lstrip(" ").startswith("- "):
                levels.pop()
            top = levels[-1] if levels else None
            if top != (position, "map"):
                if not pending or had is not None and top is not None and top[0] == position:
                    errors.append((at, "syntax"))
                levels.append((position, "map"))
            value = rest[key.end() :]
            lead = len(value) - len(value.lstrip())
            kind = node(where + key.end() + lead, position, value.strip())
            if _BLOCK_SCALAR.match(value.strip()) and value.strip()[:1] in "|>!&":
                block, pending = position, False
            else:
                pending = not kind
            if kind == "plain" and re.search(r":\s", re.sub(r"\s#.*", "", value.strip())):
                errors.append((where, "syntax"))
            if kind == "plain":
                levels.append((position + 1, "scalar"))
        else:
            if _BLOCK_SCALAR.match(rest) and rest.strip()[:1] in "|>":
                block, pending = max(position - 1, 0), False
                continue
            top = levels[-1] if levels else None
            if pending:
                kind = node(where, position, rest.strip())
                pending = False
                levels.append((position, "scalar"))
                if kind == "key":
                    levels[-1] = (position, "map")
            elif top and top[1] == "scalar" or had and had[1] == "scalar" and indent > 0:
                continue  # a plain scalar goes on
            else:
                errors.append((at, "syntax"))
    if not errors:
        return VALID
    first, what = min(errors)
    return Verdict(len(errors), first, "truncation" if what == "open" and "\n" not in text[first:].rstrip("\r\n").replace("\r", "\n") else _kind(text, False, len(errors), len(lines)))


def verdict(language: str, text: str) -> Verdict:
    """The repair of a text in a language: cost 0 if it is valid."""
    if language == "python":
        return _python(text)
    if language == "json":
        return _json(text)
    if language == "yaml":
        return _yaml(text)
    if not text.strip():
        return VALID
    return _judged(language, text)


#: Up to so many ids (of 16 bytes) are broadcast; more are joined by a shuffle.
SMALL = 100_000


def check(contents: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, repo_name, language, cost, line, kind of every file whose extension has a grammar; cost > 0: invalid.

    The extension (any case) is that of the latest scan in `files`; a file without one there, or with a null one, is judged
    by its path. Null content counts as empty; empty files are valid, but for JSON. A file_id that comes twice counts once, as its worst text.
    """
    ext = F.lower(F.regexp_replace(F.col("extension"), r"^\.", ""))
    known = files.where(F.col("extension").isNotNull()).groupBy("file_id").agg(F.max_by(ext, "scanned_at").alias("known"))
    own = F.coalesce(F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    texts = contents.select("file_id", "repo_name", own.alias("ext"), "content")
    schema = "file_id bigint, repo_name string, ext string, language string, cost int, line int, kind string"
    types = pa.schema([("file_id", pa.int64()), ("repo_name", pa.string()), ("ext", pa.string()), ("language", pa.string()), ("cost", pa.int32()), ("line", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, repos, exts, texts = (b.column(i).to_pylist() for i in range(4))
            names = [LANGUAGES.get(e) for e in exts]
            out = [verdict(n, t or "") if n else VALID for n, t in zip(names, texts)]
            lines = [len(re.findall(r"\r\n|\n|\r", (t or "")[: max(v.position, 0)])) + 1 if v.cost else None for v, t in zip(out, texts)]
            yield pa.RecordBatch.from_pydict({"file_id": ids, "repo_name": repos, "ext": exts, "language": names, "cost": [v.cost for v in out], "line": lines, "kind": [v.kind for v in out]}, schema=types)

    # texts are judged where they are read, by the extension in their path; only where `files` says another are they looked up again
    first = cut(texts.mapInArrow(run, schema).join(known, "file_id", "left"))
    agreed = first.where(F.col("known").isNull() | (F.col("known") == F.col("ext"))).drop("known")
    other = first.where((F.col("known") != F.col("ext")) & F.col("known").isin(*LANGUAGES)).select("file_id", "known").distinct()
    few = other.limit(SMALL + 1).count() <= SMALL
    again = texts.drop("ext").join(F.broadcast(other) if few else other, "file_id").select("file_id", "repo_name", F.col("known").alias("ext"), "content").mapInArrow(run, schema)
    judged = agreed.unionByName(again).where(F.col("language").isNotNull())
    worst = judged.groupBy("file_id").agg(F.max(F.struct("cost", "language", "line", "kind", "repo_name")).alias("v"))
    return worst.select("file_id", *(f"v.{c}" for c in ("repo_name", "language", "cost", "line", "kind")))


def rates(checked: DataFrame) -> DataFrame:
    """repo_name, language, files, invalid, rate: the share of invalid files per repository and language."""
    bad = F.count_if(F.col("cost") > 0)
    return checked.groupBy("repo_name", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate"))
