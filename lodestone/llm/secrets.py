"""Credentials in source text: find them line by line and mask them in place.

A keyword automaton (Aho-Corasick) picks the lines worth reading, issuer formats and named contexts give
candidates, structure and placeholder checks decide, and masks keep length and alphabet so that the code
around them stays as it was.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments of which one stands near every credential (lower case).
KEYWORDS = (
    "pass", "pwd", "pw ", "creds", "secret", "token", "key", "credential", "auth", "bearer", "login", "private", "://", "akia", "asia",
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-",
    "xoxa-", "xoxs-", "xoxr-", "eyj", "aiza", "npm_", "sg.", "hf_", "dop_v1_", "-----begin", "hooks.", "curl", "wget", "redis-cli", "mysql", "mariadb", "psql", "docker",
)

#: issuers' formats. The group `v` is the credential.
ISSUERS = (
    ("aws", r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("github", r"(?<![A-Za-z0-9])(?P<v>gh[pousr]_[A-Za-z0-9]{36,251}|github_pat_[A-Za-z0-9_]{50,})(?![A-Za-z0-9])"),
    ("gitlab", r"(?<![A-Za-z0-9])(?P<v>glpat-[A-Za-z0-9_\-]{20,})"),
    ("stripe", r"(?<![A-Za-z0-9])(?P<v>[sr]k_(?:live|test)_[A-Za-z0-9]{16,})(?![A-Za-z0-9])"),
    ("slack", r"(?<![A-Za-z0-9])(?P<v>xox[abprs]-[0-9]{8,}(?:-[0-9]{8,})*-[A-Za-z0-9]{16,})"),
    ("google", r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_\-]{35})(?![A-Za-z0-9_\-])"),
    ("npm", r"(?<![A-Za-z0-9])(?P<v>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    ("mail", r"(?<![A-Za-z0-9])(?P<v>SG\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{40,})"),
    ("hub", r"(?<![A-Za-z0-9])(?P<v>hf_[A-Za-z0-9]{34,})(?![A-Za-z0-9])"),
    ("cloud", r"(?<![A-Za-z0-9])(?P<v>dop_v1_[a-f0-9]{64})(?![a-f0-9])"),
    ("jwt", r"(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{16,})"),
    ("webhook", r"https://hooks\.[A-Za-z0-9.\-]+/services/(?P<v>[A-Za-z0-9]{6,}/[A-Za-z0-9]{6,}/[A-Za-z0-9]{16,})"),
    ("url", r"[a-z][a-z0-9+.\-]*://[^\s/:@\"'<>{}]*:(?P<v>[^\s/@\"']{3,})@[^\s\"'/@]"),
)
_ISSUER = [(n, re.compile(p)) for n, p in ISSUERS]
#: The keywords of each issuer; its format is tried only where one of them was met.
_OF_ISSUER = {
    "aws": ("akia", "asia"), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "gitlab": ("glpat-",), "stripe": ("sk_live_", "sk_test_", "rk_live_"),
    "slack": ("xoxb-", "xoxp-", "xoxa-", "xoxs-", "xoxr-"), "google": ("aiza",), "npm": ("npm_",), "mail": ("sg.",), "hub": ("hf_",), "cloud": ("dop_v1_",), "jwt": ("eyj",), "webhook": ("hooks.",), "url": ("://",),
}
_COMMANDS = {"curl", "wget", "redis-cli", "mysql", "mariadb", "docker", "pass"}
_BY_KEYWORD = {k: (n, p) for n, p in _ISSUER for k in _OF_ISSUER[n]}
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK = re.compile(_BEGIN.pattern + r"(?P<v>.*?)(?=-----END|[\"'`]|\Z)", re.S)
#: A literal that continues a key block, and what may stand between two of them (with their quotes).
_PIECE = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[nrt])*(?:-----END [A-Z0-9 ]*-----(?:\s|\\[nrt])*)?")
_GOES_ON = re.compile(r"\s*[+.&]?\s*[bfru]{0,2}[\"'`](?:[A-Za-z0-9+/=\s]|\\[nrt]|-----END [A-Z0-9 ]*-----)*[\"'`](?:[^\r\n]*)[\r\n]*")
_BETWEEN = re.compile(r"[\"'`](?:\s|[+.,&\\])*(?:[bfru]{0,2})?[\"'`]")

#: Directories whose files never count.
TEST_DIRS = r"(^|/)(tests?|specs?|mocks?|fixtures?|__tests__|__mocks__)/"

#: Name parts that say a value is a credential, alone or in these pairs.
_ALONE = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "credential", "credentials", "apikey", "bearer", "authorization"}
_BEFORE_KEY = {"api", "access", "secret", "private", "master", "signing", "service", "auth", "encryption", "account", "storage", "shared", "deploy", "ssh", "license"}
#: Name parts after which a name no longer holds the credential itself.
_NOT_VALUE = {"name", "names", "file", "path", "url", "uri", "hint", "policy", "label", "field", "env", "var", "id", "count", "length", "size", "type", "ttl", "expiry", "header", "prefix", "regex", "pattern", "hash", "digest", "ref", "arn", "min", "max", "message", "prompt", "placeholder", "store", "vault", "rule", "reset"}
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|1234\d*|todo|tbd|none|null|nil|true|false|empty|redacted|masked|hidden|removed|unset|undefined|n/?a|secret|password|passwd|token|test|dummy|fake|sample|example|default|change[-_ ]?(?:me|it|this)?|replace[-_ ]?\w*|placeholder|fixme)$"
    r"|^[<\[({].*[>\])}]$|\$\{|\{\{|\{[a-z_][\w.]*\}|%[sd(]|^%\w+%$|^\$|^@|^env[.:]|^vault[:/]|^ssm[:/]|^arn:|^secret[s]?[:/]|^(?:file|ref)[:/]"
    r"|your[-_ ]|my[-_ ]|[-_ ]here$|^(?:insert|enter|set|put|add|use|provide|fill)[-_ ]|change-?me|example|placeholder|dummy|redacted|\*{3,}|x{6,}|•{2,}|^<|>$"
)
#: Commands that take a password on their line.
_COMMAND = re.compile(
    r"\b(?:curl|wget|https?)\b[^\r\n\"'`]*?\s(?:-u|--user|--proxy-user)[ =][^\s:\"'`]+:(?P<a>[^\s\"'`]{4,})|\bsshpass\s+-p\s*(?P<b>[^\s\"'`]{4,})|\bredis-cli\b[^\r\n\"'`]*?\s-a\s+(?P<c>[^\s\"'`]{4,})"
    r"|\b(?:mysql\w*|mariadb\w*)\b[^\r\n\"'`]*?\s-p(?P<d>[^\s\"'`]{4,})|\bdocker\s+login\b[^\r\n\"'`]*?\s(?:-p|--password)[ =](?P<e>[^\s\"'`]{4,})|\s--password[ =](?P<f>[^\s\"'`]{4,})"
)
_INSIDE = re.compile(r"(?i)(?:^|[;&?\s])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|access[_-]?token|client[_-]?secret|auth[_-]?token)=(?P<v>[^\s;&,]{6,})")
_STRING = re.compile(r'"""|\'\'\'|"(?P<d>(?:[^"\\\r\n]|\\.)*)"|\'(?P<s>(?:[^\'\\\r\n]|\\.)*)\'|`(?P<b>(?:[^`\\\r\n]|\\.)*)`')
_JOIN = re.compile(r"\s*(?:[+.&]|\\)?\s*\Z")
_BLANKS = re.compile(r"\s+")
_NAME_BEFORE = re.compile(r"(?:^|[^\w$.-])[\"'`]?([A-Za-z_$][\w$.-]*)[\"'`]?\s*(?::\s*[\w<>\[\]?. ]+)?\s*(?::=|=>|=|:)\s*(?:[bfru@$]{0,2})?\(?\s*\Z")
_ARG_NAME = re.compile(r"[\"'`]([\w.\- ]+)[\"'`]\s*,\s*\Z")
_SCHEME = re.compile(r"(?i)^(?:bearer|token|basic|apikey|api-key)\s+(?P<v>\S{8,})$")
_BARE = re.compile(r"^\s*(?:export\s+|-\s+|set\s+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*[:=]\s*(?P<v>[^\s\"'`#][^\r\n]*?)\s*(?:\s#.*)?$")
#: In a comment a name and, in the same clause, a sign or verb with what it states.
_NOTE_NAME = re.compile(r"(?i)\b(?:password|passwd|pwd|pw|pass|passphrase|secret|token|api[-_ ]?key|credentials?|creds|login|key)\b")
_NOTE_VALUE = re.compile(r"(?:[:=/]|\b(?:is|was|are)(?=\s))\s*[\"'`]?(?P<v>[^\s\"'`,;()]{8,})")
_CLAUSE_END = re.compile(r"[.;,!?](?=\s|$)")
_HEADER = re.compile(r"(?i)\b(?:authorization|x-[\w-]*(?:key|token|auth|secret)[\w-]*|[\w-]*api-?key)\s*:\s*(?:bearer |token |basic )?(?P<v>[^\s\"'`,;()]{8,})")
_EOL = re.compile(r"\r\n|\n|\r")
#: A line can hold or open a credential only with a quote, an assignment, a slash or a statement, or in an issuer's own format.
_COULD = re.compile(r"[\"'`=:/(]|\s(?:is|was|are)\s")
#: What ends a line whose literal goes on in the next, and what begins that one.
_ENDS = re.compile(r"[\"'`]\s*(?:[+.&\\]\s*)?[\r\n]*\Z|\(\s*[\r\n]+\Z")
_STARTS = re.compile(r"\s*(?:[+.&]\s*)?[\"'`]")
_ONE_PIECE = re.compile(r"\s*(?:[+.&]\s*)?(?:\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|`(?:[^`\\\r\n]|\\.)*`)\s*(?:[+.&\\]\s*)?")
_LOGIN_CALL = re.compile(r"(?i)\b(?:login|authenticate|auth|connect|signin|sign_in)\s*\(")
_ENV_CALL = re.compile(r"(?i)(?:getenv|environ\.get|env|process\.env\.\w+|System\.getenv|readEnv|fromEnvironment)\b")
_DEFAULT = re.compile(r"\s*(?:,|\?\?|\|\||\?:|\)\s*(?:\?\?|\|\||\?:|or\b))\s*(?:default\w*\s*[=:]\s*)?")
_MASKED = re.compile(r"(?:[xX02]|[^\w\s])+|(?:[aA0]|[^\w\s])+")


def credential_name(name: str) -> bool:
    """Whether an identifier names the value of a credential (`db_password`, `maxTokens` doesn't)."""
    parts = [p.lower() for p in _CAMEL.findall(name)]
    if not parts or parts[-1] in _NOT_VALUE or parts[0] in ("max", "min", "num", "n", "count", "is", "has"):
        return False
    for i, p in enumerate(parts):
        rest = parts[i + 1 :]
        if p in _ALONE and not (set(rest) & _NOT_VALUE):
            return True
        if p == "key" and i and parts[i - 1] in _BEFORE_KEY and not rest:
            return True
    return False


def secret_like(value: str) -> bool:
    """Whether a value that stands under a credential's name can be a credential: no placeholder, reference or plain words."""
    v = value.strip()
    if len(v) < 6 or any(c.isspace() for c in v) or _PLACEHOLDER.search(v) or _MASKED.fullmatch(v):
        return False
    letters, digits = sum(c.isalpha() for c in v), sum(c.isdigit() for c in v)
    if not letters and digits < 10:
        return False
    other = len(v) - letters - digits
    mixed = v.lower() != v and v.upper() != v
    if not digits and not (mixed and (other or len(v) >= 12)) and not re.search(r"[#$!%^&*?~+]", v):
        return False  # words only
    return not re.fullmatch(r"[\w.\-]+\([\w.,\" ]*\)", v) and not re.match(r"^(?:/|\./|\.\./|[A-Za-z]:\\)[\w./\\-]*\.\w{1,5}$", v)


def _issuer_ok(kind: str, value: str) -> bool:
    if _PLACEHOLDER.search(value) and kind != "jwt":
        return False
    if kind == "jwt":
        try:
            head = value.split(".")[0]
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, binascii.Error):
            return False
    if kind == "url":
        return bool(value) and value.lower() not in ("password", "pass", "secret", "pwd")
    body = re.sub(r"^[A-Za-z]+[_\-]", "", value)
    return len(set(body)) >= 6


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, k)
    a.make_automaton()
    return a


def find(content: str, automaton=None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the credentials in a text, in order and without overlap.

    A value put together from several strings gives one span per string, all but the first of kind `part`.
    """
    if not content:
        return []
    automaton = automaton or _automaton()
    low = content.lower()
    if len(low) != len(content):  # a few letters change length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in content)
    hits = list(automaton.iter(low))
    if not hits:
        return []
    breaks = [0] + [m.end() for m in _EOL.finditer(content)] + [len(content) + 1]
    spans: list[tuple[int, int, str]] = []
    for m in _BLOCK.finditer(content):
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", m.group("v"))) >= 32 or m.group("v").count("\n") > 1:
            spans.append((m.start(), m.end(), "private key"))
    wanted: dict[int, set[str]] = {}
    for e, k in hits:
        wanted.setdefault(bisect.bisect_right(breaks, e) - 1, set()).add(k)
    last = len(breaks) - 1
    known: dict[int, bool] = {}

    def goes_on(k: int) -> bool:
        """Whether the literal at the end of line k is continued at the begin of the next."""
        if k not in known:
            known[k] = k + 1 < last and bool(_STARTS.match(content, breaks[k + 1], breaks[k + 2])) and bool(_ENDS.search(content[breaks[k] : breaks[k + 1]]))
        return known[k]

    for i, words in sorted(wanted.items()):
        start, end = breaks[i], breaks[i + 1]
        if not (_COULD.search(content, start, end) or any(k in _BY_KEYWORD for k in words)):
            continue
        j = i + 1  # a value may go on in the next lines, a key block in a list too
        if "-----begin" in words and not ("-----END" in content[start:end]):
            while j < last and _GOES_ON.fullmatch(content, breaks[j], breaks[j + 1]):
                j += 1
        if not (i and goes_on(i - 1) and _ONE_PIECE.fullmatch(content[start:end])):  # else it's a part of what began before
            while j < last and goes_on(j - 1):
                j += 1
        spans += _in_lines(content, start, breaks[j] if j > i + 1 else end, end, words)
    spans.sort()
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _joined_keys(text: str, groups: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """The literals of each private key that is put together from several: joined, or in a list from its BEGIN line on."""
    out = []
    parts = [p for g in groups for p in g]
    for i, (_, _, value) in enumerate(parts):
        if not (m := _BEGIN.search(value)):
            continue
        own, ended = [parts[i]], "-----END" in value[m.end() :]
        for p in parts[i + 1 :]:
            if ended or _BEGIN.search(p[2]) or not _PIECE.fullmatch(p[2]) or not _BETWEEN.fullmatch(text[own[-1][1] : p[0]]):
                break
            own.append(p)
            ended = "-----END" in p[2]
        body = "".join(x for _, _, x in own)[m.end() :].split("-----END")[0]
        if len(own) > 1 and len(re.sub(r"\\.|[^A-Za-z0-9+/=]", "", body)) >= 32:
            out.append(own)
    return out


def _notes(line: str, begin: int) -> list[re.Match]:
    """Values that a comment states: after a sign or verb, with a credential's name before it in the same clause."""
    names = [m.end() for m in _NOTE_NAME.finditer(line, begin)]
    if not names:
        return []
    ends = [m.end() for m in _CLAUSE_END.finditer(line, begin)]
    out, after = [], begin
    for m in _NOTE_VALUE.finditer(line, names[0]):
        k = bisect.bisect_left(ends, m.start()) - 1
        i = bisect.bisect_right(names, m.start()) - 1
        if i >= 0 and names[i] > max(after, ends[k] if k >= 0 else begin):
            out.append(m)
            after = m.end()
    return out


def _in_lines(content: str, start: int, stop: int, first_end: int, words: set[str]) -> list[tuple[int, int, str]]:
    """Credentials that begin on the line content[start:first_end]; its literals may go on up to stop."""
    line = content[start:first_end].rstrip("\r\n")
    out = []
    for kind, pattern in {_BY_KEYWORD[k] for k in words if k in _BY_KEYWORD}:
        for m in pattern.finditer(line):
            if _issuer_ok(kind, m.group("v")):
                out.append((start + m.start("v"), start + m.end("v"), kind))
    for m in _COMMAND.finditer(line) if words & _COMMANDS else ():
        a, b = m.span(m.lastgroup)
        if secret_like(line[a:b]):
            out.append((start + a, start + b, "command"))
    text = content[start:stop].rstrip("\r\n")
    groups: list[list[tuple[int, int, str]]] = []
    opened: list[tuple[int, int]] = []  # begin and end of each literal, quotes included
    at_literal: dict[int, int] = {}
    joins = False
    for m in _STRING.finditer(text):
        opened.append(m.span())
        if m.lastgroup is None:
            joins = False
            continue
        at, to, value = m.start(m.lastgroup), m.end(m.lastgroup), m.group(m.lastgroup)
        at_literal[at] = len(opened) - 1
        gap = text[opened[-2][1] : m.start()] if joins else None
        if gap is not None and _JOIN.match(gap) and (gap.strip() or "\n" in gap or "\r" in gap):
            groups[-1].append((at, to, value))
        else:
            groups.append([(at, to, value)])
        joins = True
    keys = _joined_keys(text, groups)
    taken = {a for g in keys for a, _, _ in g}
    groups = [g for g in groups if not any(a in taken for a, _, _ in g)]
    for g in keys:
        out.append((start + g[0][0], start + g[0][1], "joined key"))
        out += [(start + a, start + b, "part") for a, b, _ in g[1:]]
    logins = {m.end() - 1 for m in _LOGIN_CALL.finditer(text)}
    env_calls = [m.end() for m in _ENV_CALL.finditer(text)] if "env" in text.lower() else []
    bracket = seen = 0
    for g in groups:
        at = g[0][0]
        value = "".join(v for _, _, v in g)
        if at - 1 >= len(line):  # begins on a later line: only what follows an open bracket belongs here
            if not re.search(r"[=(:]\s*\Z", line):
                continue
        n = at_literal[at]
        bracket, seen = max(text.rfind("(", seen, at), text.rfind(")", seen, at), bracket), at  # the last one before the literal
        before = _BLANKS.sub(" ", text[opened[n - 2][1] if n > 1 else 0 : at - 1])  # from the literal before the last one on
        gap = text[opened[n - 1][1] : at - 1] if n else ""
        kind = ""
        if len(g) > 1:
            kind = next((k for k, p in _ISSUER if (m := p.search(value)) and _issuer_ok(k, m.group("v"))), "")
        if not kind and (m := _SCHEME.match(value)) and secret_like(m.group("v")) and len(m.group("v")) >= 12:
            off = m.start("v")
            if len(g) == 1:
                out.append((start + at + off, start + g[0][1], "scheme"))
                continue
            kind = "scheme"
        if not kind and secret_like(value):
            name = ""
            if m := _NAME_BEFORE.search(before):
                name = m.group(1)
            elif m := _ARG_NAME.search(before):
                name = m.group(1)
            if name and credential_name(name):
                kind = "named"
            elif n and bracket in logins and _BLANKS.sub("", gap) == ",":
                kind = "login"
            elif env_calls and n and _DEFAULT.fullmatch(gap) and (m := re.fullmatch(r"[\"'`]([\w.\-]+)[\"'`]", text[slice(*opened[n - 1])])) and credential_name(m.group(1)):
                k = bisect.bisect_right(env_calls, opened[n - 1][0]) - 1
                if k >= 0 and not _EOL.search(text, env_calls[k], opened[n - 1][0]):
                    kind = "default"
        if not kind:
            for a, _, v in g:
                out += [(start + a + m.start("v"), start + a + m.end("v"), "inside") for m in _INSIDE.finditer(v) if secret_like(m.group("v"))]
        if kind:
            out.append((start + g[0][0], start + g[0][1], kind))
            out += [(start + a, start + b, "part") for a, b, _ in g[1:]]
    more = []
    if m := _BARE.match(line):
        value = m.group("v").rstrip(",;")
        if credential_name(m.group(1)) and secret_like(value) and not re.search(r"[()\[\]{}]|^[a-zA-Z_][\w]*(?:\.[a-zA-Z_]\w*)+$", value) and re.search(r"\d", value) and not re.match(r"^-?[\d.]+\w?$", value):
            if re.match(r"^\s*(?:export\s+)?[A-Za-z_\"'][\w.\"'-]*\s*[:=]\s*\S+$", line) and not re.search(r"^\w+\[|\w\s*[*+/-]\s*\w", line.split("=", 1)[-1] if " = " in line else ""):
                if not re.match(r"^[A-Za-z_]\w*$", value) or re.match(r"^\s*(?:export\s+)?[A-Z][A-Z0-9_]*=", line) or ":" in line and not line.rstrip().endswith((";", "{", ",")):
                    more.append((start + m.start("v"), start + m.start("v") + len(value), "bare"))
    if comment := re.search(r"(?:#|//|/\*|\*|--|;)\s", line):
        found = list(_HEADER.finditer(line, comment.end())) + _notes(line, comment.end())
        for m in found:
            if secret_like(m.group("v")) and re.search(r"\d|[#$!%^&*?~+](?=\w)", m.group("v")):
                more.append((start + m.start("v"), start + m.end("v"), "comment"))
    for x in more:  # what is known more closely stays as it is
        if all(x[1] <= a or b <= x[0] for a, b, _ in out):
            out.append(x)
    return out


def masked(value: str) -> str:
    """A placeholder of the same length and alphabet: letters become x or X (a or A in hexadecimal values), digits 0 (2 in base 32), all else stays."""
    letters = {c for c in value if c.isalpha()}
    digits = {c for c in value if c.isdigit()}
    small, large = ("a", "A") if letters and digits and (letters <= set("abcdef") or letters <= set("ABCDEF")) else ("x", "X")
    digit = "2" if letters and digits and digits <= set("234567") and all("A" <= c <= "Z" for c in letters) else "0"
    return "".join(digit if c.isdigit() else large if c.isupper() else small if c.isalpha() else c for c in value)


def mask(content: str, spans: list[tuple[int, int, str]]) -> str:
    """`content` with every span masked in place; nothing else moves. Markers of key blocks stay."""
    out, at = [], 0
    for start, end, kind in spans:
        part = content[start:end]
        if kind in ("private key", "joined key"):
            head = _BEGIN.search(part).end()
            part = part[:head] + re.sub(r"\\.|[A-Za-z0-9]", lambda m: m.group(0) if m.group(0)[0] == "\\" else masked(m.group(0)), part[head:])
        else:
            part = masked(part)
        out += [content[at:start], part]
        at = end
    return "".join(out) + content[at:]


def detect(chunks: DataFrame, path: str = "file_path", with_masked: bool = False) -> DataFrame:
    """One row per credential: chunk_id, line_no (file line), kind, and with_masked the chunk's masked content.

    A null content or an empty one has none; a null start_line counts as 1; a null path counts as no test
    directory. Re-delivered rows (same chunk_id) count once. Extra columns are ignored.
    """
    schema = "chunk_id string, line_no int, kind string, position int" + (", masked string" if with_masked else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            rows: dict[str, list] = {"chunk_id": [], "line_no": [], "kind": [], "position": []} | ({"masked": []} if with_masked else {})
            for cid, first, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                spans = find(text, automaton)
                clean = mask(text, spans) if with_masked and spans else None
                for start, _, kind in spans:
                    if kind == "part":
                        continue
                    rows["chunk_id"].append(cid)
                    rows["line_no"].append((1 if first is None else first) + len(_EOL.findall(text, 0, start)))
                    rows["kind"].append(kind)
                    rows["position"].append(start)
                    if with_masked:
                        rows["masked"].append(clean)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, {"line_no": pa.int32(), "position": pa.int32()}.get(k, pa.string())) for k in rows]))

    wanted = chunks.where(F.col("content").isNotNull() & ~F.coalesce(F.lower(F.col(path)).rlike(TEST_DIRS), F.lit(False)))
    found = wanted.select("chunk_id", "start_line", "content").mapInArrow(run, schema)
    return found.dropDuplicates(["chunk_id", "position"])


def redact(chunks: DataFrame, path: str = "file_path") -> DataFrame:
    """All rows and columns of `chunks` with credentials in content masked; rows without any are unchanged."""
    content = chunks.schema.names.index("content")
    where = chunks.schema.names.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, skip = _automaton(), re.compile(TEST_DIRS)
        for b in batches:
            texts, paths = b.column(content).to_pylist(), b.column(where).to_pylist()
            new = [t if t is None or (p and skip.search(p.lower())) else mask(t, find(t, automaton)) for t, p in zip(texts, paths)]
            yield b.set_column(content, b.schema.field(content), pa.array(new, b.schema.field(content).type))

    return chunks.mapInArrow(run, chunks.schema)
