"""Detector grammars and their ports to the regular-expression engines in use.

Patterns are stated in the RE2 dialect: ``\\b``, ``\\d`` and ``\\s`` are ASCII, ``(?i)`` folds Unicode.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# --- Fixed values: kinds, patterns, groups and validators of the detectors, in order --------------

EU_PACK = [
    ("VAT", r"\b(?:ATU\d{8}|BE0\d{9}|BG\d{9,10}|CY\d{8}[A-Z]|CZ\d{8,10}|DE\d{9}|DK\d{8}|EE\d{9}|EL\d{9}|ES[0-9A-Z]\d{7}[0-9A-Z]|FI\d{8}|FR[0-9A-Z]{2}\d{9}|HR\d{11}|HU\d{8}|IE\d{7}[A-Z]{1,2}|IT\d{11}|LT(?:\d{9}|\d{12})|LU\d{8}|LV\d{11}|MT\d{8}|NL\d{9}B\d{2}|PL\d{10}|PT\d{9}|RO\d{2,10}|SE\d{12}|SI\d{8}|SK\d{10})\b", 0, None),
    ("AMKA", r"\b\d{11}\b", 0, "amka"),
    ("TAXID", r"\b\d{9}\b", 0, "afm"),
]

BUILT_IN = [
    ("PRIVATEKEY", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", 0, None),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 0, None),
    ("SECRET", r"""(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|token)\b["']?\s*[:=]\s*["']?([^"'\s,;}{]{3,})""", 1, None),
    ("SECRET", r"(?i)\bbearer\s+([A-Za-z0-9._-]{8,})", 1, None),
    ("APIKEY", r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}\b", 0, None),
    ("APIKEY", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}\b", 0, None),
    ("APIKEY", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}\b", 0, None),
    ("APIKEY", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", 0, None),
    ("APIKEY", r"\bAIza[0-9A-Za-z_-]{35}\b", 0, None),
    ("APIKEY", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", 0, None),
    ("APIKEY", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b", 0, None),
    ("APIKEY", r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}\b", 0, None),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0, None),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{2,4}){2,8}\b", 0, None),
    ("CARD", r"\b\d(?:[ -]?\d){12,18}\b", 0, "card"),
    ("IP", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0, None),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, None),
    ("PHONE", r"\+\d{1,3}[ ]\d{2,4}[ ]\d{5,8}", 0, None),
]

_WORD = r"[A-Z][\p{L}'’-]+"
_FULL = rf"{_WORD}(?:\s+{_WORD})?"
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Dame"
TRIGGERS = "name is|named|patient|client|customer|signed by"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Way|Square|Sq|Court|Ct|Place|Pl"

#: Format of tokens, for decoding and for skipping.
TOKEN = r"\[([A-Z]+)_(\d+)\]"
TOKEN_SPAN = r"\[[A-Z][A-Z_]*_\d+\]"

# --- end of the fixed values -----------------------------------------------------------------------

#: Default given names, written for this library; pass another list for full parity with one.
GIVEN_NAMES = ["Alice", "Anna", "Carlos", "Daniel", "David", "Elena", "Emma", "Eva", "George", "Hans", "Ivan", "James", "Jane", "John", "Julia", "Laura", "Lucas", "Maria", "Marie", "Mark", "Martin", "Michael", "Nikos", "Olga", "Paul", "Peter", "Robert", "Sara", "Sofia", "Thomas"]

#: Boundaries never fold case, or letters beyond ASCII would count as word characters.
_ASCII = "0-9A-Za-z_"
EDGE = rf"(?-i:(?<=[{_ASCII}])(?![{_ASCII}])|(?<![{_ASCII}])(?=[{_ASCII}]))"
#: The same where a word character certainly follows, and where one certainly precedes: one test instead of four.
OPENS, CLOSES = rf"(?-i:(?<![{_ASCII}]))", rf"(?-i:(?![{_ASCII}]))"
_SPACE = r"\t\n\f\r "
#: Letters beyond ASCII that fold to ASCII ones.
_FOLDS = {"s": "\u017f", "k": "\u212a"}


def quoted(term: str) -> str:
    """``term`` as a literal, valid in RE2, Java and Python."""
    return "".join("\\" + c if c in r"\.+*?()|[]{}^$" else c for c in term)


def _boundaries(pattern: str) -> list[str]:
    """What each ``\\b`` of ``pattern`` may be written as, in order: ``OPENS`` or ``CLOSES`` where the
    characters after or before it are all ASCII word characters, else ``EDGE``, or its
    two cases by name where the characters that can follow are known."""
    from re import _constants as c, _parser

    out: list[str] = []
    try:
        # letters beyond ASCII are no word characters here, whichever they are
        tree = _parser.parse(re.sub(r"\\p\{L\}", "\u00e9", pattern), re.ASCII)
    except (re.error, OverflowError):
        return out
    folds = bool(tree.state.flags & re.IGNORECASE)

    def some(ch: int) -> set[str]:
        x = chr(ch)
        return {x, x.lower(), x.upper(), *filter(None, (_FOLDS.get(x.lower()),))} if folds else {x}

    def chars(op, arg) -> set[str] | None:
        if op is c.LITERAL:
            return some(arg)
        if op is c.IN and arg[0][0] is not c.NEGATE:
            found: set[str] = set()
            for kind, x in arg:
                if kind is c.LITERAL:
                    found |= some(x)
                elif kind is c.RANGE and x[1] < 128:
                    found |= {y for z in range(x[0], x[1] + 1) for y in some(z)}
                elif kind is c.CATEGORY and x is c.CATEGORY_DIGIT:
                    found |= set("0123456789")
                else:
                    return None
            return found
        return None

    def edge(items, step) -> tuple[set[str] | None, bool]:
        """Characters that may come first (last, backwards), None for unknown; and whether there may be none."""
        found: set[str] = set()
        for op, arg in list(items)[::step]:
            if op is c.AT:
                continue
            if op in (c.MAX_REPEAT, c.MIN_REPEAT):
                got, empty = edge(arg[2], step)
                empty = empty or arg[0] == 0
            elif op is c.SUBPATTERN:
                if arg[1] or arg[2]:
                    return None, True  # flags of its own
                got, empty = edge(arg[3], step)
            elif op is c.BRANCH:
                each = [edge(x, step) for x in arg[1]]
                got, empty = (None if any(x is None for x, _ in each) else set().union(*(x for x, _ in each))), any(e for _, e in each)
            else:
                got, empty = chars(op, arg), False
            if got is None:
                return None, True
            found |= got
            if not empty:
                return found, False
        return found, True

    word = lambda x, empty: x is not None and not empty and bool(x) and all(y.isascii() and (y.isalnum() or y == "_") for y in x)

    def walk(items) -> None:
        items = list(items)
        for i, (op, arg) in enumerate(items):
            if op is c.AT and arg is c.AT_BOUNDARY:
                after, before = edge(items[i + 1 :], 1), edge(items[:i], -1)
                if word(*after):
                    out.append(OPENS)
                elif word(*before):
                    out.append(CLOSES)
                elif after[0] and not after[1] and len(after[0]) <= 128:
                    of = lambda xs: "(?=[" + "".join("\\" + x if x in "\\]^-[&~" else x for x in sorted(xs)) + "])"
                    inner = {x for x in after[0] if word({x}, False)}
                    rest = after[0] - inner
                    out.append("(?-i:" + "|".join([OPENS + of(inner)] * bool(inner) + [rf"(?<=[{_ASCII}])" + of(rest)] * bool(rest)) + ")")
                else:
                    out.append(EDGE)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                walk(arg[2])
            elif op is c.SUBPATTERN:
                walk(arg[3])
            elif op is c.BRANCH:
                for x in arg[1]:
                    walk(x)

    walk(tree)
    return out


@lru_cache(maxsize=1024)
def ported(pattern: str, java: bool = False, plain: bool = False) -> str:
    """An RE2 pattern for Python's ``regex`` module or for Java: the ASCII meaning of ``\\b``, ``\\d`` and
    ``\\s`` is spelled out, and case folding is Unicode's, as RE2's is. ``plain`` writes every boundary
    in its general form."""
    out, inside, i = [], False, 0
    known = [] if plain else _boundaries(pattern)
    edges = iter(known if len(known) == pattern.count(r"\b") else [])
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            body = {r"\d": "0-9", r"\s": _SPACE}.get(two)
            out.append(next(edges, EDGE) if two == r"\b" and not inside else (body if inside else f"[{body}]") if body else two)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "[" and java:
            c = r"\["  # Java would open a nested class
        out.append(c)
        i += 1
    text = "".join(out)
    return text.replace("(?i)", "(?iu)").replace("(?i:", "(?iu:") if java else text


@dataclass(frozen=True)
class Detector:
    """One stage: where ``group`` is 1, the value is the end of the match."""

    kind: str
    pattern: str
    group: int = 0
    validator: str | None = None


def custom_terms(terms: list[str]) -> list[Detector]:
    """One detector for all terms, in order; blank ones are dropped."""
    words = [quoted(t.strip()) for t in terms if t.strip()]
    return [Detector("NAME", r"(?i)\b(?:" + "|".join(words) + r")\b")] if words else []


def name_pack(given: list[str]) -> list[Detector]:
    return [
        Detector("NAME", r"\b(?:" + "|".join(map(quoted, given)) + r")\b\s+" + _WORD),
        Detector("NAME", rf"\b(?:{TITLES})\.?\s+({_FULL})", 1),
        Detector("NAME", rf"(?:(?i:{TRIGGERS}))\s+({_FULL})", 1),
        Detector("ADDRESS", rf"\b\d{{1,5}}\s+(?:{_WORD}\s+){{1,3}}(?:{STREETS})\b\.?"),
    ]


def detectors(terms: list[str] = (), eu: bool = False, names: bool = False, given: list[str] | None = None) -> list[Detector]:
    """The ordered pack: EU, built-in, custom terms, names. The order is part of the meaning."""
    out = [Detector(*d) for d in EU_PACK] if eu else []
    out += [Detector(*d) for d in BUILT_IN] + custom_terms(list(terms))
    return out + (name_pack(given or GIVEN_NAMES) if names else [])
