"""The redaction kernel: an ordered fold of detector stages over one text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import regex

from .patterns import TOKEN_SPAN, Detector, ported
from .validators import VALIDATORS

#: Entity types of external recognisers by kind.
ENTITY_KINDS = {
    "NAME": ("PERSON", "PER", "NAME"),
    "ADDRESS": ("LOCATION", "LOC", "GPE", "ADDRESS"),
    "HEALTH": ("MEDICAL", "HEALTH", "CONDITION", "DIAGNOSIS", "MEDICAL_LICENSE"),
}
_KIND_OF = {t: k for k, types in ENTITY_KINDS.items() for t in types}


def entity_kind(kind: str) -> str:
    return _KIND_OF.get(kind.upper(), kind.upper())


@dataclass
class Scope:
    """Numbers of the values seen, by kind, and counts of replacements. One per text, or one per
    stream. ``assign`` replaces the numbering, as a dictionary shared by all texts does."""

    numbers: dict[str, dict[str, int]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    assign: Callable[[str, str], str] | None = None

    def token(self, kind: str, value: str) -> str:
        self.counts[kind] = self.counts.get(kind, 0) + 1
        if self.assign:
            return f"[{self.assign(kind, value)}]"
        own = self.numbers.setdefault(kind, {})
        return f"[{kind}_{own.setdefault(value, len(own) + 1)}]"


class Kernel:
    """Compiled detectors. Plain data when pickled; workers compile once."""

    def __init__(self, pack: list[Detector]):
        self.pack = list(pack)
        self._stages = None

    def __getstate__(self):
        return {"pack": self.pack, "_stages": None}

    @property
    def stages(self):
        if self._stages is None:
            self._stages = [(d, regex.compile(ported(d.pattern)), VALIDATORS.get(d.validator)) for d in self.pack]
        return self._stages

    def redact(self, text: str, scope: Scope) -> str:
        """Each stage sees the tokens of those before it; a value that fails its check stays and its
        span is not searched again."""
        for d, pattern, valid in self.stages:

            def replaced(m, d=d, valid=valid):
                value = m[d.group]
                if valid and not valid(value):
                    return m[0]
                return m[0][: len(m[0]) - len(value)] + scope.token(d.kind, value)

            text = pattern.sub(replaced, text)
        return text

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, end, value) of every detector on the untouched text."""
        return [(d.kind, m.start(d.group), m.end(d.group), m[d.group]) for d, p, valid in self.stages for m in p.finditer(text) if not valid or valid(m[d.group])]


_TOKEN_SPAN = regex.compile(ported(TOKEN_SPAN))


def replace_entities(text: str, entities: list[tuple[str, str]], scope: Scope) -> str:
    """Replace (type, text) entities outside tokens, longest first by bytes; of equal texts the first
    type counts."""
    kinds: dict[str, str] = {}
    for kind, value in entities:
        if value:
            kinds.setdefault(value, entity_kind(kind))
    if not kinds:
        return text
    longest = sorted(kinds, key=lambda v: -len(v.encode()))
    pattern = regex.compile("|".join(map(regex.escape, longest)))
    out, at = [], 0
    for span in [*_TOKEN_SPAN.finditer(text), None]:
        end = span.start() if span else len(text)
        out.append(pattern.sub(lambda m: scope.token(kinds[m[0]], m[0]), text[at:end]))
        if span:
            out.append(span[0])
            at = span.end()
    return "".join(out)
