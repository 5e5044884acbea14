"""Canonical JSON: sorted keys, numbers as doubles, HTML-sensitive characters escaped.

Bodies are hashed in this form, so it has to agree byte for byte between writers.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

#: Escapes of strings.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}
_SPECIAL = re.compile("[\x00-\x1f\"\\\\<>&\u2028\u2029\ud800-\udfff]")


def _string(text: str) -> str:
    return '"' + _SPECIAL.sub(lambda m: ESCAPES.get(m[0]) or ("\ufffd" if m[0] >= "\ud800" else f"\\u{ord(m[0]):04x}"), text) + '"'


def number(x: float) -> str:
    """Shortest digits; exponents below 1e-6 and from 1e21 on."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-6 <= abs(x) < 1e21:
        out = format(Decimal(repr(x)), "f")
        return out.rstrip("0").rstrip(".") if "." in out else out
    digits, _, exponent = f"{Decimal(repr(x)).normalize():e}".partition("e")
    return f"{digits}e{exponent[0]}{exponent[1:].lstrip('0') or '0'}"


def dumps(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, (int, float)):
        return number(float(value))
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return "{" + ",".join(f"{_string(k)}:{dumps(value[k])}" for k in sorted(value)) + "}"


def _double(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise ValueError("number out of range")
    return x


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


def loads(text: str):
    """Parse as the canonical form reads it; raises ValueError."""
    return json.loads(text, parse_int=_double, parse_float=_double, parse_constant=_no_constant)
