"""Text-bearing fields of the chat and completion formats, as path tables.

A path's steps are keys; ``[]`` walks a list. Modes: ``text`` replaces a string; ``content`` a string
or the blocks of a list; ``content!`` also sets a missing key to null; ``any`` every string below.
Keys are never touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# --- Fixed values: formats by path, in order of precedence, and their fields ----------------------

PARTS = [("text", "text"), ("functionCall.args", "any"), ("functionResponse.response", "any")]
MESSAGES = [("system", "text"), ("system[].text", "text"), ("messages[].content", "content!")]

FAMILIES: dict[str, dict[str, list[tuple[str, str]]]] = {
    "gemini": {
        "request": [(f"{top}.parts[].{p}", m) for top in ("systemInstruction", "system_instruction", "contents[]") for p, m in PARTS],
        "response": [(f"candidates[].content.parts[].{p}", m) for p, m in PARTS],
    },
    "chat": {"request": [("messages[].content", "content!")], "response": [("choices[].message.content", "content!")]},
    "responses": {
        "request": [("instructions", "text"), ("input", "text"), ("input[].content", "content"), ("input[].text", "text")],
        "response": [("output[].content", "content"), ("output[].text", "text")],
    },
    "batches": {"request": [(f"requests[].params.{p}", m) for p, m in MESSAGES], "response": []},
    "messages": {"request": MESSAGES, "response": [("content", "content")]},
    "complete": {"request": [("prompt", "text")], "response": [("completion", "text")]},
    "other": {"request": [], "response": []},
}

#: Substring of the path that names the format, tested in this order after the Gemini forms.
CONTAINS = [("/chat/completions", "chat"), ("/responses", "responses"), ("/messages/batches", "batches"), ("/messages", "messages"), ("/complete", "complete")]
GEMINI_PREFIX, GEMINI_CALLS = "/v1beta/", (":generateContent", ":streamGenerateContent")

BLOCK = [("text", "text"), ("input", "any"), ("title", "text"), ("context", "text"), ("content", "content")]
#: A block's source by its type.
SOURCE = {"text": ("data", "text"), "content": ("content", "content")}
UNTOUCHED_BLOCKS = ("thinking", "redacted_thinking")

# --- end of the fixed values -----------------------------------------------------------------------


def family(path: str) -> str:
    if path.startswith(GEMINI_PREFIX) or any(c in path for c in GEMINI_CALLS):
        return "gemini"
    return next((name for part, name in CONTAINS if part in path), "other")


def gemini_column(path: Column) -> Column:
    return path.startswith(GEMINI_PREFIX) | path.contains(GEMINI_CALLS[0]) | path.contains(GEMINI_CALLS[1])


def family_column(path: Column) -> Column:
    out = F.when(gemini_column(path), "gemini")
    for part, name in CONTAINS:
        out = out.when(path.contains(part), name)
    return out.otherwise("other")


_MISSING = object()


def _apply(value, mode: str, change: Callable[[str], str]):
    if isinstance(value, str):
        return change(value)
    if mode == "any":
        if isinstance(value, list):
            return [_apply(x, mode, change) for x in value]
        if isinstance(value, dict):
            return {k: _apply(x, mode, change) for k, x in value.items()}
    elif mode.startswith("content") and isinstance(value, list):
        for block in value:
            if isinstance(block, dict) and block.get("type") not in UNTOUCHED_BLOCKS:
                for field, m in BLOCK:
                    rewrite(block, field, m, change)
                source = block.get("source")
                if isinstance(source, dict) and isinstance(source.get("type"), str) and source["type"] in SOURCE:
                    rewrite(source, *SOURCE[source["type"]], change)
    return value


def rewrite(node, path: str, mode: str, change: Callable[[str], str]) -> None:
    """Change, in place, what ``path`` reaches below ``node``; other shapes are left alone."""
    if not isinstance(node, dict):
        return
    step, _, rest = path.partition(".")
    key = step.removesuffix("[]")
    value = node.get(key, _MISSING)
    if rest:
        for child in value if step.endswith("[]") and isinstance(value, list) else [value] if not step.endswith("[]") else []:
            rewrite(child, rest, mode, change)
    elif value is not _MISSING or mode.endswith("!"):
        node[key] = _apply(None if value is _MISSING else value, mode, change)


def rewrite_body(path: str, body, direction: str, change: Callable[[str], str]) -> None:
    for field, mode in FAMILIES[family(path)][direction]:
        rewrite(body, field, mode, change)


def every_string(value, change: Callable[[str], str]):
    return _apply(value, "any", change)
