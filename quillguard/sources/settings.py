"""Settings from defaults, a flat YAML file and the environment, in rising precedence."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

TRUE = {"true", "1", "yes", "on"}
PREFIX = "QUILLGUARD_"


@dataclass
class Settings:
    custom_terms: list[str] = field(default_factory=list)
    eu_pack: bool = False
    name_pack: bool = False
    openai_url: str = "https://api.openai.com"
    anthropic_url: str = "https://api.anthropic.com"
    google_url: str = ""
    override_url: str = ""
    autodetect: bool = True
    auto_reveal: bool = False
    vault_key: str = ""
    vault_keyfile: str = ""
    per_request_numbering: bool = False


def flat_yaml(text: str) -> dict[str, str | list[str]]:
    """Scalars and one-level lists; comments, blank lines and quotes are understood, nothing else is."""
    out: dict[str, str | list[str]] = {}
    key = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        if line.lstrip().startswith("- "):
            if key is None:
                raise ValueError(f"line {n}: a list item without a key")
            out[key] = [*(out[key] or []), line.lstrip()[2:].strip().strip("'\"")]
            continue
        name, colon, value = line.partition(":")
        if not colon or line[0].isspace():
            raise ValueError(f"line {n}: expected `key: value`")
        key = name.strip()
        out[key] = value.strip().strip("'\"")
    return out


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Environment before file before default; an unknown key in the file is an error."""
    out, kinds = Settings(), {f.name: f.type for f in fields(Settings)}

    def put(name: str, value) -> None:
        if kinds[name] == "bool":
            value = str(value).strip().lower() in TRUE
        elif kinds[name].startswith("list"):
            value = value if isinstance(value, list) else [x.strip() for x in str(value).split(",") if x.strip()]
        setattr(out, name, value)

    for name, value in flat_yaml(Path(path).read_text()).items() if path else ():
        if name not in kinds:
            raise ValueError(f"unknown setting {name}")
        put(name, value)
    env = os.environ if env is None else env
    for name in kinds:
        if PREFIX + name.upper() in env:
            put(name, env[PREFIX + name.upper()])
    return out
