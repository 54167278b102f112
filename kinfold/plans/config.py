"""Configuration: YAML with ${a.b} references, the resolve loop's settings and their bounds."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

_REFERENCE = re.compile(r"\$\{([^}]+)\}")


class Settings:
    """A YAML document read by dotted path; ${a.b} stands for another value, whole or within text."""

    def __init__(self, data: Mapping[str, Any]):
        self.data = dict(data)

    @classmethod
    def read(cls, path: str) -> Settings:
        return cls(yaml.safe_load(Path(path).read_text()) or {})

    def _raw(self, path: str) -> Any:
        at: Any = self.data
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                raise KeyError(path)
            at = at[part]
        return at

    def get(self, path: str, default: Any = None, **names: Any) -> Any:
        """The value at the path with references filled in, and {name} fields from `names`."""
        try:
            value = self._filled(self._raw(path), (path,))
        except KeyError:
            return default
        return value.format(**names) if names and isinstance(value, str) else value

    def _filled(self, value: Any, seen: tuple[str, ...]) -> Any:
        if isinstance(value, Mapping):
            return {k: self._filled(v, seen) for k, v in value.items()}
        if isinstance(value, list):
            return [self._filled(v, seen) for v in value]
        if not isinstance(value, str):
            return value

        def one(ref: str) -> Any:
            if ref in seen:
                raise ValueError(f"reference to itself: {' -> '.join([*seen, ref])}")
            return self._filled(self._raw(ref), (*seen, ref))

        whole = _REFERENCE.fullmatch(value)
        return one(whole[1]) if whole else _REFERENCE.sub(lambda m: str(one(m[1])), value)


@dataclass(frozen=True)
class ResolveConfig:
    """What a resolve run needs. max_iterations 0 stops by itself, after at most 20 rounds."""

    name_field: str | None = None
    text_fields: list[str] | None = None
    entity_type: str = "entity"
    id_field: str | None = None
    blocking_method: str = "name"
    blocking_fields: list[str] = field(default_factory=list)
    target_block_size: int = 30
    max_block_size: int = 100
    max_iterations: int = 5
    convergence_threshold: float = 0.01
    match_threshold: float = 0.85
    limit_blocks: int | None = None

    @classmethod
    def of(cls, raw: Mapping[str, Any]) -> ResolveConfig:
        """From a mapping with an optional nested `blocking`; bounds are applied, other keys ignored."""
        safe = bounded(raw)
        inner = safe.get("blocking") or {}
        flat = dict(safe) | {k: inner[k] for k in ("target_block_size", "max_block_size") if k in inner}
        if "method" in inner:
            flat["blocking_method"] = inner["method"]
        if "fields" in inner:
            flat["blocking_fields"] = inner["fields"]
        return cls(**{f.name: flat[f.name] for f in fields(cls) if f.name in flat})

    @classmethod
    def read(cls, path: str) -> ResolveConfig:
        return cls.of(yaml.safe_load(Path(path).read_text()) or {})


def bounded(raw: Any) -> dict[str, Any]:
    """A configuration from elsewhere within safe bounds: 10 rounds, blocks of 500 with a target of
    200, a threshold of 0.001 to 0.5 (else 0.01). Anything but a mapping becomes the default one."""
    if not isinstance(raw, Mapping):
        return {"name_field": "name", "text_fields": [], "entity_type": "entity"}
    out = dict(raw)
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    most = {"max_iterations": 10, "max_block_size": 500, "target_block_size": 200}
    inner = dict(out["blocking"]) if isinstance(out.get("blocking"), Mapping) else {}
    for name, top in most.items():
        for at in (out, inner):
            if name in at:
                at[name] = min(at[name], top) if number(at[name]) else top
    out["blocking"] = inner
    t = out.get("convergence_threshold", 0.01)
    out["convergence_threshold"] = t if number(t) and 0.001 <= t <= 0.5 else 0.01
    return out


def without_fence(text: str) -> str:
    """Generated YAML without the code fence around it."""
    return re.sub(r"^\s*```\w*\n|\n?```\s*$", "", text)
