"""Settings from YAML: what is required must be there, prices come in pairs."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Settings:
    model: str
    base_url: str
    prompt: str
    language: str = "auto"
    temperature: float | None = None
    input_token_price: float | None = None
    output_token_price: float | None = None
    currency: str = ""
    significance: bool = False
    words_before: int = 0
    words_after: int = 0
    sample_words: int = 300
    formats: tuple[str, ...] = ("pdf",)
    share_descriptions: bool = True
    cache: dict[str, Any] = field(default_factory=dict)

    def shaping(self) -> tuple[str, ...]:
        """Every setting that can change an answer, as strings: part of each cache key."""
        return tuple(str(x) for x in (self.model, self.base_url, self.prompt, self.language, self.temperature, self.significance, self.words_before, self.words_after, self.sample_words))


def _required(tree: dict, dotted: str) -> Any:
    at: Any = tree
    for part in dotted.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    if at is None or isinstance(at, str) and not at.strip():
        raise ValueError(f"{dotted} is missing")
    return at


def load(path: str | Path) -> Settings:
    import yaml

    tree = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    api = tree.get("api") or {}
    prices = api.get("input_token_price"), api.get("output_token_price")
    if (prices[0] is None) != (prices[1] is None):
        raise ValueError("api.input_token_price and api.output_token_price go together")
    context = tree.get("context") or {}
    return Settings(
        model=_required(tree, "api.model"),
        base_url=_required(tree, "api.base_url"),
        prompt=_required(tree, "prompts.image"),
        language=(tree.get("language") or {}).get("output", "auto"),
        temperature=api.get("temperature"),
        input_token_price=prices[0],
        output_token_price=prices[1],
        currency=(api.get("currency") or "").strip(),
        significance=bool((tree.get("significance") or {}).get("enabled", False)),
        words_before=int(context.get("words_before", 0)),
        words_after=int(context.get("words_after", 0)),
        sample_words=int((tree.get("summary") or {}).get("sample_words", 300)),
        formats=tuple((tree.get("input") or {}).get("formats", ["pdf"])),
        share_descriptions=bool((tree.get("cache") or {}).get("share_descriptions", True)),
        cache=tree.get("cache") or {},
    )
