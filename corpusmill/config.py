"""Options that say how text becomes training sequences."""

from __future__ import annotations

from dataclasses import dataclass

#: Token types.
PROMPT, COMPLETION, PADDING, SEP = 0, 1, 2, 3
#: Category of tokens without one.
NO_CATEGORY = -1

STYLES = ("full", "greedy", "single")
OVERFLOWS = ("drop", "truncate_left", "truncate_right")
BOUNDARIES = ("jsonl", "prompt_completion_pair")


@dataclass(frozen=True)
class PackingConfig:
    """How articles are put in sequences; written full, or style::overflow."""

    style: str = "full"
    overflow: str | None = None

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"unknown packing style {self.style!r}; one of {STYLES}")
        if self.style == "full" and self.overflow is not None:
            raise ValueError("full packing cuts articles at sequence ends and takes no overflow type")
        if self.style != "full" and self.overflow not in OVERFLOWS:
            raise ValueError(f"{self.style} packing needs an overflow type, one of {OVERFLOWS}")

    @classmethod
    def parse(cls, name: str) -> PackingConfig:
        style, _, overflow = name.partition("::")
        return cls(style, overflow or None)

    @classmethod
    def names(cls) -> list[str]:
        return ["full", *(f"{s}::{o}" for s in STYLES[1:] for o in OVERFLOWS)]

    def __str__(self) -> str:
        return self.style if self.overflow is None else f"{self.style}::{self.overflow}"


def check_boundary(name: str) -> str:
    if name not in BOUNDARIES:
        raise ValueError(f"unknown boundary {name!r}; one of {BOUNDARIES}")
    return name


@dataclass(frozen=True)
class PrepOptions:
    """Everything that turns one dataset into packed sequences."""

    max_seq_length: int = 2048
    packing: PackingConfig = PackingConfig()
    packing_boundary: str = "jsonl"
    attention_boundary: str = "jsonl"
    prompt_keyword: str = "prompt"
    completion_keyword: str = "completion"
    prompt_prefix: str = ""
    prompt_postfix: str = ""
    space_separator: bool = True
    keep_prompt_only_sequences: bool = False
    keep_empty_completions: bool = False
    ignore_format_errors: bool = False

    def __post_init__(self) -> None:
        if self.max_seq_length < 1:
            raise ValueError("max_seq_length must be positive")
        check_boundary(self.packing_boundary)
        check_boundary(self.attention_boundary)
