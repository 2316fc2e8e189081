"""Defaults of chunking, retrieval, packing and screening, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names of choices.
STRATEGIES = ("fixed", "recursive", "structure")
MODES = ("vector", "keyword", "hybrid")
RANK_FUNCTIONS = ("ts_rank", "ts_rank_cd", "bm25")
FILTER_MODES = ("exact", "post", "iterative")
ORDERS = ("rank", "sandwich")
TEMPLATES = ("1", "2")
SCREENS = ("drop", "flag", "off")
MAX_CHUNK_TOKENS = 510


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} is one of {', '.join(allowed)}, not {value!r}")
    return value


@dataclass(frozen=True)
class Settings:
    chunk_strategy: str = "structure"
    chunk_size: int = 256
    chunk_overlap: int = 32
    mode: str = "hybrid"
    rank_function: str = "ts_rank"
    filter_mode: str = "iterative"
    rrf_k: int = 60
    depth: int = 50
    rerank: bool = True
    rerank_n: int = 10
    top_k: int = 10
    context_tokens: int = 3000
    context_order: str = "rank"
    template: str = "2"
    screen: str = "drop"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    list_price_in: float = 0.80
    list_price_out: float = 4.00
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        one_of("chunk_strategy", self.chunk_strategy, STRATEGIES)
        one_of("mode", self.mode, MODES)
        one_of("rank_function", self.rank_function, RANK_FUNCTIONS)
        one_of("filter_mode", self.filter_mode, FILTER_MODES)
        one_of("context_order", self.context_order, ORDERS)
        one_of("template", self.template, TEMPLATES)
        one_of("screen", self.screen, SCREENS)
        check_chunk_bounds(self.chunk_size, self.chunk_overlap)


def check_chunk_bounds(size: int, overlap: int) -> None:
    if not 0 < size <= MAX_CHUNK_TOKENS:
        raise ValueError(f"chunk size is 1 to {MAX_CHUNK_TOKENS}, not {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap ({overlap}) is less than the size ({size}) and not negative")
