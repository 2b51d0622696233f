"""Parameters of a question, with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Least, default and greatest of each parameter.
BOUNDS = {
    "top_k": (1, 4, 20), "vector_top_k": (1, 20, 200), "bm25_top_k": (1, 20, 200), "rerank_candidates": (1, 20, 200), "rrf_k": (1, 60, 200),
    "rerank_threshold": (0.0, 0.25, 1.0), "max_context_chars": (500, 8000, 30000), "content_preview_chars": (0, 300, 3000),
}


@dataclass(frozen=True)
class Request:
    """A checked request; raises ValueError for an empty question or a value out of bounds."""

    question: str
    stock_code: str | None = None
    year: str | None = None
    years: tuple[str, ...] = ()
    include_content: bool = False
    numbers: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.question:
            raise ValueError("the question is empty")
        for name, value in self.numbers.items():
            low, _, high = BOUNDS[name]
            if not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}")

    def get(self, name: str):
        return self.numbers.get(name, BOUNDS[name][1])
