"""Value functions: how relevance, importance, recency and return make one score.

A component is a callable written with ordinary arithmetic (``lambda age: -0.01 * age``). The same
callable is applied to NumPy blocks inside similarity tasks and to Columns where candidates already
are rows. A component left out contributes nothing. Credibility is computed by the data model but
never enters the sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

Component = Callable[[Any], Any]


def _same(x: Any) -> Any:
    return x


@dataclass(frozen=True)
class ValueFunction:
    k: int = 10
    threshold: float = 0.0
    relevance: Component | None = _same
    importance: Component | None = None
    recency: Component | None = None
    ret: Component | None = None

    def score(self, relevance: Any, importance: Any = 0.0, recency: Any = 0.0, ret: Any = 0.0) -> Any:
        """Sum of the components that are set."""
        parts = [
            fn(arg)
            for fn, arg in (
                (self.importance, importance),
                (self.relevance, relevance),
                (self.recency, recency),
                (self.ret, ret),
            )
            if fn is not None
        ]
        if not parts:
            return relevance * 0.0
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    def with_limits(self, k: int | None = None, threshold: float | None = None) -> "ValueFunction":
        return replace(
            self,
            k=self.k if k is None else k,
            threshold=self.threshold if threshold is None else threshold,
        )


# K and threshold of the nine stock scoring rules, all relevance-only.
TAG_EQUAL = ValueFunction(k=1, threshold=0.9)
TAG_RELEVANT = ValueFunction(k=1, threshold=0.8)
TAG_RELEVANT_QA = ValueFunction(k=1, threshold=0.5)
SEMANTIC_EQUAL = ValueFunction(k=1, threshold=0.9)
SEMANTIC_RELEVANT = ValueFunction(k=10, threshold=0.0)
SEMANTIC_RELEVANT_FOR_EPISODIC = ValueFunction(k=30, threshold=0.0)
SUBGOAL_EQUAL = ValueFunction(k=1, threshold=0.8)
SUBGOAL_RELEVANT = ValueFunction(k=1, threshold=0.1)
PROCEDURAL_EQUAL = ValueFunction(k=1, threshold=0.8)
PROCEDURAL_RELEVANT = ValueFunction(k=1, threshold=0.1)
