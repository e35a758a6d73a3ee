"""Cost estimates of a run, before it starts."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Price:
    """Dollars per million tokens."""

    tokens_in: float
    tokens_out: float

    def of(self, calls: float, tokens_in: float, tokens_out: float) -> float:
        return calls * (tokens_in * self.tokens_in + tokens_out * self.tokens_out) / 1e6


@dataclass(frozen=True)
class SearchPlan:
    """What a search will ask for, in the terms of its configuration."""

    train_prompts: tuple[int, ...]  # of each topic
    steps: int
    fixed_images: int  # prompts x images of the fixed baselines
    initial_pool: int
    attrs_per_call: int = 5
    prompts_per_call: int = 1  # of a planner; with one, each prompt is asked `calls_per_prompt` times
    calls_per_prompt: int = 1
    most_prompts: int | None = None
    context_images: int = 8
    proposals: int = 10
    proposer_calls: int = 1
    proposer_images: int = 8


#: Tokens that a call takes beside its images, and gives.
PLANNER_TEXT, PLANNER_OUT = 1000, 15_000
DETECTOR_TEXT, DETECTOR_OUT = 200, 40
CLUSTER_ATTR, CLUSTER_OUT = 60, 1000
FILTER_TEXT, FILTER_OUT = 80, 2
PROPOSER_TEXT, PROPOSAL_OUT = 600, 15
BATCH_DISCOUNT = 0.5


def search_cost(plan: SearchPlan, planner: Price, detector: Price, proposer: Price, filters: Price, clusterer: Price, planner_image: int = 255, detector_image: int = 255, proposer_image: int = 255, local_detector: bool = False, batched: bool = False) -> dict[str, float]:
    """Dollars by component over all topics, and their sum. A detector of one's own costs nothing; a batched one half."""
    detect = 0.0 if local_detector else detector.of(1, DETECTOR_TEXT + detector_image, DETECTOR_OUT) * (BATCH_DISCOUNT if batched else 1.0)
    propose = proposer.of(1, PROPOSER_TEXT + plan.proposer_images * proposer_image, plan.proposals * PROPOSAL_OUT)
    out = dict.fromkeys(("planner", "cluster", "humanness", "detection", "proposer", "validation"), 0.0)
    for n in plan.train_prompts:
        n = n if plan.most_prompts is None else min(n, plan.most_prompts)
        together = plan.prompts_per_call > 1
        calls = math.ceil(n / plan.prompts_per_call) if together else n * plan.calls_per_prompt
        out["planner"] += planner.of(calls, PLANNER_TEXT + (plan.prompts_per_call if together else 1) * plan.context_images * planner_image, PLANNER_OUT)
        raw = calls * plan.attrs_per_call
        out["cluster"] += clusterer.of(1, raw * CLUSTER_ATTR, CLUSTER_OUT)
        for step in range(plan.steps):
            new = plan.proposals if step else min(raw, 2 * plan.initial_pool)
            out["humanness"] += filters.of(new, FILTER_TEXT, FILTER_OUT)
            out["detection"] += new * plan.fixed_images * detect
            if step < plan.steps - 1:
                out["proposer"] += propose * plan.proposer_calls
                out["validation"] += plan.proposals * plan.proposer_calls * plan.fixed_images * detect
    return out | {"total": sum(out.values())}


def curve_cost(prompts: int, images: int, attrs: int, cached: int, detector: Price, image_tokens: int = 255, text_tokens: int = 300) -> float:
    return detector.of(max(0, prompts * images * attrs - cached), image_tokens + text_tokens, 60)


def embed_cost(characters: int, per_million: float) -> float:
    return characters / 4 * per_million / 1e6
