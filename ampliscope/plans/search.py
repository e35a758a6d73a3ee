"""The discovery loop: evaluate a pool, keep what is amplified, explain rewards, propose, admit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import amplify, choose, regress
from ..sources.banks import Bank


@dataclass(frozen=True)
class SearchConfig:
    steps: int = 3
    n: int = 2
    tau: float = 0.0
    tau_partial: float = 0.0
    p1_min: float = 0.0
    p1_max: float = 1.0
    pool_sizes: tuple[int, ...] = (8, 8, 8)
    admit: int = 2
    extremes: int = 4

    def __post_init__(self):
        if self.n < 2:
            raise ValueError("n must be at least 2")
        if len(self.pool_sizes) != self.steps:
            raise ValueError("pool_sizes needs a size for each step")
        if not 0 <= self.p1_min <= self.p1_max <= 1:
            raise ValueError("0 <= p1_min <= p1_max <= 1 does not hold")


@dataclass
class SearchState:
    """What a run knows after some steps; a run goes on from it."""

    pool: tuple[str, ...]
    rejected: tuple[str, ...] = ()
    step: int = 0
    rows: list[tuple[int, str, float, float, bool]] = field(default_factory=list)  # step, attr, a_hat, p1, kept
    explained: list[tuple[int, float]] = field(default_factory=list)


Proposer = Callable[[DataFrame, tuple[str, ...], tuple[str, ...], int], list[str]]


def labelled_first(bank: Bank) -> Proposer:
    """A stand-in proposer: the bank's attributes not yet seen, by how much oftener the strongest residuals have them."""

    def propose(sides: DataFrame, pool: tuple[str, ...], rejected: tuple[str, ...], most: int) -> list[str]:
        left = [a for a in bank.attrs if a not in pool and a not in rejected]
        if not left:
            return []
        g = sides.join(bank.images.select("prompt", "image_id", "g"), ["prompt", "image_id"])
        sign = F.when(F.col("side") == "plus", 1).otherwise(-1)
        row = g.agg(*(F.avg(sign * (bank.label(a) == 1).cast("int")).alias(f"c{i}") for i, a in enumerate(left))).first()
        return [a for _, a in sorted(((-(row[f"c{i}"] or 0.0), a) for i, a in enumerate(left)))][:most]

    return propose


def step(bank: Bank, state: SearchState, cfg: SearchConfig, propose: Proposer) -> SearchState:
    """One evaluation and, but for the last step, one expansion. Driver-side values are per attribute only."""
    attrs = [a for a in state.pool if a in bank.attrs]
    found = amplify.amplification(amplify.scored(bank, cfg.n).where(F.col("attr").isin(attrs)), cfg.n).collect()
    scores = {r["attr"]: (r["a_hat"], r["p1"]) for r in found}
    good = [a for a in attrs if a in scores and scores[a][0] > cfg.tau and cfg.p1_min <= scores[a][1] <= cfg.p1_max]
    kept = sorted(good, key=lambda a: (-scores[a][0], attrs.index(a)))[: cfg.pool_sizes[state.step]]
    rejected = state.rejected + tuple(a for a in state.pool if a not in kept and a not in state.rejected)
    rows = state.rows + [(state.step, a, *scores[a], a in kept) for a in attrs if a in scores]
    at = [bank.attrs.index(a) for a in kept]
    images = regress.with_u(bank.images, cfg.n)
    own = images.withColumn("g", F.array(*(F.col("g")[i] for i in at)) if at else F.array().cast("array<int>"))
    next_pool, r2 = tuple(kept), 0.0
    if kept:
        fits = regress.per_prompt(own, len(kept)).persist()
        r2 = fits.agg(F.avg("r2")).first()[0] or 0.0
        if state.step + 1 < cfg.steps:
            e = regress.residuals(own, fits).persist()
            new = propose(choose.extremes(e, cfg.extremes), next_pool, rejected, 2 * cfg.admit)
            new = [a for a in new if a in bank.attrs and a not in next_pool and a not in rejected]
            if new:
                labels = bank.long().where(F.col("attr").isin(new)).join(e, ["prompt", "image_id"])
                partial = {r["attr"]: r["partial_a_hat"] for r in amplify.partial_amplification(labels, cfg.n).collect()}
                ahat = {r["attr"]: r["a_hat"] for r in amplify.amplification(amplify.scored(bank, cfg.n).where(F.col("attr").isin(new)), cfg.n).collect()}
                valid = [a for a in new if ahat.get(a, 0) > cfg.tau and partial.get(a, 0) > cfg.tau_partial]
                admitted = sorted(valid, key=lambda a: (-partial[a], a))[: cfg.admit]
                rejected += tuple(a for a in new if a not in valid)
                next_pool += tuple(admitted)
            e.unpersist()
        fits.unpersist()
    return SearchState(next_pool, rejected, state.step + 1, rows, state.explained + [(state.step, float(r2))])


def run(bank: Bank, initial: tuple[str, ...], cfg: SearchConfig, propose: Proposer | None = None, state: SearchState | None = None) -> SearchState:
    """All steps from an initial pool, or the rest of them from a state."""
    state = state or SearchState(tuple(dict.fromkeys(initial)))
    while state.step < cfg.steps:
        state = step(bank, state, cfg, propose or labelled_first(bank))
    return state
