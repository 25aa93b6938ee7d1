"""Policies as values: functions that return Column expressions, so a swap stays inside the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import arrays as R
from tracewright.functions import scalars as S


@dataclass(frozen=True)
class Semantics:
    """Gradual semantics: an aggregate over incoming strengths and its influence on the base score.

    ``sums(of, x, n)`` and ``influence`` are both over arrays; without them there are plans only.
    """

    name: str
    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column, Column], Column]
    sums: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None
    influence: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None


DF_QUAD = Semantics("df_quad", S.prob_sum, S.df_quad, R.prob_sums, R.df_quad)
QUADRATIC_ENERGY = Semantics("quadratic_energy", S.exact_sum, S.quadratic_energy, R.exact_sums, R.quadratic_energy)


@dataclass(frozen=True)
class Semiring:
    """``times`` folds a rule's body (an aggregate) and its strength, ``plus`` alternatives.

    ``fold`` is ``times`` and ``extend`` over arrays, where ``plus`` is the maximum; without it there are plans only.
    """

    name: str
    times: Callable[[Column], Column]
    extend: Callable[[Column, Column], Column]
    plus: Callable[[Column], Column] = F.max
    fold: np.ufunc | None = None


GODEL = Semiring("godel", F.min, lambda a, b: F.least(a, b), fold=np.fmin)
VITERBI = Semiring("viterbi", F.product, lambda a, b: a * b, fold=np.multiply)


@dataclass(frozen=True)
class Gate:
    """A refutation is authorised if every required channel affirms and no channel dissents."""

    name: str
    required: tuple[str, ...]


CHANNELS = ("llm", "symbolic", "temporal")
DEFAULT_GATE = Gate("default", ("llm", "symbolic"))
STRICT_GATE = Gate("strict", ("llm", "symbolic", "temporal"))
LLM_ONLY_GATE = Gate("llm_only", ("llm",))


def authorise(gate: Gate, **votes: Column) -> tuple[Column, Column]:
    """``(authorised, reasons)`` from one vote column a channel: affirm, dissent, abstain or null."""
    reasons = []
    for channel in CHANNELS:
        vote = votes.get(channel, F.lit(None).cast("string"))
        needed = channel in gate.required
        missing = F.when(vote.isNull(), F.lit(f"{channel}:missing")).when(vote == "abstain", F.lit(f"{channel}:abstain"))
        reasons.append(F.when(vote == "dissent", F.lit(f"{channel}:dissent")).otherwise(missing if needed else F.lit(None)))
    held = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return F.size(held) == 0, held


def _fused(b: Column, d: Column, u: Column, rate: Column) -> Column:
    return F.struct(b.alias("belief"), d.alias("disbelief"), u.alias("uncertainty"), rate.alias("base_rate"))


def cumulative_fuse(a: Column, b: Column) -> Column:
    """Cumulative fusion of two opinions; two dogmatic ones are averaged."""
    ua, ub = a["uncertainty"], b["uncertainty"]
    k = ua + ub - ua * ub
    mix = lambda x: (a[x] * ub + b[x] * ua) / k
    mean = lambda x: (a[x] + b[x]) / 2
    dogmatic = k == 0
    rate = mean("base_rate")
    return F.when(dogmatic, _fused(mean("belief"), mean("disbelief"), F.lit(0.0), rate)).otherwise(_fused(mix("belief"), mix("disbelief"), ua * ub / k, rate))


def averaging_fuse(a: Column, b: Column) -> Column:
    """Averaging fusion; not associative, so folds keep the order of their input."""
    ua, ub = a["uncertainty"], b["uncertainty"]
    k = ua + ub
    mix = lambda x: (a[x] * ub + b[x] * ua) / k
    mean = lambda x: (a[x] + b[x]) / 2
    rate = mean("base_rate")
    return F.when(k == 0, _fused(mean("belief"), mean("disbelief"), F.lit(0.0), rate)).otherwise(_fused(mix("belief"), mix("disbelief"), 2 * ua * ub / k, rate))


def fuse(opinions: Column, fusion: Callable[[Column, Column], Column]) -> Column:
    """Left fold of an array of opinions; null for an empty array."""
    return F.when(F.size(opinions) > 0, F.aggregate(F.slice(opinions, 2, F.greatest(F.size(opinions) - 1, F.lit(0))), opinions[0], fusion))


@dataclass(frozen=True)
class Significance:
    """Weight of an edge by the tier of its evidence, times credibility."""

    weights: tuple[tuple[str, float], ...] = ()

    def of(self, tier: Column, credibility: Column) -> Column:
        return S.edge_significance(S.lookup(tier, dict(self.weights), F.lit(1.0)), credibility)
