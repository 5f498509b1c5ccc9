"""The ledger of privacy loss, and the calibration of noise."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from statistics import NormalDist


class Event:
    """An entry of the ledger; composing drops NO_OP and flattens."""

    def compose(self, other: Event) -> Event:
        parts = [p for e in (self, other) for p in (e.events if isinstance(e, Composed) else (e,)) if p != NoOp()]
        return NoOp() if not parts else parts[0] if len(parts) == 1 else Composed(tuple(parts))


@dataclass(frozen=True)
class NoOp(Event):
    pass


@dataclass(frozen=True)
class Gaussian(Event):
    noise_multiplier: float


@dataclass(frozen=True)
class Laplace(Event):
    noise_multiplier: float


@dataclass(frozen=True)
class EpsilonDelta(Event):
    epsilon: float
    delta: float


@dataclass(frozen=True)
class Composed(Event):
    events: tuple


@dataclass(frozen=True)
class PoissonSampled(Event):
    probability: float
    event: Event


@dataclass(frozen=True)
class SampledWithReplacement(Event):
    source: int
    sample: int
    event: Event


@dataclass(frozen=True)
class SampledWithoutReplacement(Event):
    source: int
    sample: int
    event: Event


def noise_multiplier(epsilon: float, delta: float) -> float:
    """Of the classic Gaussian mechanism, proven for epsilon up to 1."""
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("no budget: epsilon and delta must be positive")
    if epsilon > 1:
        warnings.warn("the Gaussian calibration is proven for epsilon up to 1", stacklevel=2)
    return math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float) -> float:
    return min(noise_multiplier(epsilon, delta) * sensitivity, 1.7976931348623157e308)


def tau(epsilon: float, delta: float, groups: int) -> float:
    """The count of units above which a group key may be released, if a unit is in at most `groups` groups."""
    return 1 + gaussian_sigma(epsilon, delta, math.sqrt(groups)) * NormalDist().inv_cdf((1 - delta) ** (1 / groups))


@dataclass(frozen=True)
class Parameters:
    epsilon: float
    delta: float
    tau_share: float = 0.5
    max_multiplicity: float = 100.0
    multiplicity_share: float = 0.1
    max_groups: int = 5
    #: Clipping values for columns whose range is not known.
    clips: tuple[tuple[str, float], ...] = ()

    def multiplicity(self, size: float, unit_unique: bool) -> float:
        """Rows that a unit may count with."""
        return 1.0 if unit_unique else float(math.ceil(min(self.max_multiplicity, size * self.multiplicity_share)))
