"""Settings of a study, by the step that uses them. All times are in minutes, unless the name says otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

MINUTE = 60_000_000
DAY = 1440 * MINUTE


def _check(rule: bool, what: str) -> None:
    if not rule:
        raise ValueError(what)


# The defaults below are fixed values: results depend on them.


@dataclass(frozen=True)
class Clock:
    """Bins, rolling sum, trailing threshold and chains."""

    width_min: int = 5
    label: str = "right"
    span_bins: int = 3
    quantile: float = 0.99
    trail_days: int = 30
    inclusive: bool = False
    warmup_days: int = 30
    quiet_min: int = 120
    masked_run_h: float | None = None

    def __post_init__(self) -> None:
        _check(self.label in ("left", "right"), "label is left or right")
        _check(0 < self.quantile < 1, "quantile lies between 0 and 1")
        _check(min(self.width_min, self.span_bins, self.trail_days) > 0, "widths, spans and trails are positive")


@dataclass(frozen=True)
class Window:
    """The window around an onset and the bars its reference price is taken from (first and last, before the onset)."""

    before_min: int = 15
    after_min: int = 120
    reference: tuple[int, int] = (45, 20)
    reference_bars: int = 4
    missing_bars: int = 2

    def __post_init__(self) -> None:
        _check(self.reference[0] >= self.reference[1], "the first reference bar is not after the last")


@dataclass(frozen=True)
class Interest:
    """Baseline and trough of open interest."""

    base_min: int = 60
    stale_min: int = 2
    base_missing: int = 2
    trough_missing: int = 3


@dataclass(frozen=True)
class Outcome:
    """Persistence and recovery."""

    tolerance: float = 0.0010
    horizon_h: int = 24
    age_min: int = 10
    gap_min: int = 15


@dataclass(frozen=True)
class Classes:
    """Classes by the response of open interest, and the measure of an event's size."""

    rule: str = "expanding"
    share: float = 0.10
    cut: float = -0.025
    upper: float = -0.005
    least_prior: int = 20
    size: str = "onset"

    def __post_init__(self) -> None:
        _check(self.rule in ("expanding", "fixed"), "rule is expanding or fixed")
        _check(self.size in ("onset", "window_total", "none"), "size is onset, window_total or none")


@dataclass(frozen=True)
class Study:
    clock: Clock = field(default_factory=Clock)
    window: Window = field(default_factory=Window)
    interest: Interest = field(default_factory=Interest)
    outcome: Outcome = field(default_factory=Outcome)
    classes: Classes = field(default_factory=Classes)

    def but(self, **changes: object) -> Study:
        """The same study with settings changed; each name belongs to one step."""
        out = self
        for name, value in changes.items():
            part = next((f.name for f in fields(self) if name in {g.name for g in fields(getattr(self, f.name))}), None)
            if part is None:
                raise ValueError(f"no step has a setting named {name}")
            out = replace(out, **{part: replace(getattr(out, part), **{name: value})})
        return out


#: For tables that cover one month only.
MONTH = Study().but(trail_days=7, warmup_days=7)
