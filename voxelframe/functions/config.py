"""Typed settings with ranges; unknown keys are dropped on load and refused on update."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace


class Settings:
    @classmethod
    def load(cls, values: dict):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known}).checked()

    def update(self, **values):
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **values).checked()

    def dump(self) -> dict:
        return asdict(self)

    def checked(self):
        return self


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class DataSettings(Settings):
    name: str = ""
    resolution: tuple[float, float, float] = (1.0, 1.0, 1.0)
    train: tuple[str, ...] = ("train",)
    val: tuple[str, ...] = ()
    test: tuple[str, ...] = ()
    small_size: int = 128
    long_range: int = 10
    synthetic_ratio: float = 0.5

    def checked(self):
        _need(32 <= self.small_size <= 512, "small_size must be 32..512")
        _need(self.long_range >= 1, "long_range must be at least 1")
        _need(0 <= self.synthetic_ratio <= 1, "synthetic_ratio must be 0..1")
        _need(bool(self.train), "a train split is required")
        return self


@dataclass(frozen=True)
class DecodeSettings(Settings):
    kernel: int = 3
    channels: int = 6
    thresholds: tuple[float, ...] = field(default_factory=tuple)
    min_size: int = 100
    max_instances: int | None = None
    morphology: tuple[str, ...] = ()

    def checked(self):
        _need(self.kernel in (3, 5, 7), "kernel must be 3, 5 or 7")
        _need(self.channels in (3, 6, 7), "channels must be 3, 6 or 7")
        _need(all(0 <= t <= 1 for t in self.thresholds), "thresholds must be 0..1")
        return self
