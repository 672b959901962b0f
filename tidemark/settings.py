"""What can be set, by the module that reads it: defaults, then a YAML file, then the environment.

A setting is named section and field, ``detection.z_warning`` in a file of nested mappings and ``TIDEMARK_DETECTION__Z_WARNING`` in the environment.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields, replace

from tidemark import constants as C

PREFIX = "TIDEMARK_"


@dataclass(frozen=True)
class Detection:
    """Read by ``operators.insights`` and ``streaming.detectors``."""

    z_warning: float = C.Z_WARNING
    z_critical: float = C.Z_CRITICAL
    baseline_windows: int = C.BASELINE_WINDOWS
    baseline_least: int = C.BASELINE_LEAST
    trend_least: int = C.TREND_LEAST
    trend_share: float = C.TREND_SHARE
    refund_rate: float = C.REFUND_RATE
    refund_purchases: int = C.REFUND_PURCHASES
    mover_share: float = C.MOVER_SHARE
    cooldown_seconds: int = C.COOLDOWN_SECONDS
    #: Fire again only when more than the cooldown has passed, instead of when it has.
    cooldown_strict: bool = False


@dataclass(frozen=True)
class Serving:
    """Read by ``operators.hot`` and ``plans.router``."""

    hot_minutes: int = C.HOT_MINUTES
    cache_seconds: float = C.CACHE_SECONDS
    cache_entries: int = C.CACHE_ENTRIES


@dataclass(frozen=True)
class Stream:
    """Read by ``streaming.jobs``."""

    watermark_seconds: int = C.WATERMARK_SECONDS
    trigger_ms: int = C.TRIGGER_MS
    rows_per_trigger: int = 50_000
    files_per_trigger: int = 10


@dataclass(frozen=True)
class Storage:
    """Read by ``sources.store``. ``backend``: parquet, jdbc, or auto, which is jdbc where a URL is given."""

    backend: str = "auto"
    warehouse: str = "data/tidemark"
    jdbc_url: str = ""


@dataclass(frozen=True)
class Settings:
    detection: Detection = Detection()
    serving: Serving = Serving()
    stream: Stream = Stream()
    storage: Storage = Storage()


def _converted(value: object, like: object) -> object:
    if isinstance(like, bool):
        return str(value).strip().lower() in ("1", "true", "yes", "on")
    return type(like)(value)


def _named(settings: Settings) -> Iterator[tuple[str, str]]:
    for section in fields(settings):
        for f in fields(getattr(settings, section.name)):
            yield section.name, f.name


def overlay(settings: Settings, given: Mapping[tuple[str, str], object]) -> Settings:
    """``settings`` with the given (section, field) values; names that nothing reads change nothing."""
    for section, name in _named(settings):
        if given.get((section, name)) not in (None, ""):
            part = getattr(settings, section)
            settings = replace(settings, **{section: replace(part, **{name: _converted(given[section, name], getattr(part, name))})})
    return settings


def from_file(path: str) -> dict[tuple[str, str], object]:
    """The values of a YAML file; what is no mapping of mappings is left out, a file that does not exist gives none."""
    if not os.path.exists(path):
        return {}
    import yaml

    with open(path, encoding="utf-8") as f:
        sections = yaml.safe_load(f)
    pairs = sections.items() if isinstance(sections, dict) else ()
    return {(section, name): value for section, values in pairs if isinstance(values, dict) for name, value in values.items()}


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    environment = os.environ if environment is None else environment
    named = {(section, name): environment.get(f"{PREFIX}{section}__{name}".upper()) for section, name in _named(Settings())}
    return overlay(overlay(Settings(), from_file(path) if path else {}), named)
