"""Settings of a scan, with the checks that a settings file has to pass."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class ScanConfig:
    engine: str = "auto"
    sample_rate: int = 10
    min_word_count: int = 12
    networks: tuple[str, ...] = ("BTC", "ETH", "SOL")
    strings: tuple[str, ...] = ()
    fuzzy: bool = False
    fuzzy_threshold: float = 85
    max_free: int = 3
    api_keys: bool = True
    blur: float = 0.8
    warn: float = 0.6
    monitor: int = 0
    port: int = 4455
    return_delay: float = 3
    sanitized: bool = True
    unknown: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        checks = {
            "engine": self.engine in ("auto", "paddleocr", "easyocr", "tesseract"),
            "sample_rate": self.sample_rate >= 1,
            "min_word_count": self.min_word_count in (12, 24),
            "fuzzy_threshold": 0 <= self.fuzzy_threshold <= 100,
            "blur": 0 < self.blur <= 1,
            "warn": 0 < self.warn <= 1 and self.warn < self.blur,
            "monitor": self.monitor >= 0,
            "port": 1 <= self.port <= 65535,
            "return_delay": self.return_delay >= 0,
        }
        bad = [name for name, ok in checks.items() if not ok]
        if bad:
            raise ValueError(f"invalid settings: {', '.join(bad)}")


def from_dict(values: dict) -> ScanConfig:
    """Settings from a mapping; missing keys have defaults, unknown ones are named and ignored."""
    known = {f.name for f in fields(ScanConfig)} - {"unknown"}
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    return ScanConfig(**own, unknown=tuple(sorted(set(values) - known)))


def from_yaml(path: str) -> ScanConfig:
    """Settings from a YAML file on the driver; an empty file, or none, gives the defaults."""
    import os

    import yaml  # optional: only this function needs it

    if not os.path.exists(path):
        return ScanConfig()
    with open(path, encoding="utf-8") as f:
        try:
            values = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ValueError(f"{path} is no YAML: {e}") from e
    if values is not None and not isinstance(values, dict):
        raise ValueError(f"{path} holds no settings")
    return from_dict(values or {})
