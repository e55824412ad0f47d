"""Detection parameters, their presets and limits."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class DetectParams:
    step_frames: int = 15
    diff_threshold: int = 45
    event_ratio: float = 0.14
    cooldown_frames: int = 120
    min_changed_pixels: int = 25_000
    morph_kernel: int = 3
    ema_alpha: float = 0.20
    low_factor: float = 0.60
    min_active_ms: int = 1200
    nms_window_ms: int = 2000
    merge_ms: int = 4000
    warmup_ms: int = 0
    max_ms: int | None = None
    trace: bool = False

    def clamped(self) -> DetectParams:
        """The parameters within their limits."""
        return DetectParams(
            max(1, self.step_frames),
            max(1, self.diff_threshold),
            max(1e-4, self.event_ratio),
            max(0, self.cooldown_frames),
            max(0, self.min_changed_pixels),
            max(1, self.morph_kernel),
            min(1.0, max(0.0, self.ema_alpha)),
            max(1e-6, self.low_factor),
            max(0, self.min_active_ms),
            max(0, self.nms_window_ms),
            max(0, self.merge_ms),
            self.warmup_ms,
            self.max_ms,
            self.trace,
        )

    @property
    def high(self) -> float:
        return self.event_ratio

    @property
    def low(self) -> float:
        return max(1e-6, self.event_ratio * self.low_factor)

    def min_frames(self, fps: float) -> int:
        return max(1, int(self.min_active_ms / 1000 * fps + 0.5))


# The shipped settings, the defaults, and what the short constructor uses.
SHIPPED = DetectParams(15, 45, 0.16, 150, 35_000, 1, 0.45, 0.96, 300, 700, 2500)
DEFAULT = DetectParams()
LEGACY6 = DetectParams(min_changed_pixels=5000, merge_ms=4000, ema_alpha=0.20, low_factor=0.60, trace=True)

#: For the driver's event series: hour-sized gaps, every second sample a frame.
SERIES = DetectParams(2, 45, 0.55, 2, 20_000, 1, 0.45, 0.9, 80, 36_000_000, 90_000_000)
FPS = 25.0
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class OcrParams:
    """Limits of plate reading: FAST by default."""

    offsets_sec: str = "0,-4,4"
    max_calls: int = 150
    max_roi: int = 80
    stop_votes: int = 2
    stop_votes_min_len: int = 8
    min_contrast: float = 0.10
    fill_min: float = 0.01
    fill_max: float = 0.90
    include_region: bool = False


AUDIT = OcrParams(max_calls=1000, max_roi=324)


def parse_args(argv: list[str]) -> dict[str, str]:
    """`--key=value` arguments; others are passed over, the last of a key counts."""
    pairs = (a[2:].split("=", 1) for a in argv if a.startswith("--") and "=" in a)
    return dict(pairs)


def settings_of(lines: list[str]) -> dict[str, str]:
    """`key: value` lines, with keys under an indented section named `section.key`; comments and other lines are passed over."""
    found, section = {}, ""
    for line in lines:
        text = line.split("#", 1)[0].rstrip()
        key, colon, value = text.strip().partition(":")
        if not colon:
            continue
        indented = text[:1].isspace()
        if not value.strip():
            section = f"{section}.{key}" if indented and section else key
            continue
        if not indented:
            section = ""
        found[f"{section}.{key}" if indented and section else key] = value.strip().strip("'\"")
    return found


PREFIX = "tripwise.detect."


def resolved(conf, file: str | None = None, defaults: DetectParams = SHIPPED, **given) -> DetectParams:
    """Parameters within their limits: what is given, else the session's `tripwise.detect.<name>`, else the file's
    `detect` section, else the defaults. The session may name the file as `tripwise.config`; a missing one is empty."""
    path = Path(conf.get("tripwise.config", None) or file or "application.yaml")
    in_file = settings_of(path.read_text().splitlines()) if path.is_file() else {}
    values = {}
    for f in fields(DetectParams):
        text = conf.get(PREFIX + f.name, None) or in_file.get(f"detect.{f.name}")
        if text is not None:
            kind = type(getattr(DEFAULT, f.name))
            values[f.name] = text.lower() in ("true", "1", "yes") if kind is bool else float(text) if kind is float else int(text)
    return replace(defaults, **values | given).clamped()
