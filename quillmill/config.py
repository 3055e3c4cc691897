"""Settings of the machine-drafted-prose detector, with overrides from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class DetectorConfig:
    """Window and stride in words, n-gram length, thresholds, and the tool limits."""

    window_words: int = 900
    window_stride_words: int = 450
    ngram: int = 10
    near_dup_threshold: float = 0.18
    long_dup_override_words: int = 250
    coverage_trigger: float = 0.03
    bias: float = -0.20
    language_tool: bool = True
    language_tool_timeout_ms: int = 5000
    language_tool_stride: int = 3
    language_tool_max_windows: int = 24
    language_tool_max_failures: int = 3
    lm_scoring: bool = False


#: Names in the environment that differ from AI_ and the field's name.
NAMES = {"ngram": "AI_NGRAM_N", "bias": "AI_SIGMOID_BIAS"}


def from_env(env: dict[str, str] | None = None) -> DetectorConfig:
    """Defaults, with AI_WINDOW_WORDS and the like taken from the environment; values that do not parse are ignored."""
    env = dict(os.environ) if env is None else env
    found = {}
    for f in fields(DetectorConfig):
        raw = env.get(NAMES.get(f.name, f"AI_{f.name.upper()}"), "").strip()
        if not raw:
            continue
        if isinstance(f.default, bool):
            found[f.name] = raw.lower() in ("1", "true", "yes", "on")
        else:
            try:
                found[f.name] = type(f.default)(raw)
            except ValueError:
                pass
    return DetectorConfig(**found)
