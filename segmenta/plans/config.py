"""Settings of a run, and presets."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Explicitly given settings win over the preset, the preset over defaults."""

    profile: str = "default"
    beam_size: int = 12
    best_of: int = 8
    patience: float = 1.8
    temperature: tuple[float, ...] = (0.0, 0.1, 0.2)
    no_speech_threshold: float = 0.52
    primary_language: str = "ur"
    enable_dual_pass_arabic: bool = True
    enable_retry_decoding: bool = True
    dual_pass_max_window_s: float = 45.0
    contextual_prompt_chunk_s: float = 120.0
    contextual_prompt_min_duration_s: float = 180.0
    chunk_overlap: float = 2.0
    merge_arabic_quote_blocks: bool = True
    low_confidence_threshold: float = 0.35
    low_quality_threshold: float = 0.25
    compression_ratio_threshold: float = 1.8
    enable_language_locking: bool = True
    language_lock_threshold: float = 0.90
    retry_logprob_threshold: float = -0.9
    hadith_token_set_threshold: float = 78
    hadith_combined_threshold: float = 78
    enable_hadith_verification: bool = False
    no_hadith: bool = False
    formula_exclusive: bool = True
    max_file_size_mb: float = 500.0
    max_audio_duration_s: float = 14400.0


# What each preset sets.
PRESETS = {
    "colab-fast": {"beam_size": 5, "best_of": 3, "patience": 1.2, "enable_dual_pass_arabic": False, "enable_retry_decoding": False},
    "colab-accurate": {"beam_size": 8, "best_of": 5, "patience": 1.5, "primary_language": "ur", "no_speech_threshold": 0.52, "enable_dual_pass_arabic": True, "enable_retry_decoding": True},
    "urdu-bayan": {"beam_size": 8, "best_of": 5, "patience": 1.5, "primary_language": "ur", "compression_ratio_threshold": 1.8, "no_speech_threshold": 0.52, "temperature": (0.0, 0.1, 0.2), "enable_language_locking": False},
    "quran-recitation": {"beam_size": 12, "best_of": 8, "patience": 1.8, "primary_language": "ar", "compression_ratio_threshold": 2.2, "no_speech_threshold": 0.45, "temperature": (0.0, 0.1)},
}


def settings(profile: str = "default", **given) -> Settings:
    unknown = set(given) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(Settings(profile=profile), **PRESETS.get(profile.lower(), {}) | given)


def from_environment(prefix: str = "SEGMENTA_") -> Settings:
    """Settings from variables such as SEGMENTA_BEAM_SIZE."""
    given = {}
    for f in fields(Settings):
        raw = os.environ.get(prefix + f.name.upper())
        if raw is not None and f.name != "profile":
            kind = type(f.default)
            given[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else tuple(map(float, raw.split(","))) if kind is tuple else kind(raw)
    return settings(os.environ.get(prefix + "PROFILE", "default"), **given)
