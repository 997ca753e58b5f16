"""Settings of feature preparation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PreprocessConfig:
    """The defaults."""

    noise_std: float = 0.15
    flip_rate_base: float = 0.06
    flip_rate_border: float = 0.15
    border_margin: float = 0.8
    hr_threshold: float = 5.0
    scaler_type: str = "robust"  # or "standard"
    use_power_transform: bool = True
    variance_threshold: float = 0.001
    winsorize_clip: float = 3.5
    random_state: int = 42
