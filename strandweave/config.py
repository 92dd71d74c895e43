"""Thresholds of a contact map."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MapConfig:
    """enzymes: names, for site counts; min_insert: 0 for none; strong: least matched length at the 5' end, or None; tip_size: bases at each end, or
    None for whole-sequence maps; bin_size: bases of an extent bin, or None; min_len, min_signal: acceptance criteria."""

    enzymes: tuple[str, ...] = ()
    min_insert: int = 0
    min_mapq: int = 60
    strong: int | None = None
    tip_size: int | None = None
    bin_size: int | None = None
    min_len: int = 0
    min_signal: int = 0
    linear: bool = True

    def __post_init__(self) -> None:
        if self.tip_size is not None and self.tip_size <= 0:
            raise ValueError("tip_size must be positive, or None")
        if self.bin_size is not None and self.bin_size <= 0:
            raise ValueError("bin_size must be positive, or None")

    @property
    def tip_based(self) -> bool:
        return self.tip_size is not None
