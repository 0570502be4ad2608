"""Settings of a comparison."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DiffConfig:
    """``threshold`` filters best matches only if it is given; ``empties_need_exclusions`` records
    empty classes only where an exclusion list is set; ``obfuscated`` leaves out name statistics."""

    excluded: tuple[str, ...] = ()
    hamming_distance: int = 3
    threshold: float | None = None
    obfuscated: bool = False
    empties_need_exclusions: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.hamming_distance <= 31:
            raise ValueError("the Hamming distance must be between 0 and 31")
        # a blank entry would exclude every class
        object.__setattr__(self, "excluded", tuple(e for e in (x.strip("\r\n") for x in self.excluded) if e.strip()))
