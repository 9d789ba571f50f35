"""Parameters of a scan as one frozen value; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Defaults and ceilings that results depend on.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG")
SAFE = {"max_file_bytes": 4 << 20, "max_total_bytes": 128 << 20, "max_files": 20_000, "max_commits": 1_000, "max_deltas": 50_000}
CEILINGS = {"max_file_bytes": 256 << 20, "max_total_bytes": 4 << 30, "max_files": 500_000, "max_commits": 100_000, "max_deltas": 2_000_000, "context_tokens": 5_000_000}


@dataclass(frozen=True)
class ScanConfig:
    top: int = 10
    max_complexity: int = 20
    markers: tuple[str, ...] = MARKERS
    min_dup_tokens: int = 50
    min_dup_lines: int = 3
    similarity: float = 0.85
    max_file_bytes: int = 32 << 20
    max_total_bytes: int = 512 << 20
    max_files: int = 100_000
    max_commits: int = 5_000
    max_deltas: int = 500_000
    context_tokens: int = 32_000
    context_files: int = 25
    graph_depth: int = 1
    risk_threshold: float = 0.7
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def limited(self) -> ScanConfig:
        """This configuration under the absolute ceilings."""
        return replace(self, **{k: min(getattr(self, k), v) for k, v in CEILINGS.items()})

    def safe(self) -> ScanConfig:
        """The profile for untrusted trees."""
        return replace(self, **{k: min(getattr(self, k), v) for k, v in SAFE.items()})


def layered(*layers: dict) -> ScanConfig:
    """Defaults, then each layer over the one before: global, project, command line."""
    config = ScanConfig()
    for layer in layers:
        config = replace(config, **{k: tuple(v) if isinstance(v, list) else v for k, v in layer.items() if v is not None})
    return config.limited()
