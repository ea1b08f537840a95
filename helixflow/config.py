"""Settings: an argument, else the file that $HELIXFLOW_CONFIG names, else helixflow.yaml here, else defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml


@dataclass(frozen=True)
class PanelConfig:
    """A panel: the prefix of its files, its SNP column, the floor of SNPs and what counts as low power."""

    prefix: str = ""
    snps_col: str = "snps_1240k"
    snp_floor: int = 30_000
    snp_lowpower: int = 200_000


@dataclass(frozen=True)
class Config:
    blocks: int = 50
    neighbors: int = 80
    panels: dict[str, PanelConfig] = field(default_factory=lambda: {"ho": PanelConfig(snps_col="snps_ho"), "1240k": PanelConfig()})


def load(path: str | None = None) -> Config:
    """The defaults, overlaid with the file's values; a panel's missing values come from its default."""
    path = path or os.environ.get("HELIXFLOW_CONFIG") or ("helixflow.yaml" if Path("helixflow.yaml").exists() else None)
    base = Config()
    if not path:
        return base
    given = yaml.safe_load(Path(path).read_text()) or {}
    panels = dict(base.panels)
    for name, values in (given.pop("panels", None) or {}).items():
        panels[name] = replace(panels.get(name, PanelConfig()), **values)
    return replace(base, panels=panels, **given)
