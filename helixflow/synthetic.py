"""Synthetic panels with a known share of archaic ancestry, as ground truth for the statistics."""

from __future__ import annotations

import numpy as np

from .sources import packed


def frequencies(n_snp: int, alpha: float, seed: int = 0) -> dict[str, np.ndarray]:
    """Allele frequencies of a two-source mixture: Test takes alpha of its ancestry from the archaic side."""
    rng = np.random.default_rng(seed)
    drift = lambda p, s: np.clip(p + rng.normal(0, s, n_snp), 0.001, 0.999)
    root = rng.uniform(0.05, 0.95, n_snp)
    chimp = (root > rng.random(n_snp)).astype(float)
    human, archaic = drift(root, 0.12), drift(root, 0.25)
    mbuti, source = drift(human, 0.05), drift(human, 0.05)
    vindija, altai, denisova = drift(archaic, 0.05), drift(archaic, 0.05), drift(archaic, 0.25)
    return {"Altai": altai, "Vindija": vindija, "Denisova": denisova, "Chimp": chimp, "Mbuti": mbuti, "Test": (1 - alpha) * source + alpha * vindija, "AltaiEcho": altai}


def write_panel(folder: str, n_snp: int, alpha: float, mbuti: int = 10, test: int = 15, missing: float = 0.02, seed: int = 1, transposed: bool = True) -> str:
    """Writes panel.geno, .ind and .snp into folder and returns the prefix; sites are interleaved over three chromosomes."""
    freq = frequencies(n_snp, alpha, seed)
    rng = np.random.default_rng(seed + 1)
    sizes = {"Mbuti": mbuti, "Test": test}
    rows, people = [], []
    for pop, p in freq.items():
        for k in range(sizes.get(pop, 1)):
            rows.append(np.where(rng.random(n_snp) < missing, -1, rng.binomial(2, p)))
            people.append((f"{pop}{k}", "U", pop))
    prefix = f"{folder}/panel"
    packed.write_packed(prefix + ".geno", np.array(rows, np.int8), transposed)
    packed.write_ind(prefix + ".ind", people)
    packed.write_snp(prefix + ".snp", ((f"rs{i}", 1 + i % 3, f"{i * 1e-5:.6f}", 1000 + 100 * (i // 3), "A", "G") for i in range(n_snp)))
    return prefix
