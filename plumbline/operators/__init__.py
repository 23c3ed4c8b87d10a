"""The operators, as named relations of each other and of given ones (log, logits, attention, records, runs, plates, images, summaries, registry)."""

from plumbline.operators import agreement, attention, benchmark, consensus, evaluation, gathering, images, perturbation, risk, robustness, temperature, uncertainty
from plumbline.operators.frames import RELATIONS

__all__ = ["RELATIONS", "agreement", "attention", "benchmark", "consensus", "evaluation", "gathering", "images", "perturbation", "risk", "robustness", "temperature", "uncertainty"]
