"""Losses of distillation: of one row from its arrays, and the mixes that trainers use. All of it stays in the JVM.

Weights and temperatures are parameters; their defaults are those of the trainers. Fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistaframe.functions import arrays as A

#: Weights of the parts of each mix. Fixed values.
MIXES: dict[str, dict[str, float]] = {
    "vision": {"kl_mean": 0.1, "contrastive": 0.5},
    "calibration": {"loca": 1.0},
    "balanced": {"loca": 0.8, "student": 0.2},
    "feature": {"kl_mean": 0.1, "student": 0.8, "contrastive": 1.0},
    "logit": {"kl_mean": 0.5, "student": 0.5},
    "combined": {"loca": 1.0, "contrastive": 1.0},
    "language": {"kl_batch": 0.1, "student": 0.5},
}
LEAST_PROBABILITY = 1e-8


def aligned(teacher: Column, student: Column) -> Column:
    """The teacher's logits cut to the student's width; a narrower teacher stays as it is."""
    return F.slice(teacher, F.lit(1), F.size(student))


def kl_sum(teacher: Column, student: Column, temperature: float = 2.0) -> Column:
    """Divergence of a row: the sum over its classes. ``mean`` is this by rows and classes, ``batch`` by rows."""
    return A.kl(A.softmax(aligned(teacher, student), temperature), A.log_softmax(student, temperature))


def kl_mean(teacher: Column, student: Column, temperature: float = 2.0) -> Column:
    """The mean over classes times the squared temperature."""
    return kl_sum(teacher, student, temperature) / F.size(student) * temperature**2


def student_loss(student: Column, label: Column) -> Column:
    return A.cross_entropy(student, label)


def calibrated_kl(teacher: Column, student: Column, label: Column, temperature: float = 2.0, alpha: float = 0.8) -> Column:
    """Divergence of the calibrated teacher from the student, whose probabilities are at least ``LEAST_PROBABILITY``: the mean
    over classes times the squared temperature. Calibrated probabilities of 0 or less add nothing."""
    q = A.calibrated(A.softmax(aligned(teacher, student), temperature), label, alpha)
    log_p = F.transform(A.softmax(student, temperature), lambda p: F.log(F.greatest(p, F.lit(LEAST_PROBABILITY))))
    return A.kl(q, log_p) / F.size(student) * temperature**2


def loca(teacher: Column, student: Column, label: Column, temperature: float = 2.0, alpha: float = 0.8) -> Column:
    """The calibrated divergence and the student's own loss."""
    return calibrated_kl(teacher, student, label, temperature, alpha) + student_loss(student, label)


def mix(name: str, parts: Mapping[str, Column]) -> Column:
    """A weighted sum of parts, which are those that the mix names."""
    terms = [weight * parts[part] for part, weight in MIXES[name].items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total
