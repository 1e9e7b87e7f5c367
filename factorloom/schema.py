"""Schemas of factor-graph tables, function codes and run options."""

from __future__ import annotations

from dataclasses import dataclass

#: Codes of factor functions and variable types in the graph formats.
FUNCTIONS = {
    "imply_natural": 0, "or": 1, "and": 2, "equal": 3, "istrue": 4, "linear": 7, "ratio": 8, "logical": 9, "and_categorical": 12, "imply_mln": 13,
}
BOOLEAN, CATEGORICAL = 0, 1
TRUTH_EPSILON = 1e-6

WEIGHTS = "wid bigint, is_fixed boolean, init_value double"
VARIABLES = "vid bigint, role tinyint, init_value bigint, dtype smallint, cardinality bigint"
DOMAINS = "vid bigint, cardinality bigint, vals array<struct<value:bigint,truthiness:double>>"
FACTORS = "fid bigint, func smallint, arity bigint, vifs array<struct<pos:int,vid:bigint,equal_to:bigint>>, wid bigint, feature_value double"
META = "num_weights bigint, num_variables bigint, num_factors bigint, num_edges bigint"


@dataclass(frozen=True)
class GibbsConfig:
    """Run options; the defaults are those of the command line."""

    n_learning_epoch: int = 0
    n_inference_epoch: int = 0
    burn_in: int = 0
    n_datacopy: int = 1
    alpha: float = 0.01
    stepsize: float = 0.01
    diminish: float = 0.95
    reg_param: float = 0.01
    regularization: str = "l2"
    sample_evidence: bool = False
    learn_non_evidence: bool = False
    noise_aware: bool = False
    seed: int = 1
    minibatch: int = 32
    epochs_per_sync: int | None = None

    @property
    def first_step(self) -> float:
        """stepsize counts only where alpha has its default."""
        return self.stepsize if self.alpha == 0.01 else self.alpha
