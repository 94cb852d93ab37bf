"""Options of training and analysis."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Stopping tolerance of each solver.
EPSILON = {0: 0.01, 1: 0.1, 2: 0.01, 3: 0.1, 4: 0.1, 5: 0.01, 6: 0.01, 7: 0.1}
LOGISTIC = (0, 6, 7)


@dataclass(frozen=True)
class Config:
    """``solver``: 0 and 7 L2 logistic regression (primal, dual), 1 to 3 L2 support vector machines
    (squared hinge dual and primal, hinge dual), 4 multiclass of one objective, 5 and 6 L1 (squared hinge, logistic).
    ``global_levels``: tag levels with one model for all words; others have a model for each ambiguous word.
    """

    char_window: int = 3
    char_order: int = 3
    type_window: int = 3
    type_order: int = 3
    dict_cap: int = 4
    solver: int = 1
    cost: float = 1.0
    epsilon: float | None = None
    bias: float = 1.0
    confidence: float = 0.0
    segment: bool = True
    tag: bool = True
    global_levels: tuple[int, ...] = ()
    skip_levels: tuple[int, ...] = ()
    tag_max: int = 3
    default_tag: str = "UNK"
    unknown_mark: str = ""
    unknown: bool = True
    beam: int = 50
    lm_order: int = 3
    constrain: str = ""

    def __post_init__(self) -> None:
        if self.solver not in EPSILON:
            raise ValueError(f"solvers are numbered 0 to 7, not {self.solver}")
        if not (self.segment or self.tag):
            raise ValueError("with neither segmentation nor tags nothing is left to do")
        if set(self.constrain) - set("KTHRDO"):
            raise ValueError("types are among K T H R D O")
        if min(self.char_window, self.char_order, self.type_window, self.type_order, self.dict_cap) < 1:
            raise ValueError("windows, orders and caps are at least 1")

    @property
    def eps(self) -> float:
        return EPSILON[self.solver] if self.epsilon is None else self.epsilon

    @property
    def logistic(self) -> bool:
        return self.solver in LOGISTIC

    def with_(self, **changes) -> Config:
        return Config(**{f.name: changes.pop(f.name, getattr(self, f.name)) for f in fields(self)}, **changes)


#: Model shape, kept with a model; the rest is given at each run.
KEPT = ("char_window", "char_order", "type_window", "type_order", "dict_cap", "solver", "bias", "segment", "tag", "global_levels", "skip_levels", "lm_order", "epsilon")
