"""Column roles of a patient table.

The survey table uses long question names; the driver-derived cohort uses
short ones.  Operators take a :class:`ColumnSpec` instead of hard-coding names.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from . import fixed


@dataclass(frozen=True)
class ColumnSpec:
    id: str = "patient_id"
    target: str = fixed.TARGET
    yes_no: tuple[str, ...] = tuple(fixed.BINARY_YES_NO_COLUMNS)
    gender: str = "gender"
    living_area: str = "living_area"
    age: str = "age"
    creatinine: str = "serum_creatinine"
    egfr: str = "egfr"
    hemoglobin: str = "hemoglobin"
    numerical: tuple[str, ...] = tuple(fixed.NUMERICAL_FEATURES)
    exclude: tuple[str, ...] = tuple(fixed.EXCLUDE_FROM_PREDICTION)
    # columns that are never features (keys, precomputed scores)
    non_features: tuple[str, ...] = field(default_factory=tuple)
    drop: tuple[str, ...] = tuple(fixed.DROP_COLUMNS)

    def feature_columns(self, columns: list[str]) -> list[str]:
        """All columns minus target, leakage list, id and non-features, in table order."""
        skip = {self.target, self.id, *self.exclude, *self.non_features}
        return [c for c in columns if c not in skip]

    def binary_features(self, columns: list[str]) -> list[str]:
        enc = [*self.yes_no, self.gender, self.living_area]
        return [c for c in self.feature_columns(columns) if c in enc]

    def with_(self, **kw) -> "ColumnSpec":
        return replace(self, **kw)


SURVEY_SPEC = ColumnSpec()

COHORT_SPEC = ColumnSpec(
    yes_no=("diabetes", "hypertension", "foamy_urine", "extra_salt"),
    non_features=("probability",),
)
