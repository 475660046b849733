"""Settings of a run: one frozen value that is passed on, no globals."""

from __future__ import annotations

from dataclasses import dataclass

#: The 25 personal-data columns that the heuristic search looks for.
CRM_COLUMNS = (
    "GivenName", "Surname", "Gender", "NameSet", "Title", "StreetAddress", "City", "State", "StateFull", "ZipCode", "Country", "EmailAddress", "Username",
    "Password", "TelephoneNumber", "TelephoneCountryCode", "Birthday", "Age", "NationalID", "Color", "Occupation", "Company", "BloodType", "Kilograms", "Centimeters",
)

TREATMENTS = ("suppression", "generalization", "perturbation", "compartmentation")


@dataclass(frozen=True)
class Settings:
    """Thresholds are strict unless said otherwise."""

    max_rows: int = 0  # 0: all
    max_columns: int = 0  # 0: all
    strategy: str = "minimal"  # exact, minimal, heuristic, sampled, drawn, clustered
    max_length: int | None = None  # longest column set searched; None: all
    #: Share of rows with a unique value above which a column is dropped.
    identifier_coverage: float = 80.0
    #: Also drop columns with more distinct values than this share of rows; None: no such rule.
    identifier_cardinality: float | None = None
    #: A column set counts from this share of unique rows (0: one unique row is enough).
    min_coverage_pct: float = 0.0
    min_weight: int = 7
    min_mean_weight: int = 5
    long_mean_weight: int = 7  # for sets of more than long_length columns
    long_length: int = 4
    crm_columns: tuple[str, ...] | None = None  # None: no such rule
    stop_on_empty_level: bool = True
    treatment: str | None = None  # None: chosen per quasi-identifier; else one of TREATMENTS
    numeric_pct: float = 50.0
    text_pct: float = 50.0
    suppress_all_pct: float = 99.0
    #: Column sets counted in one job, and treatments between checkpoints.
    sets_per_job: int = 64
    checkpoint_every: int = 4
    #: Searches and treatments in a row; after the first they go over what the one before left (supersets too).
    rounds: int = 1
    drop_isolated: bool = False
    falsification: bool = False
    seed: int = 42

    def __post_init__(self) -> None:
        if self.treatment is not None and self.treatment not in TREATMENTS:
            raise ValueError(f"treatment is one of {', '.join(TREATMENTS)}")
