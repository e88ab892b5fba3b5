"""Thresholds, word lists and run options shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Every tunable number of the library. Rates are fractions of one.

    The thresholds are fixed values: they decide results, so they are given as they must be.
    """

    # missing values: lower edges of the severity bands
    missing_low: float = 0.05
    missing_moderate: float = 0.20
    missing_high: float = 0.50
    missing_critical: float = 0.80

    # exact duplicate rows
    duplicate_low: float = 0.001
    duplicate_moderate: float = 0.01
    duplicate_high: float = 0.05

    # low variance
    near_constant_share: float = 0.99
    low_variance_alarm_share: float = 0.25

    # outliers
    iqr_k: float = 1.5
    iqr_extreme_k: float = 3.0
    zscore_limit: float = 3.0
    modified_zscore_limit: float = 3.5
    mad_scale: float = 0.6745
    min_values_iqr: int = 4
    min_values_zscore: int = 8
    min_distinct_outliers: int = 4
    outlier_low: float = 0.01
    outlier_moderate: float = 0.05
    outlier_high: float = 0.15
    sentinel_share: float = 0.25
    disagreement_share: float = 0.5

    # numeric shape
    skew_limit: float = 1.0
    kurtosis_limit: float = 3.0
    zero_share_limit: float = 0.30
    scale_ratio_limit: float = 1e4

    # correlation and association
    r_weak: float = 0.30
    r_moderate: float = 0.50
    r_strong: float = 0.70
    r_near_perfect: float = 0.95
    r_multicollinear: float = 0.80
    r_near_duplicate: float = 0.995
    min_pair_rows: int = 10
    #: p-values are given from this absolute coefficient on
    p_value_from: float = 0.0
    v_strong: float = 0.50
    v_very_strong: float = 0.70
    association_levels: int | None = 40  # None: any number

    # categorical
    dominant_share: float = 0.90
    dominant_severe_share: float = 0.98
    rare_share: float = 0.01
    high_cardinality: int = 50
    high_cardinality_ratio: float = 0.50

    # stored types
    number_text_share: float = 0.90
    date_hint_share: float = 0.80
    date_text_share: float = 0.90
    mixed_low: float = 0.05
    mixed_high: float = 0.95
    boolean_text_share: float = 0.95
    text_like_ratio: float = 0.5
    text_like_distinct: int = 20

    # leakage screen
    identifier_ratio: float = 0.95
    identifier_sure_ratio: float = 0.999
    identifier_numeric_distinct: int = 20
    target_levels: int = 50
    target_correlation: float = 0.98
    separation_purity: float = 0.999
    separation_rows: int = 50
    separation_class_rows: int = 5
    separation_levels: int | None = 200  # None: any number
    copy_min_rows: int = 10
    copy_min_overlap: float = 0.5

    # anomalies
    anomaly_rows: int = 20
    anomaly_features: int = 2
    contamination: float = 0.05
    contamination_min: float = 0.001
    contamination_max: float = 0.50
    trees: int = 200
    tree_sample: int = 256
    seed: int = 42

    # health score
    completeness_saturation: float = 0.25
    integrity_saturation: float = 0.05
    uniqueness_saturation: float = 0.10

    # report sizes
    example_rows: int = 10
    names_in_text: int = 8
    recommendations: int = 8
    summary_lines: int = 12
    correlation_table_rows: int = 25
    map_rows: int = 400

    # scale switches: below these sizes a single task may hold a whole group
    small_group_rows: int = 2_000_000
    # distinct value pairs that a task holds when discordant pairs are counted
    inversion_block: int = 1 << 18
    # aggregation buffer fields per scan: beyond 100 Spark gives up whole-stage code generation
    fields_per_pass: int = 96


DEFAULT = Settings()


@dataclass(frozen=True)
class Options:
    """The knobs of a whole investigation."""

    contamination: float = 0.05
    correlation_method: str = "pearson"
    include_modified_zscore: bool = True
    leakage_target: str | None = None
    enable_anomalies: bool = True
    enable_leakage: bool = True
    trees: int = 200
    id_columns: tuple[str, ...] = ()
    store_input: bool = False  # write the input first: for tables that are costly to compute again
    settings: Settings = field(default_factory=Settings)


# ---- fixed values -----------------------------------------------------------
# The lists below are data that decides results, so they are given as they must be.

SEVERITY_RANK = {"critical": 4, "high": 3, "moderate": 2, "low": 1, "info": 0}

HEALTH_WEIGHTS = {
    "completeness": 0.30,
    "integrity": 0.20,
    "consistency": 0.20,
    "uniqueness": 0.15,
    "variability": 0.15,
}

HEALTH_GRADES = ((90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor"), (0, "Critical"))

SENTINELS = (-1.0, -9.0, -99.0, -999.0, -9999.0, 999.0, 9999.0, 99999.0, 999999.0)

# Text read as missing by a delimited-text reader.
READ_MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Text treated as missing by cleaning, after trimming and lower-casing.
CLEAN_MISSING_MARKERS = ("", "na", "n/a", "nan", "null", "none")

BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1", "t", "f")

DELIMITERS = (",", ";", "\t", "|")

ID_TOKENS = (
    "id", "uuid", "guid", "index", "row", "key", "identifier", "record", "pid",
    "serial", "ref", "reference", "number", "no", "num", "code", "customer",
    "patient", "student", "user", "account", "email", "phone", "mobile", "ssn",
    "passport", "national", "address", "name", "hash", "token", "roll", "reg",
)
CLEAN_ID_TOKENS = ID_TOKENS + ("ean", "isbn", "postal", "postcode", "sku", "upc", "zip")
NUMERIC_ID_SUFFIX_TOKENS = ("id", "index", "number", "no")

OUTCOME_TOKENS = (
    "target", "label", "outcome", "result", "final", "after", "post", "resolved",
    "closed", "approved", "decision", "converted", "churned", "repaid", "default",
    "survived", "diagnosis", "response", "winner", "outcome_flag",
)
WEAK_OUTCOME_TOKENS = ("score", "grade", "status", "class", "rank", "total", "amount", "value")
POST_OUTCOME_TOKENS = (
    "after", "post", "final", "end", "exit", "close", "closed", "resolved",
    "followup", "closure", "next",
)
CONDITIONAL_OUTCOME_TOKENS = (
    "completion", "completed", "graduated", "survival", "survived", "settled",
)

TARGET_EXACT = (
    "target", "label", "outcome", "class", "y", "result", "response",
    "label_encoded", "target_encoded",
)
TARGET_TOKENS = (
    "churn", "default", "fraud", "converted", "conversion", "survived", "survival",
    "purchased", "diagnosis", "attrition", "approved", "cancelled", "canceled",
    "churned", "is_active",
)
TARGET_PREFIXES = ("is_", "has_", "will_", "did_", "was_")
TARGET_SUFFIXES = ("_flag", "_target", "_label", "_class", "_outcome")

# Characters dropped from number text: separators, blanks, currency signs.
# Separators, currency signs and every white space.
NUMBER_DECORATION = (
    ",$€£¥₹ \t\n\r\f\u000b\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_HINT = (
    r"(?i)[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
    r"|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
    r"|[0-9]{1,2}:[0-9]{2}"
    r"|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
)
# Date layouts tried in this order.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M/d/yy", "d/M/yy",
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "M/d/yyyy H:m:s",
    "M/d/yyyy H:m", "d MMM yyyy", "MMM d yyyy", "MMM d, yyyy", "d-MMM-yyyy", "MMM yyyy",
    "d MMMM yyyy", "MMMM d, yyyy", "H:m:s", "H:m",
)
