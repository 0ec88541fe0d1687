"""Every threshold and default in one place; nested keys follow the stage they belong to."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: vocabularies the results depend on -----------------------------------
IDENTIFIER_NAMES = (
    "id", "uuid", "guid", "row_id", "customer_id", "user_id", "account_id",
    "member_id", "order_id", "transaction_id", "record_id", "index",
)
BOOLEAN_WORDS = ("0", "1", "false", "true", "n", "no", "y", "yes", "f", "t")
NUMERIC_SENTINELS = (-1, -999, -9999, -99, 9999, 99999, 0)
TEXT_SENTINELS = ("n/a", "na", "none", "null", "missing", "unknown", "-", "", "?", "nan")
COPY_WORDS = ("copy", "duplicate", "clone")
# A compact code: letters, digits and the characters from backslash to underscore.
CODE_PATTERN = r"^[A-Za-z0-9\\-_]+$"
DIGITS_PATTERN = r"^\d+$"
STAGES = (
    "analysis", "preprocessing", "feature_engineering", "model_selection",
    "training", "evaluation", "explainability",
)
# -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScaleLimits:
    """Sizes above which an operator leaves its small-data shortcut.

    Each limit is compared with a measured count before the shortcut is taken.
    """

    exact_quantile_values: int = 4_000_000    # values one `percentile` task may hold
    broadcast_rows: int = 200_000             # rows of a lookup table sent to executors,
    broadcast_text: int = 64_000_000          # and the characters they may hold
    inline_levels: int = 500                  # levels written into an expression
    rows_per_bucket: int = 200_000            # target rows per ordering bucket
    small_table_rows: int = 100_000           # rows a single window task may rank
    correlation_columns: int = 20             # columns handled by one fused aggregate
    tree_block_bytes: int = 32_000_000        # binned rows that a task may hold as a whole


@dataclass(frozen=True)
class PrepareConfig:
    test_size: float = 0.2
    seed: int = 42
    small_dataset_row_threshold: int = 1000
    drop_rows_max_fraction: float = 0.04
    drop_column_missing_fraction: float = 0.5
    onehot_max_categories: int = 20
    rare_category_fraction: float = 0.01
    rare_category_min_levels: int = 10
    rare_category_max_group_fraction: float = 0.2
    near_constant_fraction: float = 0.99
    skew_threshold: float = 1.0
    outlier_fraction_threshold: float = 0.05
    robust_scaler_min_outlier_columns: int = 1
    identifier_unique_fraction: float = 0.98
    missing_value_strategy: str = "auto"
    protect_rows_from_drop: bool = False
    force_keep_columns: tuple[str, ...] = ()
    force_drop_columns: tuple[str, ...] = ()
    encoding_strategy_overrides: dict[str, str] = field(default_factory=dict)
    scaler: str = "auto"
    rare_category_grouping: bool = True


@dataclass(frozen=True)
class FeatureConfig:
    correlation_threshold: float = 0.95
    importance_threshold: float = 0.01
    interaction_sources: int = 5
    importance_trees: int = 50
    importance_depth: int = 8
    seed: int = 42
    n_features_to_select: int = 0
    use_interactions: bool = True
    use_pca: bool = False
    n_pca_components: int | None = None
    include_features: tuple[str, ...] = ()
    exclude_features: tuple[str, ...] = ()
    force_keep_engineered_features: tuple[str, ...] = ()
    force_drop_engineered_features: tuple[str, ...] = ()
    fit_on: str = "all"  # "all" or "train"


@dataclass(frozen=True)
class TrainConfig:
    cv_folds: int = 5
    n_trials: int = 20
    search: str = "model"  # "model": generations proposed from earlier scores, or "random"
    optimize: bool = True
    multi_model: bool = True
    ensemble: bool = False
    ensemble_type: str = "stacking"
    ensemble_top_k: int = 3
    seed: int = 42
    parallelism: int = 2
    preferred_model_family: str | None = None
    force_model_name: str | None = None
    reduce_complexity: bool = False
    regularization_strength: str = "normal"
    class_weights: bool = False
    metric_priority: str | None = None


@dataclass(frozen=True)
class EvaluateConfig:
    primary_metric: str | None = None
    deployment_threshold: float | None = None


@dataclass(frozen=True)
class AutoMLConfig:
    prepare: PrepareConfig = field(default_factory=PrepareConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    train: TrainConfig = field(default_factory=TrainConfig)
    evaluate: EvaluateConfig = field(default_factory=EvaluateConfig)
    limits: ScaleLimits = field(default_factory=ScaleLimits)


LIMITS = ScaleLimits()
