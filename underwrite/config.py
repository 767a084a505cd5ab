"""Loan schema, credit policy and monitoring thresholds.

Everything in this module is plain data. Operators receive these objects as
arguments and turn them into literals inside column expressions, so the same
plan serves any portfolio with another ``LoanSpec``.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Numeric:
    name: str
    source: str
    label: str
    low: float | None = None
    high: float | None = None
    null_limit: float = 0.01


@dataclass(frozen=True)
class Categorical:
    name: str
    source: str
    label: str
    values: tuple[str, ...] = ()


# --- Fixed values: input variables (name, raw column, label, range, accepted nulls) ---------------
NUMERIC_FEATURES = (
    Numeric("loan_amnt", "loan_amnt", "Monto solicitado (USD)", 500, 40000),
    Numeric("term_months", "term", "Plazo (meses)", 36, 60),
    Numeric("int_rate", "int_rate", "Tasa de interés (%)", 5, 31),
    Numeric("installment", "installment", "Cuota mensual (USD)", 0),
    Numeric("emp_length_years", "emp_length", "Años en el empleo", 0, 10, 0.12),
    Numeric("annual_inc", "annual_inc", "Ingreso anual (USD)", 0),
    Numeric("dti", "dti", "Ratio deuda / ingreso (%)", 0, 100, 0.02),
    Numeric("delinq_2yrs", "delinq_2yrs", "Morosidades 30+ días (2 años)", 0),
    Numeric("fico_score", "fico_range_low", "Puntaje FICO al solicitar", 300, 850),
    Numeric("inq_last_6mths", "inq_last_6mths", "Consultas de crédito (6 meses)", 0, None, 0.02),
    Numeric("open_acc", "open_acc", "Líneas de crédito abiertas", 0),
    Numeric("pub_rec", "pub_rec", "Registros públicos negativos", 0),
    Numeric("revol_bal", "revol_bal", "Saldo revolvente (USD)", 0),
    Numeric("revol_util", "revol_util", "Utilización revolvente (%)", 0, 200, 0.02),
    Numeric("total_acc", "total_acc", "Total de líneas de crédito", 0),
    Numeric("mort_acc", "mort_acc", "Hipotecas", 0, None, 0.10),
    Numeric("pub_rec_bankruptcies", "pub_rec_bankruptcies", "Quiebras registradas", 0, None, 0.05),
    Numeric("credit_history_months", "earliest_cr_line", "Antigüedad crediticia (meses)", 0),
)
CATEGORICAL_FEATURES = (
    Categorical("grade", "grade", "Grado asignado por Lending Club", ("A", "B", "C", "D", "E", "F", "G")),
    Categorical("sub_grade", "sub_grade", "Subgrado"),
    Categorical("home_ownership", "home_ownership", "Vivienda", ("MORTGAGE", "RENT", "OWN", "OTHER")),
    Categorical(
        "verification_status",
        "verification_status",
        "Verificación de ingresos",
        ("Not Verified", "Source Verified", "Verified"),
    ),
    Categorical("purpose", "purpose", "Propósito del préstamo"),
    Categorical("addr_state", "addr_state", "Estado (EE. UU.)"),
    Categorical("application_type", "application_type", "Tipo de solicitud", ("Individual", "Joint App")),
    Categorical("initial_list_status", "initial_list_status", "Listado inicial", ("w", "f")),
)
DERIVED_FEATURES = {
    "loan_to_income": "Monto / ingreso anual",
    "installment_to_income": "Cuota anual / ingreso anual",
    "revol_bal_to_income": "Saldo revolvente / ingreso anual",
    "open_acc_ratio": "Líneas abiertas / líneas totales",
    "log_annual_inc": "Log del ingreso anual",
}
POSITIVE_STATUS = ("Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off")
NEGATIVE_STATUS = ("Fully Paid", "Does not meet the credit policy. Status:Fully Paid")
EMPLOYMENT_YEARS = {
    "< 1 year": 0.0,
    "1 year": 1.0,
    "2 years": 2.0,
    "3 years": 3.0,
    "4 years": 4.0,
    "5 years": 5.0,
    "6 years": 6.0,
    "7 years": 7.0,
    "8 years": 8.0,
    "9 years": 9.0,
    "10+ years": 10.0,
}
CATEGORY_ALIASES = {
    "home_ownership": {"NONE": "OTHER", "ANY": "OTHER"},
    "application_type": {"JOINT": "Joint App", "INDIVIDUAL": "Individual"},
}
LEAKAGE_COLUMNS = (
    "funded_amnt",
    "funded_amnt_inv",
    "out_prncp",
    "out_prncp_inv",
    "total_pymnt",
    "total_pymnt_inv",
    "total_rec_prncp",
    "total_rec_int",
    "total_rec_late_fee",
    "recoveries",
    "collection_recovery_fee",
    "last_pymnt_d",
    "last_pymnt_amnt",
    "next_pymnt_d",
    "last_credit_pull_d",
    "last_fico_range_high",
    "last_fico_range_low",
    "pymnt_plan",
    "hardship_flag",
    "debt_settlement_flag",
    "settlement_status",
    "settlement_amount",
)
OTHER = "__other__"
MISSING = "__missing__"
SCORECARD_OTHER = "__otros__"
SCORECARD_MISSING_CODE = 9999
LINEAGE_KEYS = (
    "git_sha",
    "gold_table",
    "gold_delta_version",
    "data_source",
    "train_end",
    "validation_end",
    "test_end",
)
# --- Fixed values: closed lists of a credit application -------------------------------------------
PURPOSES = (
    "debt_consolidation",
    "credit_card",
    "home_improvement",
    "other",
    "major_purchase",
    "medical",
    "small_business",
    "car",
    "vacation",
    "moving",
    "house",
    "wedding",
    "renewable_energy",
    "educational",
)
STATES = (
    "AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS",
    "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV",
    "NY", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY",
)
ID_PATTERN = r"^[A-Za-z0-9_.:-]{1,64}$"
SUB_GRADE_PATTERN = r"^[A-G][1-5]$"
# -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LoanSpec:
    """Names and rules that generate every loan-level column expression."""

    id_column: str = "loan_id"
    id_source: str = "id"
    date_column: str = "issue_month"
    date_source: str = "issue_d"
    status_column: str = "loan_status"
    status_source: str = "loan_status"
    target: str = "target_default"
    label_snapshot: str = "2019-01-01"
    numeric: tuple[Numeric, ...] = NUMERIC_FEATURES
    categorical: tuple[Categorical, ...] = CATEGORICAL_FEATURES
    positive: tuple[str, ...] = POSITIVE_STATUS
    negative: tuple[str, ...] = NEGATIVE_STATUS
    leakage: tuple[str, ...] = LEAKAGE_COLUMNS

    @property
    def numeric_names(self) -> list[str]:
        return [f.name for f in self.numeric]

    @property
    def categorical_names(self) -> list[str]:
        return [f.name for f in self.categorical]

    @property
    def inputs(self) -> list[str]:
        return self.numeric_names + self.categorical_names

    @property
    def canonical_columns(self) -> list[str]:
        return [self.id_column, self.date_column, *self.inputs, self.status_column, self.target]

    @property
    def source_columns(self) -> list[str]:
        """Raw columns the engine is allowed to read; anything else never enters."""
        names = {self.id_source, self.date_source, self.status_source, "fico_range_high"}
        names.update(f.source for f in (*self.numeric, *self.categorical))
        return sorted(names)

    @property
    def labels(self) -> dict[str, str]:
        return {f.name: f.label for f in (*self.numeric, *self.categorical)} | DERIVED_FEATURES

    def canonical_ddl(self) -> str:
        parts = [f"{self.id_column} STRING", f"{self.date_column} TIMESTAMP"]
        parts += [f"{n} DOUBLE" for n in self.numeric_names]
        parts += [f"{n} STRING" for n in self.categorical_names]
        parts += [f"{self.status_column} STRING", f"{self.target} DOUBLE"]
        return ", ".join(parts)


# --- Fixed values: credit policy -----------------------------------------------------------------
APPROVE, REJECT, REVIEW = "APROBAR", "RECHAZAR", "REVISION_MANUAL"
REASON_PD_HIGH = "PD_SOBRE_UMBRAL"
REASON_GREY_ZONE = "PD_ZONA_GRIS"
REASON_PAYMENT = "CUOTA_INGRESO_ALTA"
REASON_DTI = "DTI_ALTO"
REASON_NO_MODEL = "MODELO_NO_DISPONIBLE"
REASON_BROKEN = "SALIDA_MODELO_INCOHERENTE"
REASON_PREFIX = "RIESGO_"
RISK_BANDS = ((0.05, "A"), (0.10, "B"), (0.20, "C"), (0.35, "D"))
LAST_BAND = "E"


@dataclass(frozen=True)
class CreditPolicy:
    version: str = "2026.10-1"
    default_threshold: float = 0.18
    review_band: float = 0.02
    max_payment_to_income: float = 0.40
    max_dti: float = 45.0
    max_reason_codes: int = 4


@dataclass(frozen=True)
class SplitDates:
    train_end: str = "2013-01-01"
    validation_end: str = "2013-07-01"
    test_end: str = "2014-01-01"


@dataclass(frozen=True)
class ReplayRules:
    production_start: str = "2014-01-01"
    production_end: str = "2015-12-01"
    months_per_run: int = 3
    label_delay_months: int = 6


@dataclass(frozen=True)
class SelectionRules:
    practical_margin: float = 0.005
    alpha: float = 0.05
    complexity: dict[str, int] = field(
        default_factory=lambda: {"logistic_regression": 1, "gradient_boosting": 2, "random_forest": 2}
    )
    cost_fn: float = 5.0
    cost_fp: float = 1.0


@dataclass(frozen=True)
class QualityGates:
    min_test_roc_auc: float = 0.66
    max_overfit_gap: float = 0.08
    max_brier: float = 0.20
    max_latency_ms: float = 5.0
    min_auc_improvement: float = 0.002


@dataclass(frozen=True)
class ExperimentRules:
    challenger_traffic: float = 0.20
    min_labeled_per_arm: int = 500
    alpha: float = 0.05
    bootstrap_iterations: int = 500
    max_test_months: int = 6
    salt: str = "ab-v1"


@dataclass(frozen=True)
class MonitoringRules:
    window_months: int = 3
    min_rows: int = 300
    psi_warning: float = 0.10
    psi_alert: float = 0.25
    ks_pvalue_alert: float = 0.01
    max_features_drifted: int = 3
    prediction_psi_alert: float = 0.20
    default_rate_abs_change: float = 0.03
    auc_drop_alert: float = 0.04
    ks_drop_alert: float = 0.08
    brier_increase_alert: float = 0.02
    ddm_warning_level: float = 2.0
    ddm_drift_level: float = 3.0
    ddm_min_n: int = 100
    page_hinkley_delta: float = 0.005
    page_hinkley_lambda: float = 50.0
    retrain_cooldown_months: int = 3
    reference_n: int = 10_000


# Standard normal quantile of 0.975, the only one the published reports use.
Z_95 = 1.959963984540054
