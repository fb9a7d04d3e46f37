"""Fixed values that must equal the original pipeline's for identical results.

Everything here is a constant: column names of the survey table, display
names, stage thresholds and descriptions, band edges, colours, model settings
and report wording.  Logic lives elsewhere.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — survey table column names and roles
# ---------------------------------------------------------------------------
TARGET = "ckd_diagnosis"

DROP_COLUMNS = [
    "i_agree_that_this_data_may_be_used_for_research_purposes",
    "timestamp",
]

BINARY_YES_NO_COLUMNS = [
    "have_you_ever_been_diagnosed_with_diabetes",
    "do_you_have_high_blood_pressure_hypertension",
    "do_you_notice_foamy_urine",
    "do_you_take_extra_salt_with_your_food",
]

NUMERICAL_FEATURES = ["age", "hemoglobin"]

EXCLUDE_FROM_PREDICTION = ["egfr", "ckd_stage", "serum_creatinine"]

YES_NO_MAP = {"Yes": 1, "No": 0}
GENDER_MAP = {"Male": 1, "Female": 0}
LIVING_AREA_MAP = {"Urban": 1, "Rural": 0}

RANDOM_STATE = 42

# ---------------------------------------------------------------------------
# FIXED VALUES — display names of columns
# ---------------------------------------------------------------------------
DISPLAY_NAMES = {
    "Age": "Age",
    "Gender": "Gender",
    "have_you_ever_been_diagnosed_with_diabetes": "Diabetes",
    "do_you_have_high_blood_pressure_hypertension": "Hypertension",
    "do_you_notice_foamy_urine": "Foamy Urine",
    "do_you_take_extra_salt_with_your_food": "Extra Salt Intake",
    "serum_creatinine": "Serum Creatinine",
    "egfr": "eGFR",
    "hemoglobin": "Hemoglobin",
    "ckd_diagnosis": "CKD Diagnosis",
    "ckd_stage": "CKD Stage",
    "age": "Age",
    "gender": "Gender",
    "living_area": "Living Area",
    "does_anyone_in_your_family_have_chronic_kidney_disease_ckd": "Family CKD History",
    "have_you_experienced_swelling_in_feet_or_face_recently": "Swelling",
    "do_you_have_very_low_or_reduced_urine_output": "Low Urine Output",
    "do_you_smoke_or_take_guljarda": "Smoking/Guljarda",
    "do_you_use_painkillers_regularly_like_napa_voltaren_fenadin": "Regular Painkillers",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — kidney stages (lower eGFR bound, inclusive) and descriptions
# ---------------------------------------------------------------------------
STAGES = [
    # (stage, lower bound, description, colour)
    ("Stage 1", 90.0, "Normal or High", "#2ecc71"),
    ("Stage 2", 60.0, "Mildly Decreased", "#27ae60"),
    ("Stage 3a", 45.0, "Mild-Moderate Decrease", "#f1c40f"),
    ("Stage 3b", 30.0, "Moderate-Severe Decrease", "#e67e22"),
    ("Stage 4", 15.0, "Severely Decreased", "#e74c3c"),
    ("Stage 5", 0.0, "Kidney Failure", "#c0392b"),
]
STAGE_ORDER = [s[0] for s in STAGES]
STAGE_BOUNDARIES = [
    (90.0, "Stage 1/2"),
    (60.0, "Stage 2/3a"),
    (45.0, "Stage 3a/3b"),
    (30.0, "Stage 3b/4"),
    (15.0, "Stage 4/5"),
]
UNKNOWN_STAGE_DESCRIPTION = "Unknown"
DEFAULT_COLOUR = "#95a5a6"

# eGFR equation constants (no race term; the 1.012 female factor is absent in
# the original and exposed as a parameter defaulting to 1.0).
EGFR_CONST = 142.0
EGFR_AGE_BASE = 0.9938
EGFR_KAPPA_FEMALE = 0.7
EGFR_KAPPA_MALE = 0.9
EGFR_ALPHA_FEMALE = -0.241
EGFR_ALPHA_MALE = -0.302
EGFR_EXP_HIGH = -1.200

# ---------------------------------------------------------------------------
# FIXED VALUES — risk bands
# ---------------------------------------------------------------------------
BAND_ORDER = ["Low", "Medium", "High"]
# right-closed batch edges: (-0.01, 0.3], (0.3, 0.7], (0.7, 1.01]
BAND_EDGES_RIGHT_CLOSED = [-0.01, 0.3, 0.7, 1.01]
# left-closed single-row thresholds: < 0.3 Low, < 0.7 Medium, else High
BAND_LOW_MAX = 0.3
BAND_MEDIUM_MAX = 0.7
BAND_COLOURS = {"Low": "#2ecc71", "Medium": "#f39c12", "High": "#e74c3c"}
GAUGE_ZONES = [(0.0, 30.0, "#d5f5e3"), (30.0, 70.0, "#fdebd0"), (70.0, 100.0, "#fadbd8")]

# ---------------------------------------------------------------------------
# FIXED VALUES — age groups (right-closed edges, labels as published)
# ---------------------------------------------------------------------------
AGE_EDGES = [0, 30, 40, 50, 60, 70, 120]
AGE_LABELS = ["<30", "30-39", "40-49", "50-59", "60-69", "70+"]

# ---------------------------------------------------------------------------
# FIXED VALUES — split and evaluation settings
# ---------------------------------------------------------------------------
TEST_SIZE = 0.10
VAL_SIZE_OF_REST = 0.2222
SMOTE_RATIO = 0.6
SMOTE_K = 5
CV_FOLDS = 5
DECISION_THRESHOLD = 0.5
METRIC_DECIMALS = 4
MODEL_ORDER = ["LightGBM", "CatBoost", "XGBoost", "RandomForest", "Stacking"]
ENSEMBLE_NAME = "Stacking"

# ---------------------------------------------------------------------------
# FIXED VALUES — report wording
# ---------------------------------------------------------------------------
REPORT_RULE = "=" * 60
REPORT_TITLE = "       CKD RISK PREDICTION — PATIENT REPORT CARD"
REPORT_DISCLAIMER = [
    "  DISCLAIMER: This tool is for decision support only.",
    "  Not a replacement for medical diagnosis.",
]
NO_CKD_STAGE = "N/A"
NO_CKD_DESCRIPTION = "No CKD detected"
GUIDANCE_POSITIVE = [
    "Recommendation: Consider nephrology referral for further evaluation.",
    "Regular monitoring of kidney function (eGFR, serum creatinine) advised.",
    "Manage underlying conditions (diabetes, hypertension) if applicable.",
]
GUIDANCE_NEGATIVE = [
    "Recommendation: Continue routine health check-ups annually.",
    "Maintain healthy lifestyle — stay hydrated, limit salt intake.",
]
