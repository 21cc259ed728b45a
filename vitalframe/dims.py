"""Small dimension tables as literals: thresholds, panels, rules. Each is a list of plain rows, made a DataFrame on use.

Fixed values: thresholds, intervals, weights and test names are stated plainly, as results must agree with them; lists
marked as self-authored are our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# canonical_name, critical_low, critical_high.
CRITICAL = [
    ("glucose", 40.0, 500.0), ("potassium", 2.5, 6.5), ("sodium", 120.0, 160.0), ("hemoglobin", 5.0, 20.0), ("platelets", 20.0, 1000.0), ("wbc", 1.0, 50.0), ("calcium", 6.0, 14.0),
    ("inr", None, 5.0), ("troponin", None, 0.04), ("creatinine", None, 10.0), ("hba1c", None, 14.0), ("bilirubin_total", None, 15.0), ("alt", None, 1000.0), ("ast", None, 1000.0),
]

# canonical_name, percent change between two results that counts as rapid.
RAPID = [
    ("creatinine", 25.0), ("egfr", 20.0), ("hemoglobin", 20.0), ("platelets", 30.0), ("wbc", 40.0), ("alt", 50.0), ("ast", 50.0), ("tsh", 50.0), ("hba1c", 15.0), ("ldl", 25.0), ("ferritin", 40.0), ("potassium", 15.0), ("sodium", 5.0),
]

# Panel -> its tests.
PANELS = {
    "lipid_panel": ("cholesterol_total", "ldl", "hdl", "triglycerides"),
    "cmp": ("glucose", "bun", "creatinine", "sodium", "potassium", "chloride", "carbon_dioxide", "calcium", "total_protein", "albumin", "bilirubin_total", "alkaline_phosphatase", "ast", "alt"),
    "cbc": ("wbc", "rbc", "hemoglobin", "hematocrit", "platelets", "mcv", "mch", "mchc", "rdw"),
    "thyroid_panel": ("tsh", "free_t4", "free_t3"),
    "iron_studies": ("iron", "ferritin", "tibc", "transferrin"),
    "metabolic_diabetes": ("glucose", "hba1c"),
    "liver_panel": ("alt", "ast", "alkaline_phosphatase", "bilirubin_total", "albumin"),
    "kidney_panel": ("bun", "creatinine", "egfr"),
}

# Test whose abnormal result asks for companion tests -> these.
CONDITIONAL = {
    "ferritin": ("iron", "tibc", "transferrin", "hemoglobin", "mcv", "rdw"),
    "hba1c": ("glucose", "creatinine", "egfr", "albumin"),
    "tsh": ("free_t3", "free_t4"),
    "alt": ("ast", "alkaline_phosphatase", "bilirubin_total", "albumin"),
    "creatinine": ("bun", "egfr", "potassium", "calcium"),
    "hemoglobin": ("iron", "ferritin", "vitamin_b12", "folate", "mcv", "rdw"),
    "vitamin_d": ("calcium", "phosphorus", "magnesium"),
}

# Self-authored: pattern, test, direction, must it hold (else it adds to the confidence), confidence it adds.
PATTERNS = [
    ("iron_deficiency", "ferritin", "low", True, 0.5), ("iron_deficiency", "hemoglobin", "low", False, 0.2), ("iron_deficiency", "mcv", "low", False, 0.15), ("iron_deficiency", "transferrin", "high", False, 0.1),
    ("hypothyroid", "tsh", "high", True, 0.55), ("hypothyroid", "free_t4", "low", False, 0.25), ("hypothyroid", "cholesterol_total", "high", False, 0.1),
    ("insulin_resistance", "glucose", "high", True, 0.4), ("insulin_resistance", "insulin", "high", False, 0.2), ("insulin_resistance", "triglycerides", "high", False, 0.15), ("insulin_resistance", "hdl", "low", False, 0.1),
    ("kidney_decline", "creatinine", "high", True, 0.45), ("kidney_decline", "egfr", "low", False, 0.3), ("kidney_decline", "bun", "high", False, 0.15),
    ("liver_stress", "alt", "high", True, 0.4), ("liver_stress", "ast", "high", False, 0.2), ("liver_stress", "ggt", "high", False, 0.2), ("inflammation", "crp", "high", True, 0.5), ("inflammation", "esr", "high", False, 0.25),
]
PATTERN_CAP = 0.95

# canonical_name, months of 30 days between tests.
INTERVALS = [
    ("glucose", 12), ("hba1c", 6), ("cholesterol_total", 12), ("ldl", 12), ("hdl", 12), ("triglycerides", 12), ("hemoglobin", 12), ("wbc", 12), ("platelets", 12), ("tsh", 12), ("vitamin_d", 12),
    ("vitamin_b12", 12), ("creatinine", 12), ("egfr", 12), ("alt", 12), ("ast", 12), ("iron", 12), ("ferritin", 12), ("psa", 12), ("bun", 12), ("calcium", 12),
]

# Domain -> (weight, its tests).
DOMAINS = {
    "metabolic": (1.0, ("glucose", "hba1c", "bun", "creatinine", "egfr")),
    "cardiovascular": (1.0, ("cholesterol_total", "ldl", "hdl", "triglycerides")),
    "blood": (0.8, ("hemoglobin", "hematocrit", "wbc", "platelets", "rbc")),
    "liver": (0.8, ("alt", "ast", "alkaline_phosphatase", "bilirubin_total", "albumin")),
    "thyroid": (0.7, ("tsh", "free_t4", "free_t3")),
    "nutrition": (0.6, ("vitamin_d", "vitamin_b12", "folate", "iron", "ferritin")),
    "inflammation": (0.5, ("crp", "esr")),
}

# Drug or class (lower case), test it acts on, direction wanted.
DRUG_TESTS = [
    ("statin", "ldl", "decrease"), ("statin", "cholesterol_total", "decrease"), ("statin", "triglycerides", "decrease"), ("metformin", "hba1c", "decrease"), ("metformin", "glucose", "decrease"), ("levothyroxine", "tsh", "decrease"), ("ace_inhibitor", "creatinine", "increase"),
    ("arb", "creatinine", "increase"), ("vitamin_d", "vitamin_d", "increase"), ("iron", "ferritin", "increase"), ("iron", "hemoglobin", "increase"), ("vitamin_b12", "vitamin_b12", "increase"), ("calcium", "calcium", "increase"),
]
# Self-authored: the invented drugs of the test tables and what they act on.
DRUG_TESTS += [
    ("glucanorm", "glucose", "decrease"), ("glucanorm", "hba1c", "decrease"), ("omevastat", "ldl", "decrease"), ("omevastat", "cholesterol_total", "decrease"), ("thyrolan", "tsh", "decrease"), ("ferrovit", "ferritin", "increase"), ("ferrovit", "hemoglobin", "increase"), ("pressolol", "potassium", "increase"), ("levanoril", "creatinine", "increase"),
]

# Self-authored: pairs of substances with the severity of their interaction.
INTERACTIONS = [
    ("levanoril", "pressolol", "moderate", "low pressure"), ("omevastat", "cardexine", "major", "muscle damage"), ("thyrolan", "ferrovit", "moderate", "less absorption"), ("glucanorm", "cardexine", "minor", "low glucose"), ("calmidine", "dormivane", "major", "sedation"), ("zelprazine", "calmidine", "moderate", "sedation"),
    ("warfarin", "aspirin", "major", "bleeding"), ("warfarin", "ibuprofen", "major", "bleeding"), ("lisinopril", "potassium", "moderate", "high potassium"), ("simvastatin", "amlodipine", "moderate", "muscle pain"),
    ("levothyroxine", "iron", "moderate", "less absorption"), ("metformin", "prednisone", "moderate", "higher glucose"), ("sertraline", "tramadol", "major", "serotonin"), ("atorvastatin", "amlodipine", "minor", "higher level"), ("omeprazole", "levothyroxine", "minor", "less absorption"), ("ibuprofen", "lisinopril", "moderate", "kidney"),
]
SEVERITY = {"contraindicated": 0, "major": 1, "moderate": 2, "minor": 3}

# Metric, rule ('pct_below', 'pct_above', 'below', 'above'), bound, severity.
ANOMALIES = [("sleep_score", "below", 40.0, "urgent"), ("hrv", "pct_below", 30.0, "urgent"), ("rhr", "pct_above", 15.0, "watch"), ("spo2", "below", 92.0, "urgent"), ("recovery_score", "below", 20.0, "watch")]

# Weights of the readiness components, grades by least score, and normal shares of sleep stages in percent.
READINESS = {"hrv": 0.30, "rhr": 0.20, "sleep": 0.25, "recovery": 0.15, "strain": 0.10}
READINESS_GRADES = [("peak", 80.0), ("ready", 60.0), ("moderate", 40.0)]
SLEEP_NORMS = {"rem": (15.0, 30.0), "deep": (15.0, 30.0)}
LIGHT_MOST = 65.0

# Wearable metrics that trends and correlations are taken of.
WEARABLE_METRICS = ("hrv", "rhr", "resp_rate", "sleep_score", "recovery_score", "strain", "sleep_duration_min", "spo2")

# Self-authored: symptom categories in order with their patterns, after the words of the test texts; the first that matches
# counts. So are the words for severity and emergencies.
CATEGORIES = [
    ("headache", r"headache|migraine|temples"), ("chest", r"chest|palpitation"), ("breathing", r"short of breath|wheez|breath"), ("stomach", r"nausea|stomach|bloat|cramp"), ("pain", r"pain|sore|stiff|ache"),
    ("skin", r"rash|hives|itch|dry patch"), ("fatigue", r"tired|wiped out|low energy|fatigue"), ("sleep", r"woke|asleep|restless|insomnia"), ("mood", r"anxious|mood|irritable|flat"),
]
SEVERITIES = [("severe", r"severe|terrible|worst|unbearable"), ("moderate", r"moderate|medium|quite"), ("mild", r"mild|slight|little")]
EMERGENCIES = [("chest_pain", r"chest pain|tight chest"), ("breathing", r"can.?t breathe|short of breath"), ("stroke", r"slurred|face droop|one side"), ("suicide", r"suicid|kill myself"), ("anaphylaxis", r"throat (is )?(closing|swelling)|anaphyla"), ("bleeding", r"won.?t stop bleeding|heavy bleeding"), ("faint", r"faint|passed out|unconscious"), ("seizure", r"seizure|convulsion")]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension as a DataFrame of a few rows; it may be broadcast."""
    from pyspark.sql import functions as F

    return F.broadcast(spark.createDataFrame(rows, schema))


def values(rows: list[tuple], name: str, columns: str) -> str:
    """A dimension as a SQL relation."""

    def cell(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(cell(x) for x in r) + ')' for r in rows)}) {name}({columns})"
