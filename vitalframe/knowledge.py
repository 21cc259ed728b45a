"""Rules that analyses join to, as plain rows. Fixed values are facts that results must agree with; lists marked as
self-authored are our own."""

from __future__ import annotations

# canonical_name, age from, age to, low, high, of everyone.
AGE_RANGES = [
    ("testosterone_total", 18, 25, 270.0, 1070.0), ("testosterone_total", 26, 35, 260.0, 1000.0), ("testosterone_total", 36, 45, 230.0, 930.0), ("testosterone_total", 46, 55, 210.0, 890.0), ("testosterone_total", 56, 65, 196.0, 859.0),
    ("egfr", 18, 29, 100.0, 999.0), ("egfr", 30, 39, 95.0, 999.0), ("egfr", 40, 49, 90.0, 999.0), ("egfr", 50, 59, 80.0, 999.0), ("egfr", 60, 69, 70.0, 999.0),
    ("bun", 0, 12, 5.0, 18.0), ("bun", 13, 120, 7.0, 20.0), ("esr", 18, 30, 0.0, 15.0), ("esr", 31, 50, 0.0, 20.0), ("esr", 51, 70, 0.0, 30.0), ("esr", 71, 120, 0.0, 35.0),
    ("alkaline_phosphatase", 0, 12, 100.0, 400.0), ("alkaline_phosphatase", 13, 17, 50.0, 500.0), ("alkaline_phosphatase", 18, 120, 44.0, 147.0),
    ("creatinine", 0, 12, 0.2, 0.5), ("creatinine", 13, 17, 0.3, 0.7), ("creatinine", 18, 64, 0.7, 1.3), ("creatinine", 65, 120, 0.7, 1.5),
    ("hemoglobin", 0, 12, 11.5, 15.5), ("hemoglobin", 13, 17, 12.0, 16.0), ("hemoglobin", 18, 120, 13.5, 17.5), ("ferritin", 18, 39, 12.0, 300.0), ("ferritin", 40, 120, 12.0, 400.0),
    ("cholesterol_total", 18, 120, 0.0, 200.0), ("hba1c", 18, 120, 4.0, 5.7), ("vitamin_d", 18, 120, 30.0, 100.0), ("tsh", 18, 64, 0.4, 4.0), ("tsh", 65, 120, 0.4, 5.5),
]
# The same of women, which come first.
FEMALE_AGE_RANGES = [("hemoglobin", 13, 120, 12.0, 16.0), ("ferritin", 18, 50, 12.0, 150.0), ("ferritin", 51, 120, 12.0, 300.0), ("esr", 18, 30, 0.0, 20.0), ("esr", 31, 50, 0.0, 30.0), ("esr", 51, 70, 0.0, 40.0), ("esr", 71, 120, 0.0, 45.0)]
# Of women whose age is not known.
FEMALE_RANGES = [("hemoglobin", 12.0, 16.0), ("hematocrit", 36.0, 44.0), ("rbc", 4.0, 5.0), ("ferritin", 12.0, 150.0), ("iron", 50.0, 170.0), ("esr", 0.0, 30.0), ("uric_acid", 2.5, 6.0), ("testosterone_total", 15.0, 70.0), ("creatine_kinase", 25.0, 170.0)]
# Ethnicity, canonical_name, low, high.
ETHNIC_RANGES = [("black", "hemoglobin", 12.0, 17.0), ("black", "vitamin_d", 20.0, 100.0)]

# canonical_name, state, weeks from and to which the test should be done again, urgent.
RETESTS = [
    ("tsh", "high", 6, 8, False), ("tsh", "low", 4, 6, False), ("alt", "high", 4, 8, False), ("ast", "high", 4, 8, False), ("hba1c", "high", 12, 12, False), ("glucose", "high", 4, 8, False), ("potassium", "high", 1, 2, True), ("potassium", "low", 1, 2, True), ("sodium", "low", 1, 2, True), ("sodium", "high", 1, 2, True),
    ("vitamin_d", "low", 8, 12, False), ("ferritin", "low", 8, 12, False), ("vitamin_b12", "low", 8, 12, False), ("iron", "low", 8, 12, False), ("creatinine", "high", 4, 8, False), ("egfr", "low", 4, 12, False), ("ldl", "high", 8, 12, False), ("triglycerides", "high", 8, 12, False), ("uric_acid", "high", 4, 8, False), ("hemoglobin", "low", 4, 8, False),
]
# Screening, age from, age to (0: no end), sex, months between (0: once), test that counts as it.
SCREENINGS = [
    ("colonoscopy", 45, 75, "any", 120, None), ("mammogram", 40, 74, "female", 24, None), ("cervical", 21, 65, "female", 36, None), ("psa", 55, 69, "male", 24, "psa"), ("lung_ct", 50, 80, "any", 12, None), ("bone_density", 65, 0, "female", 24, None),
    ("diabetes", 35, 70, "any", 36, "hba1c"), ("lipids", 40, 75, "any", 60, "ldl"), ("hepatitis_c", 18, 79, "any", 0, None), ("aortic_ultrasound", 65, 75, "male", 0, None), ("skin", 35, 0, "any", 12, None),
]
# Conditions that act on each other, and how much it matters.
COMORBIDITIES = [
    ("hypothyroidism", "hyperlipidemia", "high"), ("diabetes", "hypertension", "high"), ("chronic kidney disease", "anemia", "high"), ("iron deficiency", "hypothyroidism", "high"), ("diabetes", "liver disease", "medium"), ("obesity", "hypertension", "high"), ("diabetes", "chronic kidney disease", "high"), ("hypothyroidism", "depression", "medium"),
    ("vitamin d deficiency", "osteoporosis", "high"), ("gout", "chronic kidney disease", "high"), ("hypertension", "chronic kidney disease", "high"), ("insulin resistance", "polycystic ovary syndrome", "high"), ("anemia", "heart failure", "high"), ("sleep apnea", "hypertension", "high"), ("diabetes", "depression", "medium"), ("hypothyroidism", "anemia", "medium"), ("magnesium deficiency", "hypertension", "medium"),
]
# Condition, test, months between.
CONDITION_LABS = [
    ("diabetes", "hba1c", 3), ("diabetes", "glucose", 3), ("diabetes", "creatinine", 6), ("diabetes", "egfr", 6), ("diabetes", "cholesterol_total", 12), ("diabetes", "ldl", 12), ("hypothyroidism", "tsh", 6), ("hypothyroidism", "free_t4", 6), ("hyperlipidemia", "cholesterol_total", 6), ("hyperlipidemia", "ldl", 6), ("hyperlipidemia", "hdl", 6), ("hyperlipidemia", "triglycerides", 6),
    ("chronic kidney disease", "creatinine", 3), ("chronic kidney disease", "egfr", 3), ("chronic kidney disease", "potassium", 6), ("chronic kidney disease", "calcium", 6), ("chronic kidney disease", "phosphorus", 6), ("chronic kidney disease", "hemoglobin", 6), ("anemia", "hemoglobin", 3), ("anemia", "iron", 3), ("anemia", "ferritin", 3), ("anemia", "vitamin_b12", 6), ("anemia", "folate", 6),
    ("iron deficiency", "ferritin", 3), ("iron deficiency", "iron", 3), ("iron deficiency", "hemoglobin", 3), ("liver disease", "alt", 3), ("liver disease", "ast", 3), ("liver disease", "albumin", 6), ("liver disease", "bilirubin_total", 6), ("gout", "uric_acid", 6), ("gout", "creatinine", 12), ("vitamin d deficiency", "vitamin_d", 6), ("vitamin d deficiency", "calcium", 12),
]
# Class of drugs, test, months between.
DRUG_LABS = [("statin", "alt", 6), ("statin", "ast", 6), ("statin", "creatine_kinase", 12), ("metformin", "vitamin_b12", 12), ("metformin", "creatinine", 12), ("ace_inhibitor", "potassium", 6), ("ace_inhibitor", "creatinine", 6), ("arb", "potassium", 6), ("arb", "creatinine", 6), ("thiazide", "potassium", 6), ("thiazide", "sodium", 6), ("thiazide", "glucose", 12), ("corticosteroid", "glucose", 6), ("corticosteroid", "calcium", 12), ("corticosteroid", "vitamin_d", 12), ("lithium", "tsh", 6), ("lithium", "creatinine", 6)]
# Class of drugs, side effect, test, state that shows it.
SIDE_EFFECTS = [
    ("statin", "liver enzyme elevation", "alt", "high"), ("statin", "muscle pain", "creatine_kinase", "high"), ("ace_inhibitor", "hyperkalemia", "potassium", "high"), ("ace_inhibitor", "acute kidney injury", "creatinine", "high"), ("arb", "hyperkalemia", "potassium", "high"), ("metformin", "B12 deficiency", "vitamin_b12", "low"), ("metformin", "lactic acidosis", "creatinine", "high"),
    ("ppi", "magnesium depletion", "magnesium", "low"), ("ppi", "B12 malabsorption", "vitamin_b12", "low"), ("ssri", "hyponatremia", "sodium", "low"), ("ssri", "bleeding risk", "platelets", "low"), ("thiazide", "hyponatremia", "sodium", "low"), ("thiazide", "hypokalemia", "potassium", "low"), ("corticosteroid", "hyperglycemia", "glucose", "high"), ("corticosteroid", "osteoporosis risk", "calcium", "low"),
    ("lithium", "hypothyroidism", "tsh", "high"), ("lithium", "nephrotoxicity", "creatinine", "high"), ("beta_blocker", "hyperglycemia masking", "glucose", "high"),
]
# Test, deficient below, insufficient below.
SUPPLEMENTS = [("vitamin_d", 20.0, 30.0), ("vitamin_b12", 200.0, 400.0), ("ferritin", 15.0, 30.0), ("folate", 3.0, 5.0), ("magnesium", 1.5, 1.8), ("zinc", 60.0, 70.0)]
# Metric, direction that is bad, weight, least change in percent; and the levels by least score.
STRESS = [("hrv", -1, 0.30, 10.0), ("rhr", 1, 0.25, 8.0), ("sleep_score", -1, 0.20, 10.0), ("recovery_score", -1, 0.15, 15.0), ("skin_temp", 1, 0.10, 5.0)]
STRESS_LEVELS = [("critical", 0.7), ("high", 0.45), ("moderate", 0.2)]
# Texts of a qualitative result that tell it is abnormal.
ABNORMAL_TEXTS = ("detected", "positive", "reactive", "mutation detected", "heterozygous", "homozygous")
# What of the averages of the newest nights is a deficit.
SLEEP_DEFICITS = [("deep_low", "deep_pct", "below", 15.0), ("rem_low", "rem_pct", "below", 15.0), ("duration_low", "sleep_duration_min", "below", 420.0), ("efficiency_low", "sleep_efficiency_pct", "below", 85.0), ("latency_high", "sleep_latency_min", "above", 20.0)]

# Self-authored: what the invented drugs of the test tables act as.
DRUG_CLASSES = [("omevastat", "statin"), ("glucanorm", "metformin"), ("levanoril", "ace_inhibitor"), ("pressolol", "beta_blocker"), ("zelprazine", "ppi"), ("calmidine", "ssri"), ("metrovase", "thiazide"), ("respirane", "corticosteroid")]
# Self-authored: state of the latest result of a test that stands for a condition.
LAB_CONDITIONS = [("glucose", "high", "diabetes"), ("hba1c", "high", "diabetes"), ("tsh", "high", "hypothyroidism"), ("ldl", "high", "hyperlipidemia"), ("cholesterol_total", "high", "hyperlipidemia"), ("creatinine", "high", "chronic kidney disease"), ("hemoglobin", "low", "anemia"), ("ferritin", "low", "iron deficiency"), ("alt", "high", "liver disease"), ("uric_acid", "high", "gout"), ("vitamin_d", "low", "vitamin d deficiency"), ("magnesium", "low", "magnesium deficiency")]
# Self-authored: drug, enzyme, role; and drug, pathway, effect.
DRUG_ENZYMES = [("omevastat", "CYP3A4", "substrate"), ("cardexine", "CYP3A4", "inhibitor"), ("calmidine", "CYP2D6", "inhibitor"), ("pressolol", "CYP2D6", "substrate"), ("dormivane", "CYP3A4", "inducer"), ("zelprazine", "CYP2C19", "inhibitor"), ("metrovase", "CYP3A4", "substrate"), ("thyrolan", "UGT1A1", "inducer"), ("levanoril", "CYP2C9", "substrate")]
DRUG_PATHWAYS = [("calmidine", "serotonin", 1), ("dormivane", "gaba", 1), ("zelprazine", "gaba", 1), ("cardexine", "heart_rate", -1), ("pressolol", "heart_rate", -1), ("levanoril", "pressure", -1), ("metrovase", "pressure", -1), ("pressolol", "pressure", -1), ("glucanorm", "glucose", -1)]
HIGH_RISK_PATHWAYS = ("serotonin", "gaba", "heart_rate", "qt", "bleeding")
# Severity of a conflict of roles at one enzyme; other pairs are minor.
ROLE_CONFLICTS = [("inducer", "substrate", "moderate"), ("substrate", "inducer", "moderate"), ("inhibitor", "substrate", "major"), ("substrate", "inhibitor", "major"), ("inducer", "inhibitor", "moderate"), ("inhibitor", "inducer", "moderate")]

# Self-authored: rsid, gene, genotype, risk, condition, test it acts on, pathway.
SNP_RULES = [
    ("rs3892097", "CYP2D6", "AA", "elevated", "slow CYP2D6", None, "pharmacogenomics"), ("rs3892097", "CYP2D6", "AG", "moderate", "slow CYP2D6", None, "pharmacogenomics"), ("rs4244285", "CYP2C19", "AA", "elevated", "slow CYP2C19", None, "pharmacogenomics"), ("rs4244285", "CYP2C19", "AG", "carrier", "slow CYP2C19", None, "pharmacogenomics"),
    ("rs1799853", "CYP2C9", "TT", "elevated", "slow CYP2C9", None, "pharmacogenomics"), ("rs4149056", "SLCO1B1", "CC", "elevated", "statin transport", "creatine_kinase", "pharmacogenomics"), ("rs4149056", "SLCO1B1", "CT", "moderate", "statin transport", "creatine_kinase", "pharmacogenomics"),
    ("rs1801133", "MTHFR", "TT", "elevated", "folate cycle", "homocysteine", "methylation"), ("rs1801133", "MTHFR", "CT", "moderate", "folate cycle", "homocysteine", "methylation"), ("rs4680", "COMT", "AA", "moderate", "slow COMT", None, "methylation"), ("rs1800562", "HFE", "AA", "elevated", "iron overload", "ferritin", "iron_homeostasis"), ("rs1800562", "HFE", "AG", "carrier", "iron overload", "ferritin", "iron_homeostasis"), ("rs429358", "APOE", "CC", "elevated", "lipids", "ldl", "cardiovascular"), ("rs429358", "APOE", "CT", "moderate", "lipids", "ldl", "cardiovascular"),
]
# Order of risks, what they mean for an enzyme, and enzymes with their variants.
RISK_ORDER = [("elevated", 0), ("moderate", 1), ("carrier", 2), ("protective", 3)]
RISK_STATUS = [("elevated", "poor", 2), ("moderate", "intermediate", 1), ("carrier", "intermediate", 1)]
ENZYME_SNPS = [("CYP2D6", "rs3892097"), ("CYP2C19", "rs4244285"), ("CYP2C9", "rs1799853"), ("CYP2C9", "rs1057910"), ("VKORC1", "rs9923231"), ("SLCO1B1", "rs4149056"), ("DPYD", "rs3918290"), ("UGT1A1", "rs8175347"), ("NAT2", "rs1801280"), ("TPMT", "rs1800460"), ("CYP3A4", "rs35599367")]
# Self-authored: drugs of the test tables that an enzyme breaks down.
ENZYME_DRUGS = [("CYP2D6", "pressolol"), ("CYP2D6", "calmidine"), ("CYP2C19", "zelprazine"), ("CYP2C9", "levanoril"), ("SLCO1B1", "omevastat"), ("CYP3A4", "metrovase")]
# Self-authored: genotypes of some users of the test tables, which have no table of genotypes.
GENOTYPES = [
    (1001, "rs3892097", "ag"), (1001, "rs4149056", "CC"), (1001, "rs1801133", "TT"), (1001, "rs4680", "AA"), (10001, "rs4244285", "AA"), (10001, "rs429358", "CT"), (10001, "rs1801133", "CC"), (10002, "rs1799853", "TT"), (10002, "rs1800562", "AG"), (10003, "rs4149056", "CT"), (10003, "rs429358", "CC"),
    (10007, "rs3892097", "AA"), (10010, "rs1801133", "CT"), (10057, "rs4244285", "AG"), (10088, "rs1800562", "AA"), (10088, "rs4680", "GG"),
]
# Self-authored: aims that are followed for every user who has the test.
GOALS = [("ldl", 100.0, "below"), ("hba1c", 5.7, "below"), ("vitamin_d", 40.0, "above"), ("hdl", 50.0, "above")]

# Words of a text -> the condition they name.
CONDITION_WORDS = [
    ("iron deficiency", "iron deficiency"), ("b12 deficiency", "vitamin B12 deficiency"), ("vitamin b12", "vitamin B12 deficiency"), ("hypothyroidism", "hypothyroidism"), ("hyperthyroidism", "hyperthyroidism"), ("prediabetes", "prediabetes"), ("diabetes", "diabetes"), ("metabolic syndrome", "metabolic syndrome"), ("kidney disease", "chronic kidney disease"), ("liver inflammation", "hepatitis"),
    ("vitamin d deficiency", "vitamin D deficiency"), ("hemochromatosis", "hemochromatosis"), ("polycythemia", "polycythemia"), ("chronic inflammation", "chronic inflammation"), ("folate deficiency", "folate deficiency"), ("hyperuricemia", "gout"), ("dyslipidemia", "dyslipidemia"), ("anemia", "anemia"), ("hypertension", "hypertension"), ("high blood pressure", "hypertension"), ("heart disease", "cardiovascular disease"), ("hashimoto", "hashimoto thyroiditis"), ("graves", "graves disease"),
]
# Weeks after which a test that pauses a reminder is done again; others 26.
PAUSE_WEEKS = [("tsh", 26), ("hba1c", 12), ("inr", 4), ("lithium", 12), ("vitamin_d", 12), ("iron", 12), ("ferritin", 12), ("vitamin_b12", 26), ("potassium", 4), ("creatinine", 12), ("alt", 12), ("ast", 12), ("estradiol", 12), ("prolactin", 12)]
PAUSE_WEEKS_ELSE = 26
# Self-authored: relatives whose mention makes a condition one of the family.
RELATIVES = r"\b(mother|father|brother|sister|parents?|grandmother|grandfather|aunt|uncle|family history|runs in (my|the) family)\b"
