"""Fixed values of the screening protocol: names, word lists, patterns and labels.

Everything here is data that a result must agree with exactly. None of it is logic; every operator takes these
lists as default arguments and accepts others.
"""

from __future__ import annotations

from dosescreen.functions.rules import Rule

# Assay channels and their matrix columns
ESTRADIOL = "Estradiol"
PROGESTERONE = "Progesterone"
CHANNELS = [ESTRADIOL, PROGESTERONE]
MATRIX_COLUMNS = {
    "CEETOX_H295R_ESTRADIOL_up": ESTRADIOL,
    "CEETOX_H295R_PROG_up": PROGESTERONE,
}
DOSE_SLOTS = 6
NOT_ACTIVE = 1000000.0
NON_DETECTS = ["ND", "NQ"]
CONTROL_SAMPLE = "DMSO"

# Plate dates that are written in another format
DATE_CORRECTIONS = {
    "04112017": "11Apr2011",
    "20130320": "20Mar2013",
    "20130321": "21Mar2013",
}

# Substance names that differ between two sources (pattern, replacement for the whole name)
NAME_CORRECTIONS = [
    ("Bromo-3-chloro-5,5-dimethylhydantoin", "1-Bromo-3-chloro-5,5-dimethylhydantoin"),
    ("Terbuthylazine", "Terbutylazine"),
]
NAME_WITHOUT_UNDERSCORE = "PharmaGSID_"

# Potency filter and clusters
MIN_FOLD_CHANGE = 1.5
MIN_DISTANCE = 0.0
MAX_EFFECTIVE_CONC = 33.0
CLUSTERS = [(0.25, "higher"), (0.75, "intermediate"), (None, "lower")]
BIOACTIVITY_CUTS = [(0.1, "(active)"), (0.01, "(ambiguous)")]

# Identifiers of hormones that are substrates of the assay itself
HORMONE_IDS = [
    "53-16-7", "474-86-2", "50-27-1", "57-85-2", "57-83-0", "57-63-6", "58-18-4",
    "521-18-6", "53-41-8", "68-96-2", "63-05-8", "53-43-0", "50-28-2", "57-91-0",
]

# Short display names
SYNONYMS = {
    "2,2-Bis(4-hydroxyphenyl)-1,1,1-trichloroethane": "HPTE",
    "3,3,5-Trimethylcyclohexyl salicylate": "Homosalate",
    "3,3',5,5'-Tetrabromobisphenol A": "3,3',5,5'-TBBPA",
    "Pentachlorophenol": "PCP",
    "Triphenyl phosphate": "TPhP",
    "Di(2-ethylhexyl) phthalate": "DEHP",
    "7,12-Dimethylbenz(a)anthracene": "DMBA",
    "2-Hydroxy-4-methoxybenzophenone": "BP-3",
    "3,3'-Dimethoxybenzidine": "o-Dianisidine",
    "3,3'-Dimethylbenzidine": "2-Tolidine",
    "4,4'-Sulfonylbis[2-(prop-2-en-1-yl)phenol]": "TGSA",
    "1,4-Bis(butylamino)anthracene-9,10-dione": "Oil Blue 35",
    "(+/-)-cis-Permethrin": "cis-Permethrin",
    "(E)-beta-Damascone": "Damascone beta",
    "17-Methyltestosterone": "Methyltestosterone",
    "2-Amino-5-azotoluene": "Solvent Yellow 3",
    "2-Hydroxyethyl acrylate": "2-HEA",
    "2-Methoxy-5-methylaniline": "p-cresidine",
    "2,2-Dibromo-3-nitrilopropionamide": "DBNPA",
    "4-Chloro-2-methylaniline": "4-COT",
    "4-Chloro-2-methylphenol": "4-Chloro-o-cresol",
    "4-Methoxyaniline hydrochloride": "p-Anisidinium chloride",
    "4,4'-Sulfonyldiphenol": "Bisphenol S",
    "all-trans-Retinoic acid": "Tretinoin",
    "Tri-o-cresyl phosphate": "TOCP",
    "3,3'-Dimethoxybenzidine dihydrochloride": "o-Dianisidine dihydrochloride",
    "4-Chloro-3-methylphenol": "4-Chloro-m-cresol",
    "Nordihydroguaiaretic acid": "NDGA",
    "4-(Butan-2-yl)phenol": "4-sec-Butylphenol",
    "2-Ethoxy-5-(1-propenyl)phenol": "Vanitrope",
    "5-Chloro-2-methyl-3(2H)-isothiazolone": "MCI",
    "N-Phenyl-2-naphthylamine": "Neozone",
    "Azinphos-methyl": "Gusathion",
    "Methyl 2,4-dihydroxy-3,6-dimethylbenzoate": "Methyl 3-methylorsellinate",
    "Bisphenol A": "BPA",
    "10-Undecenoic acid": "Undecylenic acid",
    "17alpha-Ethinylestradiol": "Ethinyl estradiol",
    "2-Naphthalenol": "2-Naphthol",
    "2,4-D 1-butyl ester": "2,4-D Butyl ester",
    "3-Phenyl-2-propen-1-ol": "Cinnamyl alcohol",
    "3,3'-Dimethylbenzidine dihydrochloride": "o-Tolidine dihydrochloride",
    "4-(2-Methylbutan-2-yl)phenol": "p-tert-Pentylphenol",
    "5-Amino-2-methylphenol": "5-Amino-o-cresol",
    "5,7-Dimethoxy-2H-chromen-2-one": "5,7-Dimethoxycoumarin",
    "Diethylstilbestrol": "DES",
    "4-(2-Phenylpropan-2-yl)-N-[4-(2-phenylpropan-2-yl)phenyl]aniline":
        "4-(2-Phenylpropan-2-yl)-N-\n[4-(2-phenylpropan-2-yl)phenyl]aniline",
}

# Abbreviations inside names (regular expression, replacement)
ABBREVIATIONS = [
    ("C.I. ", ""),
    ("Dichlorophenol", "DCP"),
    ("Trichlorophenol", "TCP"),
    ("Tribromophenol", "TBP"),
    ("Dinitrotoluene", "DNT"),
    ("Dimethylphenol", "xylenol"),
]

# Name parts of drug candidates that were given up
DRUG_CANDIDATE = "UK-|CP-|Pharma|GSK|MK-|CI-|SSR|PD-|FR|CJ-|SAR|PD |AVE|PK|HMR"

# Catalogue rules. A record's source decides first, then the first term of its path, then the path.
BANNED_PATH = "discontinued|prohibited|restricted"
SOURCE_RULES = [
    Rule("source", "Industrial", "ind."),
    Rule("source", "NACE", "ind."),
    Rule("source", "Retail", "cons.", "cassette", "food|beverage"),
    Rule("source", "Drug", "pharma."),
    Rule("source", "DfE", "functional"),
    Rule("source", "Dow", "functional"),
    Rule("source", "Kem", "functional"),
    Rule("source", "Toxome", "functional"),
    Rule("source", "Functional", "functional"),
]
TERM_RULES = [
    Rule("split", "pesticide", "pest."),
    Rule("split", "herbicide", "pest."),
    Rule("split", "extermination", "pest."),
    Rule("split", "fungicide", "pest."),
    Rule("split", "antimicrobial", "pest."),
    Rule("split", "drug", "pharma."),
    Rule("split", "food", "diet"),
    Rule("split", "beverage", "diet"),
    Rule("split", "drinking_water", "diet"),
]
CONSUMER_TERM = "consumer_use"
CONSUMER_LABEL = "cons."
CONSUMER_JOINED = ["pest.", "pharma", "diet."]
CONSUMER_SEPARATOR = " ,"
PATH_RULES = [
    Rule("cassette", "apparel", "cons.", "fromsource", "ind."),
    Rule("cassette3", "personal_care", "cons."),
    Rule("cassette3", "arts_crafts", "cons."),
    Rule("cassette", "furniture", "cons.", "fromsource", "ind."),
    Rule("cassette3", "child_use", "cons."),
    Rule("cassette3", "decor", "cons."),
    Rule("cassette3", "toy", "cons."),
    Rule("cassette3", "electronics", "cons."),
    Rule("cassette3", "lawn_garden", "cons."),
    Rule("cassette3", "sports_equipment", "cons."),
    Rule("cassette3", "baby_use", "cons."),
    Rule("cassette3", "pet", "cons."),
    Rule("cassette3", "tools|personal_care|dental|toothbrush|detected", "cons."),
    Rule("cassette3", "cleaning_washing", "cons."),
    Rule("cassette3", "industrial", "ind."),
    Rule("cassette3", "raw_material", "ind."),
    Rule("cassette3", "industrial_manufacturing", "ind."),
    Rule("cassette3", "industrial_fluid", "ind."),
    Rule("cassette3", "mining", "ind."),
    Rule("cassette3", "manufacturing", "ind."),
    Rule("cassette3", "resource_extraction", "ind."),
    Rule("cassette3", "rubber_processing", "ind."),
    Rule("cassette3", "soap", "cons."),
    Rule("cassette3", "disinfectant", "pest."),
    Rule("cassette", "automotive_care", "cons.", "fromsource", "ind."),
]
# (pattern in the path, label to append, labels that already cover it, earlier labels that rule it out)
PATH_APPENDS = [
    ("food|beverage", "diet", ["diet", "ind."], ["ind."]),
    ("extermination", "pest.", [], []),
    ("disinfectant", "pest.", ["disinfectant", "pest.", "feed"], []),
]

# Product use rules
PRODUCT_RULES = [
    Rule("product_use_category", "pesticide", "pest., cons."),
    Rule("product_use_category", "herbicide", "pest., cons."),
]
PRODUCT_DEFAULT = "cons."

# Columns that flag a broad category and the pattern that fills them; predicted pathways
BROAD_FLAGS = {
    "Cons.": "Cons",
    "Diet": "Diet|Drinking",
    "Ind.": "Ind.",
    "Pharma.": "Pharma.",
    "Pest.": "Pest.",
}
UNCATEGORISED = "Uncategorized Use"
NO_INFORMATION = "No Toxcast Info."
PREDICTED_FLAGS = {
    "Cons.": "Cons",
    "Diet": "Diet",
    "Pest.": "Pest",
    "Ind.": "Ind.",
}
ALL_PATHWAYS = {"All Four": "Cons., Ind., Pest., Diet."}
UNKNOWN_PATHWAY = "Unknown"
PREDICTED = "1*"

# Specific uses in catalogue paths
USE_RULES = [
    Rule("term1", "personal_care", "pers."),
    Rule("cassette", "fragrance", "fragrance"),
    Rule("cassette", "air_freshener", "fragrance"),
    Rule("cassette", "antimicrobial|disinfectant", "antimicrobial"),
    Rule("term1", "cigarettes", "cigarettes"),
    Rule("cassette", "human_metabolite", "human_metabolite"),
    Rule("cassette", "plastic", "plastic"),
    Rule("cassette", "drinking_water", "drinking_water_contaminant"),
    Rule("cassette", "flame_retardant", "flame_retardant"),
    Rule("cassette", "food_contact", "food_contact"),
    Rule("cassette", "food_additive", "food_additive"),
    Rule("cassette", "food_residue", "food_residue"),
    Rule("term1", "textile", "textile"),
]
USE_APPENDS = [
    ("hair_dye", "hair_dye"),
    ("fragrance", "fragrance"),
    ("drinking_water", "drinking_water_contaminant"),
    ("food_contact", "food_contact"),
]
NO_USE = " "

# Specific uses in product categories
PRODUCT_USE_RULES = [
    Rule("product_use_category", "fragrance", "fragrance"),
    Rule("product_use_category", "air freshener", "fragrance"),
    Rule("product_use_category", "hair color", "hair_dye"),
    Rule("product_use_category", "disinfectant", "antimicrobial"),
]
PERSONAL_PRODUCT = "personal care"
PERSONAL_LABEL = "pers."
PERSONAL_TOKEN = ("Pers.", "Personal care")

# Toxicity studies
EFFECT_TYPES = ["BMDL", "ED10", "LEL", "LOAEC", "LOAEL", "LOEC", "LOEL", "BMC05"]
NO_EFFECT_TYPES = ["HNEL", "NEL", "NOAEC", "NOAEL", "NOEL", "NOEC"]
AT_MOST = ["=", "<", "<=", "~"]
AT_LEAST = ["=", ">", ">=", "~"]
STUDY_THRESHOLD = 100
STUDY_UNITS = "mg/kg-day"
STUDY_CLASS = "repro|dev"
STUDY_CLASS_EXCLUDED = "developmental neurotoxicity"
STUDY_CLASS_BOTH = "reproductive developmental"
STUDY_SPECIES = "mammals"
STUDY_TYPES = {"both": "repro/dev", "repro": "reproductive", "dev": "developmental"}
NOT_A_STUDY = "not a developmental or reproductive risk assessment"
EFFECT_BELOW = "toxicant with effect level < 100"
EFFECT_ABOVE = "toxicant with effect level >= 100"
NO_EFFECT_BELOW = "NOEL less than 100 mg/kg-day"
NO_EFFECT_ABOVE = "unlikely (NOEL over 100 mg/kg-day)"
UNCATEGORISED_EFFECT = "uncategorized (vague toxicity value or different units)"

# Cancer calls by meaning, most telling class first
CANCER_CALLS = {
    "Likely": [
        "A (Human carcinogen)",
        "Carcinogenic to humans",
        "Known Human Carcinogen",
        "Group 1 - Carcinogenic to humans",
        "potential occupational carcinogen",
        "B2 (Probable human carcinogen - based on sufficient evidence of carcinogenicity in animals)",
        "C (Possible human carcinogen)",
        "Likely to be carcinogenic to humans",
        "Likely to be carcinogenic to humans (oral route)",
        "Suggestive evidence of carcinogenic potential",
        "Suggestive evidence of carcinogenicity in humans",
        "Reasonably Anticipated To Be Human Carcinogen",
        "Group 2A - Probably carcinogenic to humans",
        "Group 2B - Possibly carcinogenic to humans",
        "Group IIIB: (possibly carcinogenic to humans)",
        "Group II: CEPA (probably carcinogenic to humans)",
        "Group B2 Probable Human Carcinogen",
        "Group C Possible Human Carcinogen",
        "Likely to be Carcinogenic in Humans at High Doses; Not Likely to be Carcinogenic to Humans at Low Doses",
        "Likely to be Carcinogenic to Humans",
        "Suggestive Evidence of Carcinogenicity but Not Sufficient to Assess Human Carcinogenic Potential",
        "Suggestive Evidence of Carcinogenicity to Humans",
        "Likely Human Carcinogen",
    ],
    "Unlikely": [
        "Group E Evidence of Non-carcinogenicity for Humans",
        "Not Likely to Be Carcinogenic in Humans",
    ],
    "Inadequate evidence": [
        "D (Not classifiable as to human carcinogenicity)",
        "Inadequate for an assessment of carcinogenic potential",
        "Group 3 - Not classifiable as to its carcinogenicity to humans",
        "Group VA: CEPA (inadequate data for evaluation)",
        "Group D: IRIS (not classifiable as to human carcinogenicity)",
        "Data are Inadequate for an Assessment of Human Carcinogenic Potential",
        "Group D Not Classifiable as to Human Carcinogenicity",
        "Not Yet  Determined",
    ],
}
NO_ASSESSMENT = "No assessment"
UNKNOWN_CALL = "FIX"

# Regulatory list
DELISTED = "Delisted"
NO_IDENTIFIER = "---"
ID_SEPARATOR = "[/;]"
LIST_FLAGS = {"cancer": "cancer", "development": "development"}

# Labels of the evidence matrix
MAMMARY_BOTH = "Mammary carcinogen and developmental toxicant"
MAMMARY_DEV = "Mammary developmental toxicant"
MAMMARY_CANCER = "Mammary carcinogen"
BOTH_EFFECTS = "Reproductive and developmental"
REPRO_EFFECT = "Reproductive"
DEV_EFFECT = "Developmental"
IMPRECISE = " - imprecise toxicity value or different units"
NO_TESTS = "no repro nor dev tests in ToxValDb"
LIST_BOTH = "Cancer and developmental"
LIST_CANCER = "Cancer"
LIST_DEV = "Developmental"
LIKELY = "Likely"
UNLIKELY = "Unlikely"
INADEQUATE = "Inadequate evidence"

# Column names of the evidence matrix, in order
MAMMARY_COLUMN = "Mammary gland"
EVIDENCE_COLUMNS = [
    "chnm", "casn", "Nhanes", MAMMARY_COLUMN, "Carcinogencity", "Invivo effect < 100 mg/kg-day",
    "No invivo effect >= 100 mg/kg-day", "Other (ToxValDb)", "Prop65",
]
EVIDENCE_RENAMES = {
    "Invivo effect < 100 mg/kg-day": "Invivo effect < 100 mg/kg-day (ToxValDb)",
    "No invivo effect >= 100 mg/kg-day": "No invivo effect >= 100 mg/kg-day (ToxValDb)",
    "Carcinogencity": "Carcinogencity (ToxValDb)",
}
CANCER_SUMMARY = "Carcinogenicity Assessment (Summary)"
TOXICITY_SUMMARY = "Developmental or reproducive toxicity (Summary)"

# Mammary gland labels
PESTICIDE_EFFECTS = {
    "considered - tumor": "Tumor",
    "not considered - both": "Tumor and other effect (potential)",
    "not considered - tumor": "Tumor (potential)",
    "considered - other": "Other effect",
}
PESTICIDE_EFFECT_NOTE = " (pesticide review)"
MAMMARY_LABELS = [
    (r"\bMammary carcinogen\b", "Tumor (tumor review)"),
    ("and developmental toxicant", "and alters mammary gland development (development review)"),
    ("Mammary developmental toxicant", "Alters mammary gland development (development review)"),
]

# Drugs and published overrides
DISCONTINUED = "DISCN"
INGREDIENT_SEPARATOR = "; "
SUBSTRATE_LABEL = "hormone substrate"
BORDERLINE_LABEL = "borderline active"
INACTIVE_NOTE = "(not active)"
UPPER_NOTE = " (u)"
MEDIAN_NOTE = " (m)"

# Names of the integrated table (source name, integrated name)
INTEGRATED_NAMES = {
    "chnm": "Chemical name",
    "casn": "CASN",
    "adj_maxmMD": "Adj.maxmMd",
    "max_tested_conc": "Max. tested conc.",
    "min_tested_conc": "Min. tested conc.",
    "seem": "Predicted median intake rate (mg/kg BW/day)",
    "Cons.": "Consumer",
    "Ind.": "Industrial",
    "No Toxcast Info.": "No exposure source data",
    "Sources of Interest": "Additional exposure sources",
}
INTAKE = "Predicted median intake rate (mg/kg BW/day)"
PRIORITY = "Prioritize (based on efficacy, potency, and exposure potential)"
CONCERN = "Chemical of concern (based on hazard and exposure potential)"

# Names of the published table (integrated name, published name) and its column order
PUBLISHED_NAMES = {
    "rank": "Efficacy/potency rank",
    "rank_percent": "Efficacy/potency percentile",
    "hits": "Hitcall per chemical concentration",
    "Nhanes": "NHANES",
    "Effects on mammary gland": "Effect on mammary gland",
    "Invivo effect < 100 mg/kg-day (ToxValDb)": "Dev/repro in vivo effect level < 100 mg/kg-day (ToxValDb)",
    "No invivo effect >= 100 mg/kg-day (ToxValDb)": "Dev/repro in vivo no effect level >= 100 mg/kg-day (ToxValDb)",
    "Other (ToxValDb)": "Other (ToxValDb re dev/repro in vivo effect)",
    "Carcinogenicity Assessment (Summary)": "Carcinogenicity assessment (Summary)",
    "Carcinogencity (ToxValDb)": "Carcinogenicity (ToxValDb)",
    "Prioritize (based on efficacy, potency, and exposure potential)": CONCERN,
    "Developmental or reproducive toxicity (Summary)": "Developmental or reproductive toxicity (Summary)",
    "ER_Bioactivity": "ER Bioactivity",
    "ER_Agonist_AUC": "ER Agonist AUC",
    "ER_Antagonist_AUC": "ER Antagonist AUC",
}
PUBLISHED_COLUMNS = [
    "hormone", "Chemical name", "Synonym", "CASN", "MFC", "LEC", "AC50", "AC10", "Adj.maxmMd",
    "Efficacy/potency", "Efficacy/potency percentile", "Efficacy/potency rank",
    "Min. tested conc.", "Max. tested conc.", "Hitcall per chemical concentration",
    "Estradiol", "Progesterone",
    "Predicted median intake rate (mg/kg BW/day)",
    "Consumer", "Diet", "Industrial", "Pharma.", "Pest.", "No exposure source data",
    "Failed drug candidate", "Additional exposure sources", "NHANES", "Effect on mammary gland",
    "Carcinogenicity (ToxValDb)",
    "Dev/repro in vivo effect level < 100 mg/kg-day (ToxValDb)",
    "Dev/repro in vivo no effect level >= 100 mg/kg-day (ToxValDb)",
    "Other (ToxValDb re dev/repro in vivo effect)",
    "Prop65", "Carcinogenicity assessment (Summary)", "Developmental or reproductive toxicity (Summary)",
    "FDA approved drug products", "EPA approved pesticide products", CONCERN,
    "ER Bioactivity", "ER Agonist AUC", "ER Antagonist AUC",
]
DIRECTION_NAMES = {ESTRADIOL: "Direction of E2 synthesis", PROGESTERONE: "Direction of P4 synthesis"}

# charts
INTAKE_FLOOR = 0.01
INTAKE_BINS = [(2.5, "high"), (0.3, "intermediate"), (None, "low")]
BOTH_HORMONES = ("Estradiol, Progesterone", "Both")
SOURCE_LABELS = {
    "Consumer": "Consumer \nproducts",
    "Diet": "Diet",
    "Industrial": "Industrial",
    "Pest.": "Pesticides",
    "Pharma.": "Pharmaceuticals",
    "No exposure source data": "No data",
}
LABEL_WINDOWS = {ESTRADIOL: (3.84, -0.7), PROGESTERONE: (11.72, -0.65)}
