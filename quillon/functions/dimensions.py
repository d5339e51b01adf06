"""Fixed values that results depend on."""

from __future__ import annotations

# System organ class codes of the CTIS register.
ORGAN_CLASSES = {
    "100000004848": "Investigations",
    "100000004849": "Cardiac disorders",
    "100000004850": "Congenital, familial and genetic disorders",
    "100000004851": "Blood and lymphatic system disorders",
    "100000004852": "Nervous system disorders",
    "100000004853": "Eye disorders",
    "100000004854": "Ear and labyrinth disorders",
    "100000004855": "Respiratory, thoracic and mediastinal disorders",
    "100000004856": "Gastrointestinal disorders",
    "100000004857": "Renal and urinary disorders",
    "100000004858": "Skin and subcutaneous tissue disorders",
    "100000004859": "Musculoskeletal and connective tissue disorders",
    "100000004860": "Endocrine disorders",
    "100000004861": "Metabolism and nutrition disorders",
    "100000004862": "Infections and infestations",
    "100000004863": "Injury, poisoning and procedural complications",
    "100000004864": "Neoplasms benign, malignant and unspecified (incl cysts and polyps)",
    "100000004865": "Surgical and medical procedures",
    "100000004866": "Vascular disorders",
    "100000004867": "General disorders and administration site conditions",
    "100000004868": "Pregnancy, puerperium and perinatal conditions",
    "100000004869": "Social circumstances",
    "100000004870": "Immune system disorders",
    "100000004871": "Hepatobiliary disorders",
    "100000004872": "Reproductive system and breast disorders",
    "100000004873": "Psychiatric disorders",
}

# Status codes of the CTIS register.
STATUS_CODES = {
    "1": "Under evaluation",
    "2": "Authorised, recruitment pending",
    "3": "Authorised, recruiting",
    "4": "Ongoing, recruiting",
    "5": "Ongoing, recruitment ended",
    "6": "Temporarily halted",
    "7": "Suspended",
    "8": "Ended",
    "9": "Expired",
    "10": "Revoked",
    "11": "Not authorised",
    "12": "Cancelled",
}

# Display names of raw statuses in lower case; any other is put in sentence case.
STATUS_NAMES = {
    "temporarily halted": "Temporarily halted",
    "temporarily halted (current)": "Temporarily halted",
    "halted": "Temporarily halted",
    "restarted": "Restarted",
    "withdrawn": "Withdrawn",
    "terminated": "Terminated",
    "completed": "Completed",
    "ended": "Completed",
    "authorised": "Authorised",
    "in progress": "Ongoing",
    "ongoing": "Ongoing",
    "not authorised": "Not Authorised",
    "suspended": "Suspended",
    "under evaluation": "Under evaluation",
    "revoked": "Revoked",
}

# Status categories and the patterns that decide them, in order; what matches none is Not Authorised.
# Longer statuses that hold one of these words, such as "Ongoing, recruiting" or "Authorised, not started", are not listed again.
STATUS_CATEGORIES = [
    ("Withdrawn", r"(?i)\bWithdrawn\b"),
    ("Administrative", r"(?i)Trial now transitioned|GB - no longer in EU/EEA"),
    ("Not Authorised", r"(?i)Not Authorised|Prohibited|Cancelled|Expired"),
    ("Ongoing", r"(?i)Recruiting|Active|Ongoing|Halted|Restarted|Authorised|Enrolling by invitation|In Progress|Suspended"),
    ("Completed", r"(?i)\b(Completed|Ended|Terminated)\b"),
]

# Countries by the name that is shown.
COUNTRIES = [
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czech Republic", "Denmark", "Estonia", "Finland", "France",
    "Germany", "Greece", "Hungary", "Ireland", "Italy", "Latvia", "Lithuania", "Luxembourg", "Malta", "Netherlands",
    "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden", "Norway", "Iceland", "Liechtenstein",
    "Switzerland", "United Kingdom", "Albania", "Algeria", "Argentina", "Armenia", "Australia", "Azerbaijan",
    "Bangladesh", "Belarus", "Bolivia", "Bosnia and Herzegovina", "Brazil", "Canada", "Chile", "China", "Colombia",
    "Cuba", "Dominican Republic", "Ecuador", "Egypt", "Ethiopia", "Georgia", "Ghana", "Guatemala", "India", "Indonesia",
    "Iran", "Iraq", "Israel", "Japan", "Jordan", "Kazakhstan", "Kenya", "South Korea", "Kuwait", "Lebanon", "Malaysia",
    "Mexico", "Moldova", "Mongolia", "Montenegro", "Morocco", "Mozambique", "Myanmar", "Nepal", "New Zealand",
    "Nigeria", "North Macedonia", "Pakistan", "Panama", "Paraguay", "Peru", "Philippines", "Qatar", "Russia", "Rwanda",
    "Saudi Arabia", "Senegal", "Serbia", "Singapore", "South Africa", "Sri Lanka", "Taiwan", "Tanzania", "Thailand",
    "Tunisia", "Turkey", "Uganda", "Ukraine", "United Arab Emirates", "United States", "Uruguay", "Uzbekistan",
    "Venezuela", "Vietnam", "Zambia", "Zimbabwe",
]

# Other names of these countries, in lower case.
COUNTRY_ALIASES = {
    "czechia": "Czech Republic",
    "great britain": "United Kingdom",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "us": "United States",
    "usa": "United States",
    "u.s.a.": "United States",
    "united states of america": "United States",
    "republic of korea": "South Korea",
    "korea": "South Korea",
    "russian federation": "Russia",
    "türkiye": "Turkey",
}

# Spellings of conditions that are made one, applied in order.
TERM_SPELLINGS = [
    (r"(?i)hemophilia", "haemophilia"),
    (r"(?i)leukemia", "leukaemia"),
    (r"(?i)\btumors?\b", "tumour"),
    (r"(?i)diarrhea", "diarrhoea"),
    (r"(?i)gastroesophag", "gastrooesophag"),
    (r"(?i)(?<![oO])esophag", "oesophag"),
    (r"(?i)tyrosinemia", "tyrosinaemia"),
    (r"(?i)localized", "localised"),
    (r"(?i)\btype iv\b", "type 4"),
    (r"(?i)\btype iii\b", "type 3"),
    (r"(?i)\btype ii\b", "type 2"),
    (r"(?i)\btype i\b", "type 1"),
    (r"(?i)^(metastatic|advanced|recurrent|relapsed|unresectable|locally advanced|progression of)\s+", ""),
    (r"(?i)\s+(metastatic|recurrent|refractory|relapse|relapsed)$", ""),
    (r"(?i)\s+WHO\s+clinical\s+stage\s+\w+", ""),
    (r"(?i)\s+NYHA\s+class\s+\w+", ""),
    (r"(?i)\s+stage\s+([IVXivx0-9]+[A-Za-z]?|unspecified)(\s.*)?$", ""),
]

# What shows that a text names no substance worth a label.
NO_SUBSTANCE = r"(?i)^\d+[,.]?\d*\s*%?\s*(w|w/v|v/v)?$|^dose$|^the placebo|\bplacebo\b|not yet established|not available|not applicable|^na$|^n/a$|^none$|^ml\b|^mg\b|micrograms?|concentrate|solution|solución|solucion|injectable|inyectable|injection|infusion|injektionslösung|iniettabile|comprimidos|recubiertos|pel[ií]cula|capsules?|tablets?|poudre|polvere|polvo|solvant|solvente|sodium chloride|nacl|magnesium stearate|kwikpen"

# Doses and salts that are cut from substances before they are matched with decisions.
DOSE = r"\d+[,.]?\d*\s*(mg|mcg|micrograms?|µg|ug|g|ml|l|%)/?[a-z]*\b"
SALTS = r"\b(hydrochloride|hydrobromide|sulfate|sulphate|phosphate|acetate|maleate|fumarate|tartrate|citrate|mesylate|tosylate|besylate|monohydrate|dihydrate|trihydrate|sesquihydrate|sodium|potassium|calcium|magnesium|zinc|aluminum|aluminium|monosodium|disodium)\b"

# Patterns that tell the phase of a CTIS record, in lower case and in this order, so that "Phase I/II" is Phase I.
CTIS_PHASES = {
    "Phase I": "phase i[^iv]|phase i$|human pharmacology",
    "Phase IV": "phase iv|therapeutic use",
    "Phase III": "phase iii|confirmatory",
    "Phase II": "phase ii|exploratory",
}
PHASES = ("Phase I", "Phase II", "Phase III", "Phase IV")

# What flags of the registers look like when they are set, in lower case.
PHASE_SET = "true|yes|1"
FLAG_SET = "yes|true"
ORPHAN_SET = r"\byes\b"
