"""Word lists, patterns, thresholds and formats that decide results.

Everything here is data that must stay exactly as it is for results to be right.
Ontology, synonym, translation and abbreviation tables are not here: callers pass
those in as DataFrames.
"""

# ---------------------------------------------------------------- language
# Fixed values.
FRENCH_MARKERS = [
    "antécédents", "antecedents", "examen clinique", "examen de la peau",
    "état général", "etat general", "prise en charge",
    "compte rendu", "hospitalisation", "motif d'admission",
    "histoire de la maladie", "traitement en cours",
    "mesures anthropométriques", "bilan paraclinique",
    "originaire et demeurant", "issu d'un couple",
    "bon état de santé", "consanguinité", "fratrie",
    "grossesse", "accouchement", "allaitement",
    "voie basse", "voie haute",
    "pas de", "absence de", "pas d'", "aucun", "aucune",
    "déficit immunitaire", "mucoviscidose", "kinésithérapie",
    "l'enfant", "le patient", "la patiente", "le nourrisson",
    "âgé de", "âgée de", "suivi depuis", "suivie depuis",
    "admis à", "admise à",
]
ENGLISH_MARKERS = [
    "chief complaint", "history of present illness",
    "assessment and plan", "review of systems",
    "past medical history", "family history",
    "presents with", "year old", "denies",
    "no evidence of", "unremarkable",
    "patient is a", "referred by",
    "status post", "follow up",
]
FRENCH_ACCENTS = "[éèêëàâäùûüïîôçœæ]"
FRENCH_ARTICLES = r"\b(?:le |la |les |un |une |des |du |au |aux )\b"
ACCENT_LIMIT, ACCENT_POINTS = 5, 3
ARTICLE_LIMIT, ARTICLE_POINTS = 5, 2
MODEL_MIN_CHARS = 50

# ------------------------------------------------------- personal data
# Category, pattern; group 1 is the value. Case is ignored.
_UP, _LOW = "A-ZÀÂÉÈÊËÏÎÔÙÛÜÇ", "a-zàâéèêëïîôùûüç"
PHI_PATTERNS = [
    ("PATIENT", rf"(?:Patient|Pt|L'enfant|Le nourrisson|La patiente|Il s'agit (?:de l'enfant|du (?:nourrisson|patient))|C'est (?:l'enfant|le patient|la patiente))\s*[:\s]*([{_UP}][{_LOW}]+(?:\s+[{_UP}][{_LOW}]+){{1,4}})"),
    ("PATIENT", rf"(?:Nom et prénom)\s*[:\s]*([{_UP}][{_UP}{_LOW}]+(?:\s+[{_UP}{_LOW}]+){{1,4}})"),
    ("DOCTOR", rf"(?:Dr|Pr|Docteur|Professeur)\.?\s+([{_UP}][{_LOW}]+(?:\s+[{_UP}][{_LOW}]+)?)"),
    ("DOCTOR", rf"(?:Résidente?|Assistante?|Médecin|Attending)\s*(?:du service)?\s*[:\s]*(?:Dr|Pr)\.?\s+([{_UP}][{_LOW}]+)"),
    ("DATE", r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b"),
    ("DATE", r"\b(\d{1,2}-\d{1,2}-\d{4})\b"),
    ("DATE", r"\b(\d{4}-\d{1,2}-\d{1,2})\b"),
    ("LOCATION", rf"(?:originaire et demeurant à|demeurant à|originaire de)\s+([{_UP}][{_UP}{_LOW}\s\-']+?)(?:\s*[,.\n])"),
    ("LOCATION", rf"(?:Adresse)\s*[:\s]*([{_UP}][^\n,]{{2,30}})"),
    ("PHONE", r"(?:Tél|Tel|Téléphone)\s*[:\s]*([\d\s./-]{8,20})"),
    ("PHONE", r"\b(0[567]\.\d{2}\.\d{2}\.\d{2}\.\d{2})\b"),
    ("ID", r"(?:MRN|Dossier|N°\s*(?:de\s+)?Dossier|Numéro\s+Dossier)\s*[:\s]*(\d{3,10})"),
    ("HOSPITAL", rf"(?:EPH|CHU|EHU|Hôpital)\s+([{_UP}][^\n,]{{2,30}}?)(?:\s*[,.\n])"),
]
PHI_CATEGORIES = [
    "NAME", "PATIENT", "DOCTOR", "DATE", "AGE", "LOCATION", "PHONE", "ID", "HOSPITAL", "EMAIL", "USERNAME",
]
PHI_LABELS = {
    "nom de personne": "PATIENT", "lieu": "LOCATION", "hopital": "HOSPITAL", "adresse": "LOCATION",
}
PHI_SCORE_MIN, PHI_SCORER_CHARS, PHI_FUSE_GAP = 0.5, 1024, 2
#: Characters that neighbouring pieces of a long note share, so that a value is whole in one of them.
PHI_SCORER_OVERLAP = 128

# ------------------------------------------------------- patient attributes
# Patterns in the order they are tried.
SEX_PATTERNS = {
    "fr": [
        (r"\bSex[e]?\s*[:\s]*(M|F)\b", 1),
        (r"\b(?:âgée?\s+de|nourrisson)\b.*?\b(masculin|féminin)\b", 1),
        (r"\bSex[e]?\s*[:\s]*(masculin|féminin|M|F)\b", 1),
        (r"\b(garçon|fille)\b", 1),
    ],
    "en": [
        (r"\bSex:\s*(M|F)\b", 1),
        (r"\b(\d+)\s*(?:yo|y/o|year[- ]old)\s+(male|female|M|F)\b", 2),
        (r"\b(male|female)\b", 1),
    ],
}
MALE_WORDS = ["m", "male", "masculin", "garçon"]
AGE_PATTERNS = {
    "fr": [
        (r"âgée?\s+(?:actuellement\s+)?de\s+(\d{1,2})\s*ans?", "years"),
        (r"âgée?\s+de\s+(\d{1,2})\s*mois", "months"),
        (r"Age\s*[:\s]*(\d{1,3})", "years"),
    ],
    "en": [
        (r"\b(\d{1,3})\s*(?:yo|y/o|year[- ]old)\b", "years"),
        (r"\bAge:\s*(\d{1,3})\b", "years"),
        (r"\b(\d{1,3})\s*(?:day|days|wk|wks|week|weeks|mo|month|months)\s*old\b", None),
    ],
}
AGE_UNIT_LETTERS = {"years": "Y", "months": "M", "weeks": "W", "days": "D"}

# ------------------------------------------------- dossier attributes
# Field, pattern, ignore case. Group 1 is the value.
_NAME_AGE = (
    r"(?:L['’]enfant|Le\s+nourrisson|Le\s+patient|La\s+patiente|L['’]adolescent)\s+"
    r"([A-ZÀ-Ÿa-zà-ÿ\s\-]+?)(?:,|\s+)\s*(?:âgée?|agée?|age)\s+(?:de\s+)?"
    r"(\d+\s*(?:ans?|mois|jours?)(?:\s+et\s+(?:demi|\d+\s*mois))?)"
)
DOSSIER_PATTERNS = {
    "dossier_number": (r"(?:Dossier\s+)?N[°0o]\s*(?:Dossier)?\s*[:：]\s*(\d{3,6})", True, 1),
    "full_name": (_NAME_AGE, True, 1),
    "age": (_NAME_AGE, True, 2),
    "origin": (r"originaire\s+(?:et\s+demeurant\s+)?(?:de|d['’]|à)\s+([A-ZÀ-Ÿa-zà-ÿ\s\-]+?)(?:[,.]|\s+(?:suivi|issue|adress))", True, 1),
    "residence": (r"demeurant\s+à\s+([A-ZÀ-Ÿa-zà-ÿ\s\-]+?)(?:[,.]|\s+(?:suivi|issue))", True, 1),
    "parent_father": (r"Père\s*:\s*(\d+\s*ans?[^.\n]*)", True, 1),
    "parent_mother": (r"Mère\s*:\s*(\d+\s*ans?[^.\n]*)", True, 1),
    "consanguinity": (r"[Cc]onsanguinit[ée]\s+(?:du?\s+)?([^.\n]+)", False, 1),
    "siblings_info": (r"Fratrie\s*:\s*\n?((?:.*\n?){1,5})", True, 1),
    "principal_diagnosis": (r"[Dd]iagnostic\s+principal\s*[:：]\s*([^\n.]+)", False, 1),
    "associated_diagnoses": (r"[Dd]iagnostics?\s+associ[ée]s?\s*[:：]\s*([^\n]+)", False, 1),
    "date_of_diagnosis": (r"[Dd]ate\s+d[ue]\s+diagnostic\s*[:：]\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{4})", False, 1),
    "age_at_diagnosis": (r"[Aa]ge\s+(?:au|de)\s+diagnostic\s*[:：]\s*([^\n.]+)", False, 1),
    "treating_doctor": (r"\b(?:Dr|DR)\s+([A-ZÀ-Ÿ][a-zà-ÿ]+)", False, 1),
    "current_treatment": (r"[Tt]raitement\s+(?:en\s+cours|actuel)\s*[:：]\s*\n?((?:.*\n?){1,8}?)(?:\n\s*\n|Derni|Cure|Evolution|Suivi)", False, 1),
}
FEMALE_HINT = r"\bfille\b|féminin|La\s+patiente|L['’]adolescente"
MALE_HINT = r"\bgarçon\b|masculin|Le\s+patient|L['’]adolescent\b|Sexe\s+masculin"
TITLED_FIELDS = ["full_name", "origin", "residence", "treating_doctor"]
FIELD_CUTS = {"siblings_info": 300, "current_treatment": 500}
UNKNOWN = "Inconnu"
PATHOLOGIES = [
    "Mucoviscidose", "Wiskott-Aldrich", "Wiskott Aldrich",
    "Agammaglobulinémie", "Agammaglobulinemie",
    "SCID", "SKID", "Ataxie-télangiectasie", "Ataxie télangiectasie",
    "Ataxie telangiectasie", "SMA", "HIES", "HLA-DR", "HLA DR",
    "DIP", "Déficit", "Deficit",
]
FILENAME_PREFIX = r"^(RM|CERTIFICAT MEDICAL|Novembre|Décembre|Janvier|Février|Mars|Avril|Mai|Juin)\s*"
FILENAME_SUFFIX = r"\s*(Novembre|Décembre|Janvier|Février|Mars|Avril|Mai|Juin|recu|Copie|HDJ|reçu)\s*\d*\s*$"

# ------------------------------------------------------------- entities
# Fixed values.
CHUNK_WORDS = {"fr": 300, "en": 480}
FRENCH_SCORE_MIN = 0.4
LABEL_CATEGORIES = [
    ("deberta-v3", "Disease_disorder", "problem"),
    ("deberta-v3", "Sign_symptom", "problem"),
    ("deberta-v3", "Medication", "treatment"),
    ("deberta-v3", "Therapeutic_procedure", "treatment"),
    ("deberta-v3", "Diagnostic_procedure", "test"),
    ("deberta-v3", "Lab_value", "test"),
    ("biomedical", "Disease", "problem"),
    ("biomedical", "Chemical", "treatment"),
    ("clinicalbert", "problem", "problem"),
    ("clinicalbert", "treatment", "treatment"),
    ("clinicalbert", "test", "test"),
    ("french", "symptôme clinique", "problem"),
    ("french", "signe clinique", "problem"),
    ("french", "anomalie phénotypique", "problem"),
    ("french", "maladie", "problem"),
    ("french", "traitement", "treatment"),
]
SHORT_TERMS = [
    "rash", "pain", "gait", "coma", "edema", "mass", "tics",
    "ache", "clot", "sore", "wart", "acne", "cold", "limp",
    "deaf", "mute", "pale", "weak", "numb", "itch", "burn",
]
CATEGORIES = ["problem", "treatment", "test"]
MERGE_GAP, MERGE_REACH, FRAGMENT_CHARS = 5, 5, 9
MERGE_VECTOR_MIN, SINGLE_VECTOR_MIN, MERGE_MIN_CHARS = 0.72, 0.70, 4

# ------------------------------------------------------------- negation (V1 - V6)
# Fixed values, in lexicon order.
NEGATION_PRE = {
    "en": [
        "no complaints of", "no evidence of", "no history of",
        "no sign of", "no signs of", "no significant",
        "no definite", "no obvious", "no apparent",
        "no acute", "no gross", "no focal",
        "fails to reveal", "failed to reveal",
        "not demonstrate", "does not demonstrate",
        "negative for", "neg for",
        "absence of", "free of", "free from",
        "ruled out", "rules out", "rule out",
        "did not", "does not", "do not",
        "cannot", "can not", "could not",
        "was not", "were not", "is not", "are not",
        "has not", "have not", "had not",
        "no longer",
        "without",
        "denies", "denied", "deny",
        "absent",
        "decline", "declined", "refuses",
        "resolved", "unremarkable",
        "neither", "never", "none",
        "not", "no",
    ],
    "fr": [
        "pas de signe de", "pas de signes de",
        "pas d'argument pour", "pas d'arguments pour",
        "pas d'anomalie", "pas d'anomalies",
        "pas de notion de", "pas de plainte de",
        "pas de particularité", "pas de particularités",
        "aucun signe de", "aucune notion de",
        "aucun argument pour", "aucune anomalie",
        "absence totale de", "absence complète de",
        "il n'y a pas de", "il n'existe pas de",
        "on ne retrouve pas de", "on ne note pas de",
        "ne révèle pas de", "ne montre pas de",
        "ne retrouve pas de", "n'objective pas de",
        "n'a pas présenté de", "n'a pas présenté d'",
        "sans particularité", "sans anomalie",
        "sans anomalies", "sans signe de",
        "pas de", "pas d'",
        "absence de", "absence d'",
        "aucun", "aucune",
        "sans", "ni",
        "négatif pour", "négative pour",
        "négatif", "négative",
        "éliminé", "éliminée",
        "exclu", "exclue",
        "non retrouvé", "non retrouvée",
        "non objectivé", "non objectivée",
        "non documenté", "non documentée",
        "non fait", "non faite",
        "non présent", "non présente",
        "non observé", "non observée",
        "non", "jamais",
    ],
}
NEGATION_POST = {
    "en": [
        "has been ruled out", "have been ruled out",
        "has been excluded", "have been excluded",
        "was ruled out", "is ruled out",
        "was excluded", "is excluded",
        "was negative", "is negative",
        "was absent", "is absent",
        "not seen", "not found", "not identified",
        "not present", "not demonstrated",
        "unlikely",
    ],
    "fr": [
        "a été éliminé", "a été éliminée",
        "a été exclu", "a été exclue",
        "est négatif", "est négative",
        "est absent", "est absente",
        "non retrouvé", "non retrouvée",
        "non confirmé", "non confirmée",
        "non objectivé", "non objectivée",
    ],
}
NEGATION_PSEUDO = {
    "en": [
        "no increase", "no decrease", "no change",
        "no longer needed", "no need",
        "not only", "not necessarily",
        "not certain", "not exclude",
        "no further", "no additional",
        "gram negative", "gram-negative",
        "not limited to",
    ],
    "fr": [
        "pas d'amélioration", "pas d'aggravation",
        "pas de changement", "pas de modification",
        "non seulement", "pas nécessairement",
        "non exclu", "non exclue",
        "gram négatif", "gram-négatif",
        "pas encore", "pas uniquement",
    ],
}
NEGATION_TERMINATORS = {
    "en": [
        "but", "however", "although", "though",
        "except", "apart from", "aside from",
        "nevertheless", "nonetheless",
        "yet", "still", "otherwise",
    ],
    "fr": [
        "mais", "cependant", "toutefois", "néanmoins",
        "pourtant", "sauf", "excepté", "hormis",
        "en revanche", "par contre", "malgré",
        "bien que", "quoique", "sinon",
    ],
}
SCOPE_TOKENS = 6
NEGATION_DECAY, NEGATION_FLOOR, NEGATION_POST_FACTOR = 0.08, 0.5, 0.92
VERIFY_LOW, VERIFY_HIGH, VERIFY_RULE_SHARE, VERIFY_MODEL_SHARE = 0.5, 0.85, 0.4, 0.6
SENTENCE_FALLBACK_CHARS = 200

# ----------------------------------------------------------------- dates
# Patterns in the order they are tried.
BIRTH_DATE_PATTERNS = [
    r"DOB[:\s]+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
    r"DOB[:\s]+(\d{4}-\d{1,2}-\d{1,2})",
    r"Date\s+of\s+Birth[:\s]+([0-9/\-]+)",
    r"DOB[:\s]+\[\*\*(\d{4}-\d{1,2}-\d{1,2})\*\*\]",
    r"[Nn]é(?:e)?\s+le\s+(\d{1,2}/\d{1,2}/\d{2,4})",
    r"[Nn]é(?:e)?\s+le\s+(\d{1,2}-\d{1,2}-\d{4})",
    r"[Dd]ate\s+de\s+naissance\s*[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})",
]
NOTE_DATE_PATTERNS = [
    r"Date[:\s]+([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})",
    r"Date\s+of\s+Service[:\s]+([0-9/\-]+)",
    r"Visit\s+Date[:\s]+([0-9/\-]+)",
    r"Visit[:\s]+([0-9/\-]+)",
    r"Admission\s+Date[:\s]+\[\*\*(\d{4}-\d{1,2}-\d{1,2})\*\*\]",
    r"Date\s+d'admission[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})",
    r"Date\s*[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})",
    r"[Aa]dmis(?:e)?\s+le\s+(\d{1,2}/\d{1,2}/\d{2,4})",
]
EVENT_PATTERNS = [
    r"(?:in|on|during|since|from)\s+((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})",
    r"s/p\s+\w+[\w\s]*?(?:in|on)\s+(\w+\s+\d{4})",
    r"(?:surgery|procedure|repair|operation)\s+(?:in|on|during)\s+(\w+\s+\d{4})",
]
EVENT_CONTEXT_BEFORE, EVENT_CONTEXT_AFTER = 40, 10
STATED_AGE_PATTERNS = [
    r"\b(\d{1,3})\s*(?:yo|y/o|year[- ]old|ans?)\b",
    r"âgée?\s+(?:actuellement\s+)?de\s+(\d{1,3})\s*ans?",
]
EVENT_MESSAGE = "Event '%s' (%s) predates patient DOB (%s). Context: \"%s\""
AGE_MESSAGE = "Stated age (%dyo) does not match calculated age from DOB (%dyo)"

# ------------------------------------------------------------- numeric rules
# Pattern, unit, operator, threshold, switch_at, threshold used
# above switch_at, concept, name, description.
NUMERIC_RULES = [
    (r"(?:temp|temperature|T)\s*[:\s]*(\d{2,3}(?:[.,]\d)?)\s*°?\s*F", "°F", ">=", 100.4, None, None, "HP:0001945", "Fever", "Temperature >= 100.4°F"),
    (r"(?:temp|temperature|T|T°)\s*[:\s]*(\d{2}(?:[.,]\d)?)\s*°?\s*[Cc]", "°C", ">=", 38.0, None, None, "HP:0001945", "Fever", "Temperature >= 38.0°C"),
    (r"(?:fébrile|fébril)\s+(?:à\s+)?(\d{2}(?:[.,]\d)?)\s*°?\s*[Cc]?", "°C", ">=", 38.0, None, None, "HP:0001945", "Fever", "Température >= 38.0°C (fébrile)"),
    (r"(?:glucose|gluc|fasting glucose|dextro|glyc[ée]mie)\s*[:\s]*(\d{1,3}(?:[.,]\d)?)\s*(?:mg/dL|g/l)?", "mg/dL", "<", 70.0, None, None, "HP:0001943", "Hypoglycemia", "Glucose < 70 mg/dL"),
    (r"(?:glucose|gluc|fasting glucose|dextro|glyc[ée]mie)\s*[:\s]*(\d{2,3}(?:[.,]\d)?)\s*(?:mg/dL|g/l)?", "mg/dL", ">", 200.0, None, None, "HP:0003074", "Hyperglycemia", "Glucose > 200 mg/dL"),
    (r"(?:HbA1c|A1c)\s*[:\s]*(\d{1,2}(?:[.,]\d)?)\s*%", "%", ">", 6.5, None, None, "HP:0003074", "Hyperglycemia", "HbA1c > 6.5% (chronic hyperglycemia)"),
    (r"(?:Hgb|Hb|[Hh][eé]moglobin[e]?)\s*[:\s]*(\d{1,2}(?:[.,]\d)?)\s*(?:g/d[Ll])?", "g/dL", "<", 12.0, None, None, "HP:0001903", "Anemia", "Hemoglobin < 12.0 g/dL"),
    (r"(?:WBC|GB)\s*[:\s]*(\d{1,6}(?:[.,]\d)?)\s*(?:K/[uμ]L|[eé]l[eé]ments?/?[uμ]?l)?", "elements/uL", ">", 11.0, 100.0, 11000.0, "HP:0001974", "Leukocytosis", "WBC/GB > 11,000 elements/uL"),
    (r"(?:Plt|PLQT|plaquette[s]?)\s*[:\s]*(\d{2,6})(?:\s*(?:K|000|éléments))?", "K/uL", "<", 150.0, 999.0, 150000.0, "HP:0001873", "Thrombocytopenia", "Platelets < 150K"),
    (r"(?:ALC|[Ll]ymph(?:ocyte[s]?)?)\s*[:\s]*(\d{1,5})\s*/?(?:mcL|[uμ]L|éléments)?", "/uL", "<", 1.5, 100.0, 1500.0, "HP:0001888", "Lymphopenia", "ALC/Lymphocytes < 1500/uL"),
    (r"(?:SpO2|SPO2|O2\s*sat|SaO2)\s*[:\s]*(\d{2,3})\s*%", "%", "<", 92.0, None, None, "HP:0012418", "Hypoxemia", "SpO2 < 92%"),
    (r"CRP\s*[:\s]*(\d{1,3}(?:[.,]\d)?)\s*(?:mg/[lL])?", "mg/L", ">", 10.0, None, None, "HP:0011227", "Elevated C-reactive protein", "CRP > 10 mg/L (inflammation)"),
]
#: Readings in these units are scaled before the predicate (grams per litre).
UNIT_FACTORS = [(r"(?:glucose|gluc|dextro|glyc[ée]mie)[^%]*g/l\s*$", 100.0)]

# ----------------------------------------------------- contradictions
# Fixed values.
FEMALE_TERMS = [
    "ovarian", "ovary", "uterine", "uterus", "endometrial",
    "endometriosis", "cervical", "cervix", "pregnancy", "pregnant",
    "menstrual", "menstruation", "menarche", "gravida", "para",
    "ovarien", "ovarienne", "ovaire", "utérin", "utérine", "utérus",
    "endométrial", "endométriose", "col utérin",
    "grossesse", "enceinte", "menstruel", "ménarche",
]
MALE_TERMS = [
    "testicular", "testicle", "prostate", "prostatic", "penile",
    "epididymitis", "varicocele",
    "testiculaire", "testicule", "prostatique",
    "pénien", "épididymite", "varicocèle",
]
SEX_MESSAGES = {
    "male": "Female-specific term '%s' found in male patient record",
    "female": "Male-specific term '%s' found in female patient record",
}
GLUCOSE_PATTERN = r"(?:glucose|gluc|glycémie|dextro|fasting glucose)\s*[:\s]*(\d{1,3}(?:[.,]\d)?)\s*(?:mg/dL|g/l)?"
HIGH_A1C_PATTERN = r"(?:hba1c|a1c)\s*[:\s]*(?:1[0-9]|[89])(?:[.,]\d)?\s*%"
LOW_GLUCOSE = 70.0
LAB_MESSAGE = "Acute hypoglycemia with elevated HbA1c — consider glycemic variability or brittle diabetes"
CONFLICT_RULES = [
    (
        ["warfarin", "heparin", "enoxaparin", "rivaroxaban", "apixaban", "aspirin", "warfarine", "héparine", "aspirine", "anticoagulant"],
        ["hemophilia", "bleeding disorder", "hemorrhage", "hémophilie", "trouble hémorragique", "hémorragie", "syndrome hémorragique", "saignement"],
        "critical",
        "Anticoagulant/antiplatelet prescribed with bleeding disorder",
    ),
    (
        ["metformin", "metformine"],
        ["renal failure", "kidney failure", "ckd stage 4", "ckd stage 5", "esrd", "insuffisance rénale", "insuffisance renale"],
        "warning",
        "Metformin with severe renal impairment (lactic acidosis risk)",
    ),
    (
        ["nsaid", "ibuprofen", "naproxen", "ketorolac", "aspirin", "ibuprofène", "naproxène", "aspirine", "ains"],
        ["gi bleed", "gastrointestinal bleed", "peptic ulcer", "hémorragie digestive", "ulcère gastrique", "ulcère peptique"],
        "warning",
        "NSAID with history of GI bleeding",
    ),
]

# ------------------------------------------------------- normalization
# Fixed values.
BLACKLIST = [
    "HP:0000118", "HP:0000001", "HP:0012823", "HP:0040064", "HP:0002715", "HP:0025354",
    "HP:0011009", "HP:0011010", "HP:0012825", "HP:0012826", "HP:0012828", "HP:0012835",
    "HP:0012834", "HP:0012832", "HP:0003674", "HP:0003581", "HP:0003593", "HP:0003621",
    "HP:0011463", "HP:0025285", "HP:0025297", "HP:0031375", "HP:0012830",
]
EXACT_CONFIDENCE, SUBPHRASE_CONFIDENCE = 1.0, 0.95
BILINGUAL_CURATED, BILINGUAL_OFFICIAL, BILINGUAL_PARTIAL, BILINGUAL_MIN_CHARS = 0.95, 0.92, 0.85, 4
VECTOR_TAU, VECTOR_MARGIN, VECTOR_FLOOR, VECTOR_K = 0.70, 0.18, 0.62, 3
SCAN_SCORE, SCAN_CONFIDENCE = 0.90, 0.95
SCAN_SKIP_WORDS = [
    "disease", "disorder", "syndrome", "abnormality", "abnormal",
    "increased", "decreased", "delayed", "absent", "reduced",
    "chronic", "acute", "severe", "mild", "moderate",
    "type", "form", "variant", "familial", "hereditary",
    "of", "the", "and", "in", "with", "or", "a", "an",
    "pain", "loss", "mass", "cell", "gene", "acid",
    "left", "right", "upper", "lower", "large", "small",
    "test", "sign", "male", "bone", "body", "blood",
    "drug", "dose", "case", "well", "also", "been",
    "were", "have", "that", "this", "from", "some",
]
NOISE_WORDS_EN = [
    "disease", "syndrome", "disorder", "condition", "diagnosis",
    "pathology", "abnormality", "examination", "assessment",
    "treatment", "therapy", "medication", "hospitalization",
    "monitoring", "surveillance", "management", "support",
    "evolution", "consultation", "admission", "discharge",
    "noise", "damage", "drawing", "clinical", "medical",
    "normal", "correct", "negative", "positive", "presence",
    "absence", "concept", "notion", "history", "report",
    "respiratory", "cardiac", "hepatic", "renal", "digestive",
    "pulmonary", "thoracic", "abdominal", "cervical",
    "severe", "moderate", "mild", "chronic", "acute",
    "bilateral", "left", "right", "proximal", "distal",
    "progressive", "recurrent", "intermittent",
]
ENTITY_SCORE_MIN_EN, ENTITY_MIN_CHARS_EN = 0.55, 3
QUALIFIERS_FR = [
    "chronique", "aigu", "aiguë", "sévère",
    "modéré", "modérée", "léger", "légère",
    "gauche", "droit", "droite", "bilatéral",
    "proximal", "distal", "antérieur", "postérieur",
    "progressif", "progressive", "récidivant",
    "hospitalisé", "hospitalisation", "consultation",
    "suivi", "contrôle", "évolution",
    "bon état général", "beg", "état général conservé",
    "vaccin", "vaccination", "bcg",
]
WORKUP_PHRASES_FR = ["bilan d", "examen d"]
ONE_WORD_VECTOR_MIN = 0.80

# --------------------------------------------------------- ranking
# Fixed values.
ROOT_CONCEPT = "HP:0000001"
PROFILE_MAX_TERMS, RANK_K = 100, 10
FORWARD_SHARE, BACKWARD_SHARE, OVERLAP_BONUS, NAME_BONUS = 0.7, 0.3, 0.02, 0.12
NAME_MIN_CHARS, HYPHEN_MIN_CHARS = 10, 8

# ------------------------------------------------------------- documents
# Fixed values.
EVIDENCE_CODE = ("ECO:0000033", "author statement supported by traceable reference")
SCHEMA_VERSION = "2.0"
RESOURCE = ("hp", "Human Phenotype Ontology", "https://hpo.jax.org", "2024-04-26", "HP", "http://purl.obolibrary.org/obo/HP_")

# ------------------------------------------------------------- evaluation
# Fixed values.
SCORE_WEIGHTS = {"S": 0.20, "C": 0.25, "O": 0.20, "R": 0.20, "E": 0.15}
SCORE_RATINGS = [(90, "Excellent"), (75, "Good"), (60, "Acceptable"), (40, "Fair"), (0, "Poor")]
TOP_CUES = 10

# --------------------------------------------------------------- reports (R*, S5)
# Fixed values.
CONTENT_CHARS, RESULT_TEXT_CHARS = 50000, 10000
SYNC_MIN_CHARS, IMPORT_MIN_CHARS, STREAM_MIN_CHARS = 50, 30, 50
DOSSIER_FIELDS = [
    "full_name", "date_of_birth", "age", "gender", "origin", "residence",
    "parent_father", "parent_mother", "consanguinity", "siblings_info",
    "principal_diagnosis", "associated_diagnoses", "date_of_diagnosis",
    "age_at_diagnosis", "treating_doctor", "current_treatment", "notes",
]
REPORT_SEARCH = ["patient_name", "doctor_name", "pathology", "filename", "content_text"]
DOSSIER_SEARCH = ["full_name", "principal_diagnosis", "treating_doctor", "origin", "dossier_number"]
LABEL_CUT = 35
GENDER_LABELS = {"M": "Masculin", "F": "Féminin"}
AGE_BUCKETS = [(1, "0-1 an"), (3, "1-3 ans"), (6, "3-6 ans"), (12, "6-12 ans"), (None, "12+ ans")]
