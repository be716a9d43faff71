"""Word lists, thresholds, weights and patterns that results depend on."""

from __future__ import annotations

# Parts of speech that never earn a card. INTJ is left out on purpose.
CLOSED_CLASS_POS = (
    "ADP", "AUX", "CCONJ", "DET", "NUM", "PART", "PRON", "PUNCT", "SCONJ", "SYM", "X",
)

MIN_BOOK_COUNT = 3
ZIPF_THRESHOLD = 3.5
REGIONAL_MIN_BOOK_COUNT = 2
MAX_CARDS_PER_SESSION = 18
KNOWN_MIN_STABILITY_DAYS = 21.0
COVERAGE_FINE = 0.90
COVERAGE_DEMANDING = 0.60
DIFFICULTY_MIN_SESSIONS = 3
SONG_COVERAGE_WARN = 0.95
GLOSS_TARGET = 0.95
TOP_TEACH = 20
GLOSS_SAMPLE = 30
ZIPF_SAMPLE = 12
SAMPLE_SEED = 20260817
ERROR_LOG_CAP = 50
IMPORT_LOG_CAP = 10
SCHEMA_VERSION = 1

# One token: a word, a run of digits, a run of white space, or one other character.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# Where a sentence ends: closing marks, white space, and a capital or a number that may be quoted. A point behind one of
# these, or behind a single letter, ends none.
SENTENCE_ABBREVIATIONS = (
    "Sr Sra Srta Dr Dra Prof Ud Uds Lic Ing Gral Mr Mrs Ms St Jr vs etc Núm núm pág págs Vol vol cap Cap Fig fig ed Ed Hr Frau Nr bzw ca M Mme Mlle"
)
SENTENCE_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
SENTENCE_END = r"([.!?…]+[»”’\"')\]]*)" + SENTENCE_SPACE + r"([¿¡«“‘\"'(\[—-]*[\p{Lu}\p{N}])"
SENTENCE_POINT = r"(^|[^\p{L}\p{M}])(" + "|".join(SENTENCE_ABBREVIATIONS.split()) + r"|\p{L})\."
TOKEN_PATTERN = r"(?s)\p{L}[\p{L}\p{M}]*|\p{N}+|" + WHITESPACE + r"+|."

NON_PROSE_TAGS = ("script", "style", "head", "title", "sup")
DOCUMENT_MEDIA_TYPES = ("application/xhtml+xml", "text/html")
BOILERPLATE_START = r"(?i)\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG"
BOILERPLATE_END = r"(?i)\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG"

# Grades in the order their numbers (1..4) are assigned.
GRADES = ("again", "hard", "good", "easy")
CARD_STATES = ("new", "learning", "review", "relearning")

# Published FSRS-6 default weights, retention 0.90.
FSRS_WEIGHTS = (
    0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796,
    1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542,
)
REQUEST_RETENTION = 0.90
LEARNING_STEPS_MIN = (1, 10)
RELEARNING_STEPS_MIN = (10,)
MAX_INTERVAL_DAYS = 36500
MIN_STABILITY = 0.001

TEACH_REASONS = ("bookCount", "zipf", "mexicanism")
TEACH_CLASSES = ("TEACH", "GLOSS_ONLY", "SKIPPED_CLOSED_CLASS", "ALREADY_KNOWN")

# Song titles: qualifiers that may be cut from the end of a title.
TITLE_STOP_TERMS = (
    r"remaster(?:ed)?", r"\d{4} remaster(?:ed)?", "single version", "album version", "radio edit",
    "live", "demo", "bonus track", "deluxe", "explicit", "clean", "mono", "stereo", "en vivo",
    r"versión .*", "remix",
)
MATCH_ACCEPT = 0.85
MATCH_MANUAL = 0.70
MATCH_WEIGHTS = (0.5, 0.35, 0.15)
DURATION_TOLERANCE_SEC = 3
DURATION_SPAN_SEC = 64
SLIP_LETTERS = (3, 6)  # letters from which on a word is found with one slip, and with two

VARIETIES = (
    "general", "es-MX", "es-AR", "es-ES", "es-CO", "es-CL", "es-PE", "es-VE", "es-PR", "es-DO",
    "es-CU", "es-UY", "es-EC", "es-GT", "es-BO", "es-PY", "es-CR", "es-PA", "es-HN", "es-SV",
    "es-NI",
)
REGISTERS = ("neutral", "coloquial", "vulgar", "poetic", "arcaic", "albur")
HOME_DIALECT = "es-MX"

# Frequent function words with one part of speech each; the default form dictionary.
CLOSED_CLASS_FORMS = {
    "DET": "the a an this el la los las un una le les des du der die das den dem ein eine",
    "ADP": "of in to for with by on at from de en con por para sur dans par avec pour au aux "
           "von mit zu auf für im",
    "CCONJ": "and or y o et ou und",
    "PRON": "it that he she they se qui que elle il ich sie er es sich",
    "AUX": "is was are be has est ist hat",
    "SCONJ": "as if dass",
    "PART": "not no nicht",
}

# How far a text's trigrams are believed to tell its language.
LANGUAGE_PRIOR = 10
LANGUAGE_SHARPNESS = 2.5
