"""Word lists, tables, patterns and limits that results must agree with."""

# --- sentence segmentation: a period after one of these ends no sentence ---
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e",
    "eg", "ie", "cf", "al", "fig", "no", "vol", "pp", "inc", "ltd", "co", "corp",
    "dept", "univ", "approx", "min", "max", "a.m", "p.m", "u.s", "u.k",
)

# --- top-level domains of bare hosts ---
TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "ai", "dev",
    "app", "xyz", "info", "biz", "me", "us", "uk", "ca", "de", "fr", "jp",
    "cn", "au", "eu", "nl", "se", "no", "es", "it", "ru", "br", "in",
    "example", "test", "invalid", "localhost",
)

# --- lexical tables of the metrics ---
STOCK_CLUSTERS = {
    "conclusion_framing": ("in conclusion", "to sum up", "all things considered"),
    "significance_framing": ("it is important to note", "it is worth noting", "serves as a reminder", "stands as a testament"),
    "broad_change_framing": ("in today's rapidly changing", "in an ever-evolving", "rapidly evolving landscape", "in today's fast-paced world"),
    "essence_framing": ("at its core", "at the heart of"),
    "generic_navigation": ("delve into", "sheds light on", "paves the way for"),
}
DUALITY_TEMPLATES = (r"\bnot only\b.{1,80}?\bbut also\b", r"\bnot just\b.{1,80}?\bbut\b")
TRANSITION_OPENERS = (
    "furthermore", "moreover", "however", "therefore", "additionally",
    "consequently", "nevertheless", "nonetheless", "in addition",
    "on the other hand", "as a result", "that said", "in other words",
    "importantly", "notably",
)
VAGUE_ATTRIBUTION = (
    "studies show", "studies have shown", "research shows", "research suggests",
    "experts say", "experts agree", "it is widely known", "it is well known",
    "many believe", "some argue", "it is said", "critics say", "scientists say",
    "sources say", "it is often said",
)
BUZZWORDS = (
    "robust", "scalable", "innovative", "best-in-class", "seamless", "leverage",
    "empower", "cutting-edge", "world-class", "game-changing", "next-generation",
    "state-of-the-art", "synergy", "holistic", "disruptive", "revolutionary", "turnkey",
    "frictionless", "bespoke", "streamline", "supercharge",
    "unparalleled", "best-of-breed", "mission-critical", "value-add",
)
INTENSIFIERS = (
    "incredibly", "extremely", "truly", "remarkably", "immensely", "exceptionally",
    "tremendously", "wildly", "insanely", "vastly",
)
NEGATIVE_PARALLELISM = (r"\b[a-z]{2,},\s+not\s+[a-z]{2,}", r"\bnot\s+[a-z][\w -]{0,50}?,\s+but\s+[a-z]")
RULE_OF_THREE = r"\b[\w-]+,\s+[\w-]+,\s+and\s+[\w-]+"
REQUIREMENT_ADJECTIVES = (
    "fast", "quick", "snappy", "simple", "intuitive", "easy", "seamless", "smooth", "robust",
    "scalable", "flexible", "powerful", "efficient", "reliable", "secure", "performant",
    "responsive", "modern", "clean", "elegant", "lightweight", "delightful", "user-friendly",
)
REQUIREMENT_MODALS = ("must", "shall", "should")
REQUIREMENT_VERBS = ("be", "feel", "look", "remain", "stay")
REQUIREMENT_DEGREES = ("very", "highly", "extremely", "really", "super", "more", "most", "quite", "truly", "incredibly")

# --- limits and flags ---
EM_DASH_PER_1K, SEMICOLON_PER_1K = 12.0, 8.0
NEGATIVE_PARALLELISM_FLAG, GENERIC_DICTION_FLAG = 5, 3
MAX_LOCATIONS, MATCH_CHARS, DUALITY_CHARS = 25, 48, 60
OPENER_GAP, OPENER_MIN, RUN_MIN = 7, 3, 3
PURPOSE = "candidate_selection_only"

# --- metric classes and what genres keep ---
METRIC_CLASS = {
    "negative_parallelism": "cadence",
    "rule_of_three": "cadence",
    "repeated_openers": "cadence",
    "punctuation_rates": "voice_punctuation",
    "sentence_length_distribution": "distribution",
    "sentence_length_dispersion": "distribution",
    "paragraph_sentence_count_runs": "distribution",
    "transition_clusters": "filler",
    "stock_lexical_clusters": "filler",
    "generic_diction": "filler",
    "vague_attribution": "epistemic",
    "bold_label_density": "structural",
    "adjective_requirements": "laundering",
}
METRIC_VERSION = {
    "sentence_length_distribution": "sent-dist-v1",
    "sentence_length_dispersion": "sent-disp-v1",
    "punctuation_rates": "punct-v2",
    "negative_parallelism": "negparallel-v1",
    "rule_of_three": "tricolon-v1",
    "paragraph_sentence_count_runs": "para-runs-v1",
    "bold_label_density": "bold-label-v2",
    "repeated_openers": "openers-v1",
    "transition_clusters": "transition-v1",
    "vague_attribution": "vague-attr-tables-v1",
    "stock_lexical_clusters": "stock-tables-v1",
    "generic_diction": "generic-diction-tables-v1",
    "adjective_requirements": "adj-req-v1",
}
METRIC_CONFIDENCE = {
    "sentence_length_distribution": "normal",
    "sentence_length_dispersion": "normal",
    "punctuation_rates": "normal",
    "negative_parallelism": "medium",
    "rule_of_three": "low",
    "paragraph_sentence_count_runs": "normal",
    "bold_label_density": "normal",
    "repeated_openers": "medium",
    "transition_clusters": "medium",
    "vague_attribution": "low",
    "stock_lexical_clusters": "low",
    "generic_diction": "medium",
    "adjective_requirements": "medium",
}
GENRE_KEEPS = {
    "general": (),
    "prd": (),
    "marketing": (),
    "technical": (),
    "spec": ("cadence",),
    "personal": ("cadence", "voice_punctuation"),
}
ALWAYS_KEPT = ("distribution",)

# --- genre signals ---
GENRE_ALIASES = {
    "general": "general", "general-prose": "general", "prose": "general", "essay": "general",
    "spec": "spec", "specification": "spec", "rfc": "spec", "standard": "spec",
    "prd": "prd", "product-requirements": "prd", "product-requirements-doc": "prd",
    "personal": "personal", "personal-prose": "personal", "journal": "personal", "diary": "personal",
    "marketing": "marketing", "marketing-copy": "marketing", "pitch": "marketing",
}
PATH_TOKENS = (
    ("prd", ("prd", "prds")),
    ("spec", ("spec", "specs", "specification", "specifications", "rfc", "rfcs", "requirement", "requirements")),
    ("personal", ("journal", "journals", "diary", "diaries")),
    ("general", ("readme", "readmes", "changelog", "changelogs", "guide", "guides", "guideline", "guidelines")),
)
PRD_MARKERS = (
    "user story", "user stories", "acceptance criteria", "non-goals", "non goals",
    "out of scope", "success metric", "product requirements", "as a user", "personas",
    "problem statement", "target users", "user persona",
)
FIRST_PERSON = ("i", "i'm", "i've", "i'd", "i'll", "me", "my", "mine", "myself")
STRONG_MODALS = r"\b(?:must|shall|required)\b"
MARKETING = (
    r"\b(?:market(?:s|ing)?|competitors?|competiti(?:on|ve)|investors?|investments?"
    r"|brand(?:ing)?|rebranding|position(?:ed|ing)|customers?|revenue|monetiz\w+|moat"
    r"|segments?|pricing|adoption|go-to-market|value proposition|best-in-class|world-class"
    r"|enterprise-grade|flywheel|retention|differentiat\w+)\b"
)
FALLBACK_GENRE = "spec"

# --- atoms ---
NUMBER = r"([<>]=?|≤|≥|±)?\s*([-−+])?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(%)?"
QUANTITY = r"([<>]=?|≤|≥|±)?\s*([-−+])?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|[A-Za-z]{1,12})?"
MONTHS = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|" + MONTHS + r"\s+\d{1,2}(?:,\s*\d{4})?|\d{1,2}\s+" + MONTHS + r"(?:,?\s*\d{4})?)\b"
URL = r"(?:https?://|www\.)[^\s<>)\]]+"
CITATION = r"\[\d{1,3}\]|\((?:[A-Z][A-Za-z-]+(?:\s+et\s+al\.?)?,?\s*)\d{4}[a-z]?\)"
THRESHOLD = r"[<>]=?|≤|≥|\b(?:at\s+least|at\s+most|no\s+more\s+than|no\s+fewer\s+than|greater\s+than|less\s+than|minimum|maximum|up\s+to)\b"
MODALS = (
    "must not", "shall not", "should not", "may not", "will not", "cannot",
    "is required to", "are required to", "required to", "must", "shall", "should",
    "may", "will", "can", "might", "could", "required",
)
NEGATION = r"\b(?:not|no|never|none|neither|nor|without|cannot)\b|n['’]t\b"
CONDITION = r"\b(?:if|when|whenever|unless|provided\s+that|in\s+case|as\s+long\s+as|only\s+if|where|assuming)\b"
PROPER_NOUN = r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z][A-Za-z]{2,})\b"
DEFINED_TERM = r'"[^"\n]+"\s+(?:means|refers\s+to|is\s+defined\s+as|shall\s+mean)\b|\b(?:hereafter|hereinafter)\b'

# --- ledger ---
CHECKS = ("numbers", "units", "modality", "negation", "conditions", "cross_refs", "defined_terms")
CHECK_KIND = {
    "numbers": ("number_or_quantity", "lexically_exact", 950),
    "units": ("number_or_quantity", "lexically_exact", 950),
    "modality": ("normative_statement", "semantic_exact", 950),
    "negation": ("normative_statement", "semantic_exact", 900),
    "conditions": ("condition", "relationship_exact", 850),
    "cross_refs": ("cross_reference", "lexically_exact", 950),
    "defined_terms": ("defined_term", "lexically_exact", 950),
}

# --- stages ---
EXIT_CLASS = {
    "ok": 0,
    "verify_not_shippable": 2, "candidate_empty": 2, "apply_blocked": 2,
    "invalid_edits": 3, "invalid_decisions": 3, "conflicting_decisions": 3, "path_mismatch": 3, "digest_mismatch": 3, "genre_error": 3,
    "protected_span_error": 4, "diagnosis_error": 4, "ledger_build_error": 4, "semantic_invocation_failed": 4, "verify_error": 4, "apply_error": 4,
}
STATUS_RANK = {"failed": 3, "blocked": 2, "aborted": 1, "ok": 0}

# --- calibration, learning, judging ---
METRIC_TELL = {
    "rule_of_three": "rule_of_three",
    "negative_parallelism": "synthetic_cadence",
    "sentence_length_distribution": "synthetic_cadence",
    "sentence_length_dispersion": "synthetic_cadence",
    "paragraph_sentence_count_runs": "synthetic_cadence",
    "repeated_openers": "synthetic_cadence",
    "transition_clusters": "synthetic_cadence",
    "punctuation_rates": "em_dash_overuse",
    "vague_attribution": "genericness",
    "stock_lexical_clusters": "lexical_structural",
    "bold_label_density": "lexical_structural",
    "generic_diction": "genericness",
}
MIN_POINTS, MIN_EVIDENCE = 20, 3.0
ACTION_WEIGHT = {"discard": 1.0, "edit": 0.5, "apply": -1.0}
GENRES = ("personal", "spec", "prd", "marketing", "technical", "general")
USER_ACTIONS = ("apply", "edit", "discard")
REASONS = ("false_positive", "keep_voice", "genre_wrong", "other")

#: Kinds, ways of preservation and schema version of ledgers.
LEDGER_KINDS = ("literal", "number_or_quantity", "normative_statement", "condition", "exception", "causal_claim", "attribution", "defined_term", "cross_reference", "unsupported_intent", "missing_support", "intentional_repetition", "protected_span")
LEDGER_PRESERVATIONS = ("byte_exact", "lexically_exact", "semantic_exact", "relationship_exact", "surface_only")
LEDGER_SCHEMA_VERSION = 1
