"""Word lists, weights, labels and limits that decide the results.

Everything here is data.  Rules that use it live in ``functions`` and ``operators``.
"""

# --- Fixed values: characters that count as white space when a field is stripped -------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: field contents that mean "missing" in a message file ----------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: keyword lists; every keyword is counted on its own ------------------
KEYWORDS = {
    "urgency": ["urgent", "immediately", "asap", "important", "now", "quick"],
    "trust": ["trust", "confidential", "secure", "official", "verified"],
    "social_proof": [
        "everyone", "everybody", "all colleagues", "team already", "already approved",
        "already done",
    ],
    "reciprocity": [
        "favor", "in return", "i helped you", "return the favor", "ricambia", "per favore",
    ],
    "commitment": [
        "as promised", "as agreed", "as discussed", "you said", "come concordato",
        "come promesso",
    ],
    "liking": [
        "dear friend", "dear colleague", "you are the best", "appreciate you", "caro amico",
        "ti stimo",
    ],
    "fear": [
        "account suspended", "account blocked", "legal action", "penalty", "breach",
        "sospeso", "bloccato",
    ],
}

# --- Fixed values: pattern families; alternatives of one case-blind pattern each -------
PATTERNS = {
    "urgency": ["urgent", "asap", "now", "immediately"],
    "authority": ["manager", "director", "admin", "it"],
    "social_proof": [
        "everyone", "everybody", "all colleagues", "already approved", "already done",
        "tutti",
    ],
    "reciprocity": [
        "favor", "in return", "return the favor", "i helped you", "ricambia", "per favore",
    ],
    "commitment": [
        "as promised", "as agreed", "as discussed", "you said", "come concordato",
        "come promesso",
    ],
    "liking": [
        "dear friend", "dear colleague", "you are the best", "appreciate you", "caro amico",
        "ti stimo",
    ],
    "fear": [
        "account suspended", "account blocked", "legal action", "penalty", "breach",
        "sospeso", "bloccato",
    ],
}

# --- Fixed values: default weights; their order decides ties between drivers -----------
DEFAULT_WEIGHTS = {
    "urgency_score": 0.18,
    "authority_score": 0.15,
    "semantic_signal": 0.12,
    "text_length_signal": 0.08,
    "sentiment_risk_signal": 0.08,
    "trust_score": 0.06,
    "social_proof_score": 0.10,
    "reciprocity_score": 0.08,
    "commitment_score": 0.07,
    "liking_score": 0.04,
    "fear_score": 0.04,
}

# --- Fixed values: display names of the features ---------------------------------------
FEATURE_LABELS = {
    "urgency_score": "Urgency",
    "authority_score": "Authority",
    "semantic_signal": "Semantic",
    "text_length_signal": "Text Length",
    "sentiment_risk_signal": "Sentiment",
    "trust_score": "Trust",
    "social_proof_score": "Social Proof",
    "reciprocity_score": "Reciprocity",
    "commitment_score": "Commitment",
    "liking_score": "Liking",
    "fear_score": "Fear",
}
FEATURES = list(FEATURE_LABELS)

# --- Fixed values: features that are counts and saturate; the others are clipped -------
COUNT_FEATURES = [
    "urgency_score", "authority_score", "trust_score", "social_proof_score",
    "reciprocity_score", "commitment_score", "liking_score", "fear_score",
]

# --- Fixed values: risk bands (lower edge inclusive, upper edge exclusive) -------------
BANDS = [("Low", 0.0, 0.4), ("Medium", 0.4, 0.7), ("High", 0.7, 1.01)]
BAND_COLORS = {"Low": "#377eb8", "Medium": "#ff7f00", "High": "#e41a1c"}
UNKNOWN_BAND_COLOR = "#888"
THRESHOLD_LINES = [(0.4, "Med/Low"), (0.7, "High/Med")]

# --- Fixed values: triage --------------------------------------------------------------
TRIAGE_STATUSES = ["new", "in_progress", "mitigated", "false_positive"]
TRIAGE_OPEN = ["new", "in_progress"]
TRIAGE_PRIORITIES = [("P1", 0.90, 4), ("P2", 0.80, 12), ("P3", None, 24)]
TRIAGE_MIN_RISK = 0.70
TRIAGE_MAX_ITEMS = 250
TRIAGE_CREATED_DETAILS = "Inserito automaticamente dal run"
MAX_NOTES = 25
MAX_ACTIVITY = 50
NOTE_EXCERPT = 120

# --- Fixed values: limits --------------------------------------------------------------
KPI_TIMELINE_MAX = 200
AUDIT_TAIL = 500
MAX_BULK_IDS = 250
ENCODER_BATCH = 64

# --- Fixed values: starter sentiment lexicon (valence from -4 to 4); pass a full table instead.
# Many valences, the booster step, the negation factor and alpha are those of the published VADER lexicon.
SENTIMENT_LEXICON = {
    "good": 1.9, "great": 3.1, "best": 3.2, "better": 1.9, "excellent": 2.7, "nice": 1.8,
    "happy": 2.7, "love": 3.2, "like": 1.5, "glad": 2.0, "thanks": 1.9, "thank": 1.5,
    "please": 1.3, "welcome": 2.0, "win": 2.8, "winner": 2.8, "free": 2.3, "safe": 1.9,
    "secure": 1.4, "trust": 2.3, "confident": 2.2, "important": 0.8, "approved": 1.8,
    "favor": 1.7, "friend": 2.2, "dear": 1.6, "appreciate": 1.7, "helped": 1.8,
    "help": 1.7, "agreed": 1.1, "promised": 1.5, "promise": 1.3, "verified": 1.0,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "terrible": -2.1, "awful": -2.0,
    "hate": -2.7, "angry": -2.3, "sad": -2.1, "fear": -2.2, "afraid": -2.0,
    "threat": -2.4, "threaten": -1.6, "danger": -2.4, "penalty": -2.0, "breach": -1.7,
    "suspended": -1.6, "blocked": -1.1, "fraud": -2.8, "scam": -2.7, "stolen": -2.2,
    "lost": -1.3, "fail": -2.5, "failed": -2.3, "error": -1.7, "problem": -1.7,
    "wrong": -2.1, "urgent": -0.8, "warning": -1.4, "sospeso": -1.6, "bloccato": -1.1,
}
SENTIMENT_NEGATORS = [
    "not", "no", "never", "none", "nothing", "neither", "nor", "without", "cannot",
    "can't", "don't", "doesn't", "didn't", "isn't", "wasn't", "won't", "non", "mai",
]
SENTIMENT_BOOSTERS = {
    "very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "totally": 0.293,
    "most": 0.293, "highly": 0.293, "slightly": -0.293, "somewhat": -0.293,
    "barely": -0.293, "hardly": -0.293,
}
SENTIMENT_NEGATION_FACTOR = -0.74
SENTIMENT_ALPHA = 15.0
SENTIMENT_LOOKBACK = 3

# --- Our own phrases planted in front of the test documents ----------------------------
PLANTED_PHRASES = [
    "URGENT now immediately: as the IT admin and director, everyone everybody already "
    "approved. Trust this official secure confidential note. Return the favor in return. "
    "As promised, as agreed, dear friend. Breach, penalty, legal action. ",
    "Urgent: the manager needs this now, it is confidential and official. Everyone already "
    "approved, as discussed. ",
    "Dear colleague, as agreed please do me a favor. ",
    "Account suspended! Legal action pending, act immediately. ",
    "Per favore, come promesso, tutti sono pronti. ",
    "Important and quick: verified and secure, trust IT. ",
    "", "", "", "", "", "",
]
