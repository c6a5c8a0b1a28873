"""Fixed values of the field-reading rules."""

# They decide results and are stated as such.
DATE_VOCABULARY = "0123456789/-."
FULL_VOCABULARY = "0123456789/-.ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # a character's place is its class
PIN_VOCABULARY = "0123456789"

# How much less likely a visually confused pair is than a listed alternative (natural log scale).
AFFINITY = (
    ("O", "Q", -0.2),
    ("D", "P", -0.3),
    ("M", "H", -0.4),
    ("E", "F", -0.3),
    ("2", "9", -0.3),
    ("8", "0", -0.4),
    ("8", "2", -0.5),
    ("1", "7", -0.4),
    ("1", "9", -0.5),
    ("4", "2", -0.6),
    ("4", "6", -0.5),
)

# A letter or sign read where a digit must stand, and the digit it is taken for.
DIGIT_FOR = {"Z": "2", "O": "0", "D": "0", "I": "1", "L": "1", "S": "5", "B": "8", ".": "2", "-": "1"}

# Scores of the lexicon search.
PIN_MISMATCH, PREFIX_MISMATCH, PIN_FLOOR, LEAST_PROBABILITY = -4.5, -4.0, -8.0, 1e-4

# Confidence levels of the decoders and verifiers, and the gate.
DATE_VALID, DATE_INVALID = 0.96, 0.65
PIN_SNAPPED, PIN_FAR = 0.96, 0.70
CODE_EXACT, CODE_SNAPPED, CODE_FALLBACK = 0.96, 0.95, 0.92
VERIFIED = {"date": 0.95, "code": 0.96, "pin": 0.97, "other": 0.90}
FUSION_BOUND, GATE, THRESHOLDS = 0.85, 0.85, (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)

MASKED_LOGIT = -1e9
DEFAULT_LENGTH = {"date": 10, "pin": 6, "code": 8, "other": 8}
MODES = ("raw_cnn", "grammar_fsm", "tri_engine")


def affinity_rows() -> list[tuple[str, str, float]]:
    """Both directions of each pair."""
    return [(a, b, s) for a, b, s in AFFINITY] + [(b, a, s) for a, b, s in AFFINITY]
