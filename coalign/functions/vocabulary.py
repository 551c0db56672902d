"""Word lists and patterns of the normalization rules.

Fixed values: results depend on each of them, so they are stated as they are.
Engines take them as defaults of parameters.
"""

# Legal forms and name abbreviations, token to canonical token(s).
LEGAL_FORMS = {
    "pvt": "private",
    "pvtltd": "private limited",
    "prv": "private",
    "priv": "private",
    "ltd": "limited",
    "ltda": "limited",
    "lmt": "limited",
    "ld": "limited",
    "inc": "incorporated",
    "incorp": "incorporated",
    "incorporation": "incorporated",
    "corp": "corporation",
    "corpn": "corporation",
    "co": "company",
    "cos": "company",
    "companies": "company",
    "cmpny": "company",
    "cie": "company",
    "compagnie": "company",
    "ste": "societe",
    "groupe": "group",
    "sasu": "sas",
    "eurl": "sarl",
    "frs": "freres",
    "ets": "etablissements",
}

# Tokens that are a legal form.
LEGAL_TOKENS = [
    "private", "limited", "incorporated", "corporation", "company", "llc", "pllc", "llp", "plc", "lp", "pc", "opc", "huf", "public",
    "societe", "sarl", "sas", "sasu", "sa", "sci", "eurl", "snc", "scp", "scop", "sca", "selarl", "gie", "ei",
]

# Connecting words of names, and titles at their start.
NAME_STOP_WORDS = ["and", "the", "of", "&", "de", "du", "des", "la", "le", "les", "et", "d", "l"]
TITLES = ["m", "s", "ms", "mr", "mrs", "sri", "shri", "shree", "smt", "dr"]

# Street and place words, token to abbreviation (empty: dropped).
STREET_WORDS = {
    # English
    "street": "st", "str": "st", "saint": "st", "road": "rd", "avenue": "ave", "av": "ave", "drive": "dr", "lane": "ln", "court": "ct", "boulevard": "blvd", "bd": "blvd", "blv": "blvd",
    "highway": "hwy", "place": "pl", "circle": "cir", "parkway": "pkwy", "terrace": "ter", "square": "sq", "trail": "trl", "suite": "ste", "apartment": "apt",
    "north": "n", "south": "s", "east": "e", "west": "w", "mount": "mt", "fort": "ft", "center": "ctr", "centre": "ctr", "expressway": "expy", "freeway": "fwy",
    # India
    "near": "nr", "opposite": "opp", "oppo": "opp", "floor": "flr", "building": "bldg", "bldng": "bldg", "society": "soc", "sector": "sec", "nagar": "ngr", "colony": "col",
    "district": "dist", "dt": "dist", "taluk": "tq", "taluka": "tq", "tehsil": "teh", "village": "vill", "vil": "vill", "post": "po", "cross": "crs", "industrial": "indl", "ind": "indl",
    "estate": "est", "complex": "cmplx", "apartments": "apt", "appartment": "apt", "appartments": "apt",
    # France
    "r": "rue", "chemin": "ch", "impasse": "imp", "allee": "all", "route": "rte", "faubourg": "fg", "sainte": "ste", "cedex": "", "bis": "", "ter": "", "quai": "qu", "cours": "crs", "residence": "res",
}

# Address words without identity.
ADDRESS_STOP_WORDS = [
    "no", "nos", "number", "num", "h", "hno", "house", "door", "dno", "plot", "flat", "shop", "unit", "the", "of", "and", "de", "du", "des", "la", "le", "les", "d", "l", "c", "o",
    "po", "box", "region", "suburban", "dcp", "null", "na", "nil", "none", "at", "via",
]

# Patterns of names, in the order in which they are applied; pattern, replacement, every match or the first.
NATIVE_SCRIPT = "[\\u0900-\\u0DFF]"
NAME_RULES = [
    ("N04", r"^[\s\-<>.#*~_|=+,:;!\"'`()\[\]]+", ""),
    ("N05", r"^m\s*/\s*s\.?\s*", ""),
    ("N06", r"^(https?://)?(www\.)?", ""),
    ("N07", r"\.(com|co\.in|in|net|org|co|fr|us|biz|info)$", ""),
    ("N08", r"[&+]", " and "),
    ("N09", r"\b([a-z])\.([a-z])\b\.?", "$1$2"),
    ("N09", r"\b([a-z]{2})\.([a-z])\b\.?", "$1$2"),
    ("N10", r"\bp\s*\.?\s*l\s*\.?\s*l\s*\.?\s*c\b\.?", " pllc "),
    ("N10", r"\bl\s*\.?\s*l\s*\.?\s*c\b\.?", " llc "),
    ("N10", r"\bl\s*\.?\s*l\s*\.?\s*p\b\.?", " llp "),
    ("N10", r"\bp\s*\.\s*c\b\.?", " pc "),
]
# Fixed value: what stands between a name and the one it also trades under.
OTHER_NAME = (
    r"^(.*?)\s+(?:d\s*[./]?\s*b\s*[./]?\s*a|a\s*[./]?\s*k\s*[./]?\s*a|f\s*[./]?\s*k\s*[./]?\s*a|t\s*/\s*a"
    r"|trading as|doing business as|formerly known as|formerly|nee)\b\s*[.:]?\s*(.+)$"
)
# Ordinals, digits that stand for letters and the letters, null markers of addresses.
ORDINAL = "^[0-9]+(st|nd|rd|th)$"
DIGIT_LOOKS = ("013458", "oleasb")
NULL_ADDRESS = r"<\s*null\s*>|\bnull\b|\bn\s*/\s*a\b|\bnot available\b"

# Sound rules of the consonant skeleton, applied one after another.
SKELETON_RULES = [
    ("ph", "f"), ("x", "ks"), ("ck", "k"), ("c", "k"), ("q", "k"), ("w", "v"), ("z", "j"), ("y", "i"),
    ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("m", "n"),
]

# How many pairs a key may make, by type of key.
PAIR_CAPS = {"t": 40_000, "b": 200_000, "c": 200_000, "p": 20_000, "s": 20_000, "a": 20_000, "d": 20_000, "x": 20_000, "y": 20_000, "e": 40_000}
KEY_TYPES = tuple(PAIR_CAPS)

#: Latin letters that a plain character map folds, and those that become two.
LATIN_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
LATIN_TO = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"
LATIN_TWO = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE"}
