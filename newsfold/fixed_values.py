"""Word lists, limits and names that results depend on."""

import string

# General settings.
SEED = 42
MAX_TOKENS = 256
TRIALS = 10
MAX_FEATURES_ONE_LANGUAGE = 30000
MAX_FEATURES_MANY_LANGUAGES = 90000
HOLDOUT_FRACTION = 0.10

# Title length band, both ends excluded, and the size of the news samples.
MIN_TITLE_LENGTH = 45
MAX_TITLE_LENGTH = 185
NEWS_SAMPLE_SIZE = 15000

# Language name to ISO code.
LANGUAGE_CODES = {"English": "en", "Dutch": "nl", "Italian": "it"}

# Registered domain to display name.
DOMAIN_NAMES = {
    "nos.nl": "NOS (nl)",
    "huffingtonpost.com": "The Huffington Post (en)",
    "theonion.com": "The Onion (en)",
    "lercio.it": "Lercio (it)",
    "speld.nl": "De Speld (nl) ",
    "ilgiornale.it": "Il Giornale (it)",
}

# Public suffixes of those domains; callers pass more where they need them.
DOMAIN_SUFFIXES = ("nl", "it", "com")

# Titles that name a section of a site, not an article.
SECTION_TITLES = ("De Speld Sport", "De Pin")

# Words that mark a picture or video credit in front of the article text.
MEDIA_CREDIT_WORDS = ("Shutterstock", "shutterstock", "Youtube", "youtube", "Wikimedia", "VIDEO")

# Image endings dropped from the dataset, and image marks dropped from site maps.
IMAGE_URL_SUFFIXES = (".jpeg", ".png")
IMAGE_LINK_MARKS = (".jpg", ".jpeg", ".png")

# HTTP codes of a usable response.
OK_STATUS = (200, 201)

# Tags and lower-case entities removed from page text.
MARKUP_PATTERN = "<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});"

# A paragraph, closed, or ended by the next one or by the end of a block or of the page.
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?p[\s>]|</(?:div|td|li|section|main|body|html)\s*>|\z)"

# The 32 ASCII punctuation marks, and every character Python's strip() removes.
ASCII_PUNCTUATION = string.punctuation
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# One string of a printed Python list of strings.
RENDERED_TOKEN = r"""(?s)'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""

# Terms of the TF-IDF vocabulary: runs of two or more word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# First letter of a part-of-speech tag to word class; all other tags are nouns.
WORD_CLASSES = {"J": "a", "V": "v", "R": "r"}
DEFAULT_WORD_CLASS = "n"

# Search space of the SVM.
SVM_KERNELS = ("linear", "poly", "rbf", "sigmoid")
SVM_C_RANGE = (0.01, 10.0)
SVM_DEGREES = (1, 2, 3, 4, 5)

# Treebank word splitting: (pattern, replacement), applied in this order. Text
# without marks, mark pairs and contracted words is only changed by the rules
# for a period at the end and for commas.
TREEBANK_MARKS = r"[^\p{L}\p{N}\s.,_-]"
TREEBANK_MARK_PAIRS = ("--", "..")
CONTRACTED_WORDS = ("cannot", "d'ye", "gimme", "gonna", "gotta", "lemme", "more'n", "wanna", "'tis", "'twas")
TREEBANK_PERIOD_AND_COMMA = (
    (r"""([^.])(\.)([\])}>"'»”’ ]*)\s*$""", r"\1 \2 \3 "),
    (r"([:,])([^\p{Nd}])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
)
TREEBANK_BEFORE_PADDING = (
    (r"([«“‘„]|`+)", r" \1 "),
    (r'^"', "``"),
    (r"(``)", r" \1 "),
    (r"""([ (\[{<])("|'{2})""", r"\1 `` "),
    (r"'([a-ce-lo-ru-zA-CE-LO-RU-Z0-9_\x{C0}-\x{24F}])([^\p{L}\p{N}_]|$)", r"' \1\2"),
    *TREEBANK_PERIOD_AND_COMMA,
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    (r"""([^.])(\.)([\])}>"']*)\s*$""", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([*])", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", r" -- "),
)
TREEBANK_CLOSING_QUOTES = (
    (r"([»”’])", r" \1 "),
    (r'"', r" '' "),
    (r"([^\s])('')", r"\1 \2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
)
# Abbreviations that keep their period inside a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "gov", "capt", "lt", "sgt", "rev",
    "vs", "etc", "inc", "ltd", "corp", "vol", "fig", "approx", "dept", "u.s", "u.k", "e.g", "i.e", "a.m", "p.m",
)
# A period that may end a sentence stands behind a character that is neither white space nor a period, and before white
# space. The word in front of it: letters and digits, with single periods inside.
SENTENCE_END = r"[^.\s]\.\s"
PERIOD_OF_SENTENCE_END = r"\.(?<=[^.\s]\.)(?=\s)"
LAST_WORD = r"(?:^|[^\p{L}\p{N}_.'’])([\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*)\.\z"
# Words with the period behind them, for the measure of abbreviations; its published constants.
PERIOD_WORD = r"\p{L}[\p{L}\p{N}'’-]*(?:\.\p{L}[\p{L}\p{N}'’-]*)*(?:\.(?!\.))?"
ABBREVIATION_CHANCE = 0.99
ABBREVIATION_SCORE = 0.3
TREEBANK_CONTRACTIONS = (
    (r"(?i)([^\p{L}\p{N}_])(can)(not)(?=[^\p{L}\p{N}_])", r"\1\2 \3"),
    (r"(?i)([^\p{L}\p{N}_])(d)('ye)(?=[^\p{L}\p{N}_])", r"\1\2 \3"),
    (r"(?i)([^\p{L}\p{N}_])(gim)(me)(?=[^\p{L}\p{N}_])", r"\1\2 \3"),
    (r"(?i)([^\p{L}\p{N}_])(gon)(na)(?=[^\p{L}\p{N}_])", r"\1\2 \3"),
    (r"(?i)([^\p{L}\p{N}_])(got)(ta)(?=[^\p{L}\p{N}_])", r"\1\2 \3"),
    (r"(?i)([^\p{L}\p{N}_])(lem)(me)(?=[^\p{L}\p{N}_])", r"\1\2 \3"),
    (r"(?i)([^\p{L}\p{N}_])(more)('n)(?=[^\p{L}\p{N}_])", r"\1\2 \3"),
    (r"(?i)([^\p{L}\p{N}_])(wan)(na)(?=\s)", r"\1\2 \3"),
    (r"(?i) ('t)(is)(?=[^\p{L}\p{N}_])", r" \1 \2"),
    (r"(?i) ('t)(was)(?=[^\p{L}\p{N}_])", r" \1 \2"),
)
TREEBANK_AFTER_PADDING = TREEBANK_CLOSING_QUOTES + TREEBANK_CONTRACTIONS

# Undefined precision and recall in the records of SVM runs.
SVM_ZERO_DIVISION = 1.0
