"""Values that results depend on: patterns, word lists, limits and file formats. Regular expressions are for Java."""

# Fixed values.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "St", "Jr", "Sr", "Capt", "Col", "Gen", "Lt", "Rev", "Prof", "No", "Mt", "vs", "etc")
SENTENCE_BREAK = r"""(?<=[.!?])["”’')\]]*\s+(?=["“‘'(\[]?[A-Z0-9])"""
CHAPTER_HEADING = (
    r"^[ \t]*(?:CHAPTER|Chapter|BOOK|Book|PART|Part|LETTER|Letter)[ \t]+"
    r"(?:[IVXLCDM]+|\d+|[A-Z][a-z]+(?:-[a-z]+)?|[A-Z]+)\b[^\n]{0,80}$"
)
ROMAN_HEADING = r"^[ \t]*[IVXLC]{1,7}\.?[ \t]*$"
ARCHIVE_START = r"(?is)\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*"
ARCHIVE_END = r"(?i)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG"
TITLE_LINE = r"(?m)^Title:\s*(.+)$"
DEFINITION = (
    r"(?i)\b(?:is|was|are|were)\s+(?:a|an|the|one of)\b|\bmeans?\b|\bcalled\b|\bnamed\b|"
    r"\bknown as\b|\bconsist(?:s|ed)? of\b|\bdescribed as\b|\bkind of\b|\bsort of\b"
)
PROPER_NOUN = r"\b[A-Z][a-zA-Z'’\-]+(?:\s+(?:of\s+|de\s+|la\s+|von\s+|van\s+)?[A-Z][a-zA-Z'’\-]+)*"
#: What a sentence with a candidate term has at least: a digit, a name after its first character, or a first word that is
#: more than letters. A first name alone is none. Most characters fail the first class; what stands before is tried after it.
MAYBE_TERM = r"[0-9A-Z](?:(?<=[0-9])|(?<=[\s\S]\b[A-Z])[a-zA-Z'’\-]|(?<=^[A-Z])[a-zA-Z]*['’\-])"
_BREAK = r"""["”’')\]]{0,3}\s{1,2}"""
#: What a text of any sentences and lines has at least if one of its sentences has MAYBE_TERM: a digit, a word with a capital
#: and a sign of MAYBE_TERM, or one that begins neither a line nor a sentence. The dot of an abbreviation ends no sentence;
#: after more closing signs and spaces than are tried here a word counts as one that begins none.
MAYBE_TERMS = (
    r"[0-9A-Z](?:(?<=[0-9])|(?<=\b[A-Z])(?:[a-zA-Z]*+['’\-]|(?<=[\s\S][A-Z])"
    rf"(?:(?<![.!?]{_BREAK}[A-Z])(?<!\n[A-Z])|(?<=(?<=\b(?:{'|'.join(ABBREVIATIONS)}))\.{_BREAK}[A-Z]))[a-zA-Z]))"
)
NUMBER = r"\b\d{1,4}(?:[,.]\d{1,3})?\b"
FOOTNOTE_MARKER = r"\s?\[\d{1,3}\]"
FOOTNOTE_START = r"^\s*\[\d{1,3}\]"
EDITORIAL = r"(?i)Project Gutenberg|Transcriber|\bcorrected to\b|^Page \d+\s*:|HTML version|contains the index"
#: Small letters of which a text has at least one if EDITORIAL is in it.
EDITORIAL_PARTS = ("project gutenberg", "transcriber", "corrected to", "page ", "html version", "contains the index")
FIGURE_START = r"^(?:\d|[IVXLC]+\.|[IVXLC]+\)|§|\)|[a-z])"
ROMAN_TERM = r"^[IVXLC]+(?:st|nd|rd|th)?$"
QUOTED = r"""["“][^"”]*["”]"""
MEASURE_WORDS = (
    "feet foot ft inches inch yards miles mile years year days months ducats sequins guineas pounds men ships arches pillars shafts steps degrees"
).split()
STOP_TERMS = (
    "i i'm i'll i've i'd the a an he she it we they you his her my our your their this that these those there here then but and or "
    "so yet if when while what who whom which why how where oh ah yes no not mr mrs ms dr sir madam miss lord lady god chapter one two "
    "monday tuesday wednesday thursday friday saturday sunday english french however now well after before as at in on for with all "
    "some every o ay aye nay let do did had has have is was be upon said thus once ominously him good power space senses maker "
    "accordingly plate fig figure page appendix volume vol preface note notes see compare vide ibid section chap first second third "
    "fourth fifth sixth seventh eighth ninth tenth hundred thousand"
).split()
REFUSALS = (
    r"\bi (?:do not|don't|dont) know\b",
    r"\bi(?:'m| am) not (?:sure|aware|familiar)\b",
    r"\bi (?:cannot|can't|can not) (?:answer|determine|find|provide|recall)\b",
    r"\b(?:no|not enough) information\b",
    r"\bunable to (?:answer|determine|find|provide)\b",
    r"\bi do not have (?:access|information|knowledge)\b",
    r"\bnot (?:mentioned|specified|provided) in\b",
)
LETTER_START = r"(?i)^\W*(?:the\s+)?(?:correct\s+)?(?:answer|option)?\s*(?:is)?\s*:?\s*\(?([A-D])\)?(?:[\s).:,]|$)"
LETTER_ANY = r"(?i)\b(?:answer|option)\s*(?:is\s*)?:?\s*\(?([A-D])\b"
MIN_FOOTNOTE_WORDS = 15
MIN_CHAPTER_CHARS, MIN_FRONT_CHARS = 1000, 5000
MIN_BOOK_CHARS = 50_000
CHARS_PER_PAGE = 1800
MIN_UNITS, MAX_UNITS, TARGET_UNITS = 300, 500, 400
QUESTIONS = {"knowledge": 100, "practical": 15, "trap": 60}
MAX_ANSWER_TOKENS = {"knowledge": 48, "trap": 64, "practical": 200}
BASELINE_MAX_CORRECT, TARGET_AFTER_CORRECT, MAX_MADE_UP = 10, 85, 4
MIN_AGREEMENT = 0.8
TIME_LIMIT_S = 120
BLANK = "____"
NO_ANSWER = "(no answer)"
EXCERPT = 160
EOF_MARK = "\ue000"
