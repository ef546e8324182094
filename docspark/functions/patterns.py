"""The patterns that find names and ID numbers.

The ``LITERAL`` forms match inside words as well; the default forms start and stop at word
borders. Borders are spelled out as Unicode classes so that they do not depend on the Java
version.
"""

WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

# --- labelled fields in running text ----------------------------------------------------
FLAGS = "(?imd)"

NAME_STOPS = ["ROLL", "PROGRAM", "SEMESTER", "COURSE"]
NAME_STRICT = (
    FLAGS + WORD_START + r"(?<!&\s)NAME\s*:\s*([A-Z][A-Za-z\s]+?)(?=\n|$"
    + "".join(f"|{WORD_START}{w}" for w in NAME_STOPS) + ")"
)
NAME_STRICT_LITERAL = FLAGS + r"NAME\s*:\s*([A-Z][A-Za-z\s]+?)(?=\n|$" + "".join(f"|{w}" for w in NAME_STOPS) + ")"
NAME_FLEXIBLE = (
    FLAGS + WORD_START + r"(?<!&\s)(?:STUDENT\s+)?NAME\s*[:\s]+\s*([A-Z][A-Za-z\s]+?)(?=\n"
    + f"|{WORD_START}ROLL|{WORD_START}PROGRAM" + "|$)"
)
NAME_FLEXIBLE_LITERAL = r"(?imd)(?:STUDENT\s+)?NAME\s*[:\s]+\s*([A-Z][A-Za-z\s]+?)(?=\n|ROLL|PROGRAM|$)"
ROLL_STRICT = r"(?imd)ROLL\s*(?:NUMBER|NO\.?)\s*:\s*([\d\-\s]{8,20}?)(?=\n|$|PROGRAM|COURSE|SEMESTER|STUDENT)"
ROLL_FLEXIBLE = (
    r"(?imd)(?:ROLL\s*(?:NUMBER|NO)|ENROLLMENT\s+(?:NUMBER|NO)|REGISTRATION|STUDENT\s*ID|REG\s*(?:NUMBER|NO))"
    r"\s*[:\s]+\s*([\d\-\s]{8,20}?)(?=\n|PROGRAM|COURSE|SEMESTER|$)"
)

# --- label walk over text nodes ---------------------------------------------------------
SHORT_WALK = {
    "name_label": r"(?i)^(NAME|STUDENT\s+NAME|SUBMITTED\s+BY|AUTHOR)\s*:?\s*(.*)$",
    "roll_label": r"(?i)^(ROLL\s*NO|ROLL\s*NUMBER|STUDENT\s*ID|ENROLLMENT\s*NO)\s*:?\s*(.*)$",
    "name_text": r"(?i)(?:NAME|STUDENT\s+NAME|SUBMITTED\s+BY)\s*[:–-]?\s*([A-Z][A-Za-z]+\s+[A-Z][A-Za-z]+)",
    "roll_text": r"(?i)(?:ROLL|ENROLLMENT|ID)\s*[:–-]?\s*(\d{6,15})",
    "name_weak": WORD_START + r"([A-Z][A-Za-z]+\s+[A-Z][A-Za-z]+)" + WORD_END,
}
FULL_WALK = {
    "name_label": r"(?i)^(NAME|STUDENT\s+NAME|SUBMITTED\s+BY|AUTHOR|SIGNED\s+BY)\s*:?\s*(.*)$",
    "roll_label": r"(?i)^(ROLL\s*NUMBER|ROLL\s*NO|STUDENT\s*ID|ENROLLMENT\s*NO|STUDENT\s*CODE)\s*:?\s*(.*)$",
    "name_text": (
        r"(?i)(?:NAME|STUDENT NAME|SUBMITTED BY|AUTHOR|SIGNED BY)\s*[:\-]?\s*([A-Z][A-Za-z]*\s+[A-Z][A-Za-z]*)"
    ),
    "roll_text": (
        r"(?i)(?:ROLL\s*NUMBER|ROLL\s*NO|STUDENT\s*ID|ENROLLMENT\s*NO|STUDENT\s*CODE)\s*[:\-]?\s*(\d{6,15})"
    ),
    "name_weak": WORD_START + r"([A-Z][A-Za-z]*\s+[A-Z][A-Za-z]*)" + WORD_END,
}
ROLL_VALUE = r"^\d{6,15}$"
ROLL_WEAK = WORD_START + r"(\d{6,15})" + WORD_END

# --- e-mail addresses: no dot in front, no two dots in a row ----------------------------
EMAIL = r"^(?!\.)(?!.*\.\.)[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+\-]@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$"

# --- paragraphs of an assignment (white space collapsed, lower case) ---------------------
QUESTION = r"^q\s*\d+[\.:]*|^question\s+\d+"
ANSWER = r"^a\s*\d+[\.:]*|^answer\s+\d+"
HEADING_WORDS = ["assignment", "set"]
