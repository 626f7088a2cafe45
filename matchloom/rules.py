"""Fixed values.

Word lists, patterns, limits and message formats that decide results. They are
plain text on purpose: change them here and nowhere else.
"""

from __future__ import annotations

# --- characters -----------------------------------------------------------
# Line breaks and other white space, as Python's str.splitlines / str.strip
# see them (Java regex class bodies; single characters are matched faster than ranges and properties).
LINE_BREAKS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = r"\t\x1f\p{Zs}"
SPACE = LINE_BREAKS + BLANKS
# The same set as characters, for trimming.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))
) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"

# --- section headings -----------------------------------------------------
# (section, kind of match, cues); tested from top to bottom on the lower-cased line.
JD_HEADINGS = [
    ("responsibilities", "contains", ["responsibilit", "what you'll do"]),
    ("requirements", "contains", ["requirement", "qualifications", "what you'll bring"]),
    ("skills", "contains", ["skill", "technolog", "tool"]),
]
RESUME_HEADINGS = [
    ("summary", "prefix", ["professional summary", "summary"]),
    ("experience", "contains", ["experience"]),
    ("education", "prefix", ["education"]),
    ("skills", "prefix", ["skill"]),
    ("projects", "prefix", ["project"]),
]
STYLE_HEADINGS = [
    ("summary", "prefix", ["summary", "profile", "about"]),
    ("experience", "prefix", ["experience", "employment", "work history"]),
    ("skills", "prefix", ["skill", "competenc", "technolog"]),
    ("projects", "prefix", ["project", "portfolio"]),
    ("education", "prefix", ["education", "academ"]),
]
DEFAULT_SECTION_ORDER = ["summary", "skills", "experience", "projects", "education"]

# --- parsing --------------------------------------------------------------
JD_ROLE_PATTERN = rf"(?im)^role[:\-][{BLANKS}]*([^\n]*)"
BULLETS = r"•\-*"
BULLET_STYLES = {"•": "bullet", "-": "dash", "*": "asterisk"}
JD_SUMMARY_CHARS = 2000
UNKNOWN_TITLE = "Unknown Role"
UNKNOWN = "Unknown"
DEFAULT_SOURCE = "upload"
DEFAULT_OUTCOME = "interview"
REDACTED = "[REDACTED]"

# --- personal data --------------------------------------------------------
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\b(?:\+?\d{1,3})?[\s-]?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{4}\b"

# --- style ----------------------------------------------------------------
DEFAULT_FONT = "Calibri"
DEFAULT_FONT_SIZE = 22  # half points
MAX_POINT_SIZE = 20  # at most this: points, doubled to half points
HEADING_MAX_CHARS = 40
UPPER_SHARE = 0.6
TITLE_SHARE = 0.5
CONDENSED_OVER_LINES = 120
SPACIOUS_UNDER_LINES = 60
SPACING_AFTER = {"condensed": 40, "spacious": 120}
DEFAULT_SPACING_AFTER = 80
MIN_FONT_SIZE = 10
HEADER_SIZE_DELTA = 4
DIVIDER = "―" * 20
BULLET_SYMBOLS = {"dash": "-", "asterisk": "*"}
DEFAULT_BULLET_SYMBOL = "•"

# --- retrieval ------------------------------------------------------------
NEIGHBOURS = 10
KEPT_CHUNKS = 20
EVIDENCE_CHARS = 80

# --- validation -----------------------------------------------------------
REQUIRED_SECTIONS = ["summary", "experience", "skills"]
MAX_BULLET_CHARS = 500
BULLET_EXCERPT_CHARS = 50
MAX_COVER_CHARS = 4000
COVER_TONES = ["professional", "enthusiastic", "formal", "friendly"]

# --- scoring --------------------------------------------------------------
CONSISTENCY_SHARE = 0.6
CONSISTENCY_MIN = 3.0
EMPTY_TEXT_GRADE = 12.0
MIN_GRADE = 1.0
GATE_COVERAGE = 0.7
GATE_KEYWORDS = 0.6
GATE_WORDS = 1000

# --- jobs -----------------------------------------------------------------
ARTIFACT_TTL_DAYS = 7
STUCK_AFTER_SECONDS = 15 * 60
ALARM_WINDOW = "5 minutes"

# --- prompts --------------------------------------------------------------
PROMPT_STAGES = [
    "competency_extraction",
    "experience_alignment",
    "bullet_rewrite",
    "skills_harmonization",
    "consistency_check",
]
DEFAULT_TONE = "professional"
DEFAULT_LENGTH = "2 pages"
TEMPERATURE = 0.3
MAX_TOKENS = 2000
