"""Fixed values.

Word lists, tables, defaults and output formats that have to be exactly these for
results to be right.  Everything else in the package takes them as parameters.
"""

# --- fixed values: states and layers ------------------------------------------------
STATUSES = ["pending", "crawled", "translated", "formatted", "exported", "error"]
DONE_STATUSES = ["translated", "formatted", "exported"]
PHASE_STATUS = {"crawl": "pending", "translate": "crawled", "format": "translated"}
ACTIVE_JOB_STATUSES = ["running", "pending"]

# --- fixed values: glossary categories, in order, with their headings -----------------
CATEGORIES = [
    "character",
    "realm",
    "technique",
    "location",
    "item",
    "organization",
    "general",
]
CATEGORY_HEADINGS = {
    "character": "Nhân vật",
    "realm": "Cảnh giới",
    "technique": "Võ công/Pháp thuật",
    "location": "Địa danh",
    "item": "Vật phẩm",
    "organization": "Môn phái/Thế lực",
    "general": "Thuật ngữ chung",
}
UNKNOWN_CATEGORY_PRIORITY = 99
DEFAULT_CATEGORY = "general"
NO_KNOWN_TERMS = "(chưa có)"

# --- fixed values: text markers -------------------------------------------------------
PARAGRAPH_BREAK = "\n\n"
SENTENCE_ENDS = "。！？"
QUOTE_MARKS = ['"', "「", "」"]
CURLY_QUOTE_MARKS = ["“", "”"]
ATTRIBUTION_WORDS = ["说道", "道：", "说：", "问道", "笑道", "叫道"]
NAVIGATION_WORDS = ["上一章", "下一章", "目录", "返回", "首页"]
NAMING_KEYWORDS = ["tên", "nhân vật", "địa danh", "chức danh", "vật phẩm", "name", "character"]
DEFAULT_NAMING_RULE = (
    "**Quy tắc dịch tên**: Dịch tên nhân vật và địa danh theo phiên âm Hán-Việt "
    "(ví dụ: 陈平安 → Trần Bình An)."
)
NAMING_HEADING = "**Quy tắc dịch tên từ style '{name}':**"
STATE_MARKER = "---STATE---"
# Where a reply has its JSON: in a fenced block, from brace to brace, from bracket to bracket.
FENCED_BLOCK = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
IN_BRACES = r"(?s)\{.*\}"
IN_BRACKETS = r"(?s)\[.*\]"
SCENE_BREAK = "---"
SAMPLE_SEPARATOR = "\n\n---\n\n"

# --- fixed values: headings of the style block ----------------------------------------
STYLE_TITLE = "Phong cách"
STYLE_GUIDELINES_HEADING = "### Nguyên tắc dịch thuật"
STYLE_VOCABULARY_HEADING = "### Từ vựng chuẩn"
STYLE_EXAMPLES_HEADING = "### Ví dụ"

# --- fixed values: words of another language left in a text, and their replacements ----
LEAKED_WORDS = {
    "but": "nhưng",
    "But": "Nhưng",
    "and": "và",
    "And": "Và",
    "or": "hoặc",
    "Or": "Hoặc",
    "with": "với",
    "With": "Với",
    "of": "của",
    "Of": "Của",
    "here": "đây",
    "Here": "Đây",
    "now": "bây giờ",
    "Now": "Bây giờ",
    "okay": "được",
    "Okay": "Được",
    "while": "trong khi",
    "While": "Trong khi",
    "before": "trước khi",
    "Before": "Trước khi",
    "after": "sau khi",
    "After": "Sau khi",
}
FLAG_WORDS = ["the", "to", "in", "on", "at", "for"]

# --- fixed values: sizes and limits ---------------------------------------------------
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 300
DIALOGUE_OVERFLOW = 1.2
SHORT_NARRATION = 100
ANNOTATION_TERMS = 30
ANNOTATION_REPEATS = 5
GLOSSARY_TERMS = 100
STATE_FAILURES = 2
MIN_MAIN_TEXT = 100
MIN_LINE = 10
SAMPLE_COUNT = 5
SAMPLE_SIZE = 3000
HTML_SIZE = 15000
EXTRACTION_SIZE = 2000
NEW_TERMS_PER_TEXT = 3
KNOWN_TERMS_SHOWN = 200
RECENT_EVENTS = 201
SCORER_REFRESH_VERSIONS = 5
CHAPTER_WORD = "Chương"

# Events after which a job has no others.
LAST_EVENTS = ["job_completed", "job_failed", "job_cancelled"]
