"""Fixed values.

Word lists, patterns, limits and formats that decide results. They have to be
exactly these for the answers to be right, so they are kept together, as text.
"""

# Whitespace, as stripped from the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# File name endings by kind of source.
TABULAR_SUFFIXES = (".csv", ".json", ".xlsx", ".xls", ".xml", ".txt")
AUDIO_SUFFIXES = (".mp3", ".wav", ".ogg", ".m4a", ".flac", ".aac", ".wma", ".opus")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff")

# Extensions that make a link on a page a data file.
PROCESSABLE_EXTENSIONS = (
    ".csv", ".json", ".xlsx", ".txt", ".pdf", ".zip",
    ".png", ".jpg", ".jpeg", ".gif", ".webp",
    ".opus", ".mp3", ".wav", ".ogg", ".m4a",
    ".mp4", ".webm",
)

# Extensions that make a URL in a question a data source.
DATA_URL_EXTENSIONS = (".pdf", ".csv", ".json", ".xlsx", ".txt")
SUBMIT_URL_MARKS = ("/submit", "/answer")

# Question patterns.
QUESTION_ID = r"Q(\d+)"
ABSOLUTE_URL = r"""https?://[^\s<>"')\]]+"""
URL_TRAILING = r"""[.,:;!?)"']+$"""
RELATIVE_URLS = (
    r"""[Ss]crape\s+(/[^\s<>"']+)""",
    r'''href="(/[^"]+)"''',
    r"""href='(/[^']+)'""",
    r"""[Vv]isit\s+(/[^\s<>"']+)""",
    r"""[Gg]et\s+(?:data\s+)?from\s+(/[^\s<>"']+)""",
)
RELATIVE_SUBMIT_URLS = (
    r"(?:POST|post)\s+.*?(?:to|back to)\s+(/submit[^\s]*)",
    r"(?:submit|Send)\s+.*?(?:to|back to)\s+(/submit[^\s]*)",
    r"(?:to|back to)\s+(/submit)\b",
    r"(/submit)\s",
)
INSTRUCTION_KEYWORDS = ("page", "column", "sum", "average", "filter", "where", "group by", "count", "total")
INSTRUCTION_TAIL = r"[\s\S]{0,50}"
INSTRUCTIONS_PER_KEYWORD = 2
NUMBER_PHRASES = ("what is the sum", "what is the total", "what is the average", "how many", "what is the count")
IMAGE_WORDS = ("chart", "image", "graph", "plot", "visualization", "base64")
SENTENCE_END = r"[.!?]"
DESCRIPTION_LENGTH = 200

# Cutoff patterns.
CUTOFF_WORD = "cutoff"
CUTOFF = r"cutoff[:\s]+(\d+)"
CUTOFF_VALUE = r"CUTOFF VALUE[^\d]*(\d+)"
AT_LEAST_PHRASE = "greater than or equal"
AT_LEAST_SIGN = ">="

# Words that choose a metric, in the order they are tried.
SUM_WORDS = ("sum", "add")
TOTAL_WORDS = ("sum", "total")
COUNT_WORDS = ("count", "how many")
MEAN_WORDS = ("average", "mean")
MAX_WORDS = ("max", "maximum", "highest")
MIN_WORDS = ("min", "minimum", "lowest")

# Hint words per task family and per answer format.
TASK_HINTS = {
    "data_analysis": ("sum", "total", "count", "filter", "where", "average", "group by", "rows"),
    "sql": ("sql", "select", "from", "duckdb", "sqlite", "query"),
    "api": ("api", "endpoint", "github", "repository", "request", "fetch"),
    "command": ("git", "uv", "curl", "wget", "bash", "run", "command"),
    "chart": ("chart", "plot", "visualization", "base64", "png", "image"),
    "geo": ("latitude", "longitude", "distance", "km", "miles", "haversine"),
    "network": ("graph", "node", "edge", "shortest path", "networkx"),
}
FORMAT_HINTS = {
    "number": ("sum", "count", "total", "average", "how many", "percentage", "ratio"),
    "hash": ("SHA", "hash", "checksum", "MD5"),
    "command": ("command", "run", "execute", "bash", "terminal"),
    "json": ("JSON", "array", "object", "{}"),
    "base64_image": ("base64", "PNG", "image", "chart", "plot", "encode"),
    "hex_color": ("color", "hex", "#", "RGB"),
    "string": ("name", "text", "value", "extract"),
}

# Context sections: label and character limit (None: whole text).
CONTEXT_SECTIONS = (
    ("AUDIO TRANSCRIPT:\n", "audio_transcript", None),
    ("PDF TEXT:\n", "pdf_text", 4000),
    ("WEBPAGE TEXT:\n", "webpage_text", 3000),
    ("SCRAPED CONTENT:\n", "scraped_page", 3000),
    ("IMAGE DOMINANT COLOR: ", "dominant_color", None),
)
EMPTY_CONTEXT = "No context available"
CHARACTERS_PER_TOKEN = 4

# Answers.
CODE_FENCE = "```"
ANSWER_PREFIXES = ("Answer:", "The answer is:", "Result:")
NUMBER = r"-?\d+\.?\d*"
JSON_IN_TEXT = r"(?s)(\{.*\}|\[.*\])"
TRUE_WORDS = ("true", "yes")
FALSE_WORDS = ("false", "no")
MAX_ANSWER_BYTES = 1_000_000
TOO_LARGE_REASON = "Answer exceeds 1MB size limit"
CORRECT_WORDS = ("correct", "success")

# Personal offsets.
OFFSET_MODULO = r"mod[_ ](\d+)"
OFFSET_FIRST_MODULI = (2, 3, 5)
CHECKSUM_MODULO = 100

# Pages.
PRUNED_TAGS = ("script", "style", "noscript", "header", "footer", "nav", "aside")
MAIN_CONTENT = ("#question", "#result", "#content", "main", "article", "body")
MAIN_CONTENT_MIN_LENGTH = 10
KEY_VALUE = r"([A-Za-z][A-Za-z\s]{1,30}):\s*([^\n:]{1,100})"
KEY_MAX_LENGTH = 50
BASE64_LAYERS = 5

# Log lines: time - name - LEVEL - message.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (.*?) - ([A-Z]+) - (.*)$"
LOG_LINES_DEFAULT = 100
LOG_LINES_MAX = 5000

# Sessions.
TIME_LIMIT_SECONDS = 180
SAFETY_BUFFER_SECONDS = 10
CRITICAL_SECONDS = 5
TOKEN_BUDGET = 1_000_000
BUDGET_THRESHOLD = 0.75
CHAIN_STEPS = 10

EARTH_RADIUS_KM = 6371.0
