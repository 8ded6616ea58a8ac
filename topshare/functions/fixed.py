"""Word lists, patterns and limits that results have to agree on."""

# Column names, matched anywhere in the name.
PERCENT_NAME = r"(?i)(percent|pct|percentage|%|rate|ratio|margin)"
DATE_TEXT_NAME = r"(?i)(date|dt|time|timestamp|created|updated|modified)"

# Column names, matched at word boundaries; "_" does not end a word.
DATE_NAME = r"\b(date|dt|fecha|data|datetime|timestamp)"
YEAR_NAME = r"\b(year|yr|anno|année|ano)\b"
MONTH_NAME = r"\b(month|mo|mois|mes|month_name)\b"
QUARTER_NAME = r"\b(quarter|qtr|q[1-4]|trimestre|trim)\b"

MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
MONTH_WORDS = [*MONTHS, *[name[:3] for name in MONTHS if name != "may"]]

YEAR_MIN, YEAR_MAX = 1900, 2100
VALID_SHARE = 0.7

CURRENCY_SYMBOLS = "$€£¥"
CURRENCY_CODES = ["CHF", "USD", "EUR", "GBP", "JPY"]
SCALES = {"k": 1e3, "m": 1e6, "mm": 1e6, "b": 1e9, "bn": 1e9}

TRUE_WORDS = ["yes", "y", "true", "t", "1"]
FALSE_WORDS = ["no", "n", "false", "f", "0"]

# Texts that mean "no value" in a raw file.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date layouts besides ISO and the shape of the texts they read, a time of day may follow.
# Month first; day first only where the month would be above 12.
DATE_LAYOUTS = {
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}",
    "d/M/yyyy": r"(1[3-9]|[23]\d)/\d{1,2}/\d{4}",
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "M/d/yy": r"\d{1,2}/\d{1,2}/\d{2}",
    "d MMM yyyy": r"\d{1,2} [A-Za-z]{3} \d{4}",
    "d MMMM yyyy": r"\d{1,2} [A-Za-z]{4,9} \d{4}",
    "MMM d, yyyy": r"[A-Za-z]{3} \d{1,2}, \d{4}",
    "MMMM d, yyyy": r"[A-Za-z]{4,9} \d{1,2}, \d{4}",
    "MMM yyyy": r"[A-Za-z]{3} \d{4}",
    "MMMM yyyy": r"[A-Za-z]{4,9} \d{4}",
    "yyyyMMdd": r"\d{8}",
}
ISO_SHAPE = r"\d{4}(-\d{1,2}(-\d{1,2}.*)?)?"
TIME_LAYOUT, TIME_SHAPE = "[ H:mm[:ss]]", r"( \d{1,2}:\d{2}(:\d{2})?)?"
TWO_DIGIT_YEAR_PIVOT = 69

# Measures whose names contain one of these may be negative.
NEGATIVE_ALLOWED = [
    "gross_profit", "net_income", "cost", "expense", "adjustments", "margin", "ebitda", "ebit", "profit", "loss",
    "discount", "returns", "adjustment", "delta", "change", "refund",
]

HIGH_NULL_RATE = 0.5
OUTLIER_SIGMAS = 3
LOW_CARDINALITY, LOW_CARDINALITY_ROWS = 5, 100

# Personal data, replaced in this order, case-insensitive.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}
IDENTIFIER_NAMES = [
    r".*id$", r".*_id$", r".*identifier.*", r".*email.*", r".*phone.*", r".*ssn.*", r".*account.*",
    r".*customer_no.*",
]

# Instruction injection, case-insensitive.
INJECTION = {
    "ignore_previous": r"ignore\s+previous\s+instructions",
    "system_label": r"system\s*:",
    "assistant_label": r"assistant\s*:",
    "system_tag": r"<\s*system\s*>",
    "system_fence": r"```\s*system",
}
QUESTION_LENGTH = 500
INPUT_LENGTH = 1000
SAMPLE_ROWS = 10
MAX_CALLS_PER_DATASET = 10

# Message texts.
EMPTY_GROUP = "No data after grouping"
NON_POSITIVE = "Total value is non-positive; cannot compute concentration"
OUT_OF_RANGE = "Total value is out of range; cannot compute concentration"
LARGE_MESSAGE = "Large dataset detected: %d entities (>%d threshold)"
NO_TIME = "No temporal dimension detected"
MANY_TIME_COLUMNS = "Multiple {kind} columns found: {names}. Using first: {first}"
MIXED_CONVENTIONS = "Column '{name}' contains mixed decimal conventions (both US and EU formats)"
UNEXPECTED_NEGATIVES = "Unexpected negative values in '%s': %d occurrences"
MISSING_KEYS = "Schema missing required keys: "
COLUMN_MISSING_KEYS = "Column %d (%s) missing keys: %s"
QUALITY_WARNING = "Data quality warning: "
NO_DATA = "Normalized data is empty or unreadable"
EXECUTIVE_SUMMARY = "Analysis summary for dataset %s with %d key findings"
PENDING_RISK = "Concentration analysis pending"
ANALYSIS_PENDING = "Run concentration analysis to generate detailed insights"
SHAPE_FINDING = "Dataset contains {columns} columns with {grain} time granularity"
TOP_FINDING = "Top 10%%: %d entities = %.1f%% of value"
ADD_TIME = "Consider adding temporal dimensions for time-based analysis"
USE_TIME = "Leverage {grain} time series for trend analysis"
TIME_OPPORTUNITY = "Enhanced analytics available with time series"
DIVERSIFY = "High concentration risk - consider diversification strategies"

# Keys that stored schemas have to carry.
REQUIRED_SCHEMA_KEYS = ["dataset_id", "columns", "metadata", "warnings"]
REQUIRED_COLUMN_KEYS = ["name", "dtype", "role", "coercions"]

# Limits of the analysis and of the risk rule.
DEFAULT_THRESHOLDS = (10, 20, 50)
MAX_THRESHOLDS = 10
HEAD_ROWS = 20
REPORT_HEAD_ROWS = 10
LISTED_ENTITIES = 10
LARGE_ENTITY_COUNT = 10_000
HIGH_SHARE, MEDIUM_SHARE, HIGH_SINGLE_SHARE = 80, 60, 20
