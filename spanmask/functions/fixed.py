"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, not logic: label vocabularies, lookup
maps, rank tables and regular expressions.  Patterns are written for the
Java regex engine Spark uses; ``(?U)`` makes ``\\b \\w \\d \\s`` Unicode-aware
(Python ``str`` patterns are Unicode-aware by default), ``(?iu)`` gives
Unicode case folding for IGNORECASE.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — labels, maps, ranks (must match the reproduced behaviour)
# ---------------------------------------------------------------------------

DEFAULT_LABELS = [
    "private_person",
    "private_email",
    "private_phone",
    "private_address",
    "private_organization",
    "private_id",
]
ALL_KNOWN_LABELS = DEFAULT_LABELS + ["private_date", "private_location"]

LABEL_PREFIX = {
    "private_person": "PERSON",
    "private_organization": "ORGANIZATION",
    "private_email": "EMAIL",
    "private_phone": "PHONE",
    "private_address": "ADDRESS",
    "private_id": "ID",
    "private_date": "DATE",
    "private_location": "LOCATION",
}

LABEL_ALIASES = {
    "account_number": "private_id",
    "bank_account": "private_id",
    "credit_card": "private_id",
    "fiscal_id": "private_id",
    "iban": "private_id",
    "id_number": "private_id",
    "tax_id": "private_id",
    "vat_number": "private_id",
    "private_account_number": "private_id",
    "private_bank_account": "private_id",
    "private_credit_card": "private_id",
    "private_fiscal_id": "private_id",
    "private_iban": "private_id",
    "private_tax_id": "private_id",
    "private_vat_number": "private_id",
}

# priority of a regex label when two regex matches start at the same offset
REGEX_LABEL_PRIORITY = {
    "private_id": 5,
    "private_email": 4,
    "private_phone": 3,
    "private_address": 2,
}

# first element of the span rank: who found the span
SOURCE_PRIORITY = {"manual": 4, "regex": 3, "context": 3, "opf": 2, "merged": 1}

# review display names
LABEL_DISPLAY = {
    "private_person": "People names",
    "private_email": "Emails",
    "private_phone": "Phone numbers",
    "private_address": "Addresses",
    "private_organization": "Companies and organizations",
    "private_id": "Personal and business IDs",
    "private_date": "Dates",
    "private_location": "Places",
}
SOURCE_DISPLAY = {
    "opf": "model",
    "regex": "rule",
    "context": "field",
    "manual": "manual",
    "merged": "merged",
}
FILTER_ALL = "All data"

# detection mode -> minimum model score
DETECTION_MODES = {"recommended": 0.20, "complete": 0.00, "selective": 0.60}
DEFAULT_MODE = "recommended"

# confidence buckets (lower bounds)
SCORE_HIGH = 0.80
SCORE_MEDIUM = 0.50

# review text column: longer texts are cut to 137 chars + "..."
REVIEW_TEXT_MAX = 140
REVIEW_TEXT_CUT = 137

# listing samples shown to the user
SAMPLE_LIST = 12
SAMPLE_INFO = 8
SAMPLE_WARNING = 10

SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".xlsx", ".txt", ".csv", ".tsv"]
SAFE_SUBDIR = "01_LLM_SAFE_FILES"
RESERVED_SUBDIR = "99_RESERVED_DO_NOT_UPLOAD"
OUTPUT_SUFFIX = "_anonymized.txt"

# characters trimmed around model findings and context values
MODEL_TRIM_CHARS = " \t\r\n,;|"
CONTEXT_TRIM_CHARS = " \t:-=;|"

# odd-position values of the Italian tax-code check character, for the
# letters A..Z in order (digits 0..9 take the values of A..J)
TAX_CODE_ODD_VALUES = [
    1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18,
    20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23,
]

# ---------------------------------------------------------------------------
# FIXED VALUES — patterns (Java syntax)
# ---------------------------------------------------------------------------

EMAIL_RE = r"(?iuU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
VAT_RE = r"(?iuU)\b(?:P\.?\s*IVA\s*:?\s*)?(\d{11})\b"            # group 1
TAX_CODE_RE = r"(?iuU)\b[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]\b"
IBAN_RE = r"(?iuU)\bIT\s*\d{2}\s*[A-Z]\s*(?:\d\s*){10}(?:[A-Z0-9]\s*){12}\b"
PHONE_RE = r"(?iuU)(?<!\w)(?:\+39\s*)?(?:0\d{1,4}|3\d{2})[\s./-]?\d{3,4}[\s./-]?\d{3,4}(?!\w)"

# full-match shapes used by the validators (after whitespace removal, upper)
TAX_CODE_SHAPE = r"^[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]$"
IBAN_SHAPE = r"^IT[0-9]{2}[A-Z][0-9]{10}[A-Z0-9]{12}$"

# labelled field -> organisation value (group 2 is the value)
CONTEXT_ORG_RE = (
    r"(?imuU)\b("
    r"supplier|vendor|customer|client|company|organization|entity|business\s+name|"
    r"fornitore|ragione\s+sociale|azienda|ditta|societ[aà]|cliente"
    r")\s*[:=\-]\s*([^\n\r|;]{2,120})"
)
# a context value ends where the next labelled field starts
CONTEXT_CUT_RE = (
    r"(?iuU)\s+(?:VAT(?:\s+number)?|Tax\s+ID|Fiscal\s+ID|P\.?\s*IVA|Partita\s+IVA|"
    r"Codice\s+fiscale|CF|Email|Mail|Phone|Mobile|Telefono|Tel\.?|IBAN|Address|Indirizzo)\s*[:=\-]"
)

# Italian street prefixes: the street-level part of a model address
STREET_RE = (
    r"(?iuU)\b(Via|Viale|Vicolo|Corso|Piazza|Largo|Strada|Contrada|Borgata|Borgo|"
    r"Localita|Località|Loc\.?|Frazione|Fraz\.?|V\.le|C\.so|P\.za|Sp(?:\.|\b)|"
    r"S\.?S\.?|Statale|Provinciale)\b"
    r"[\s\S]{1,80}?\d+\s*[A-Za-z]?(?:\s*/\s*[A-Za-z\d]+)?"
)

# tabular headers whose values are rendered as "Header: value"
CONTEXT_HEADER_RE = (
    r"(?iuU)\b(supplier|vendor|customer|client|company|organization|entity|business\s+name|"
    r"fornitore|cliente|ragione\s+sociale|azienda|ditta|societ[aà]|"
    r"contact|name|first\s+name|last\s+name|nome|cognome|"
    r"email|mail|phone|mobile|telefono|cellulare|address|indirizzo|"
    r"vat|tax\s+id|fiscal\s+id|p\.?\s*iva|partita\s+iva|codice\s+fiscale|iban)\b"
)

# Python's str.isspace() also covers U+001C..U+001F, Java's (?U)\s does not
WS_CLASS = r"[\s\x{1c}-\x{1f}]"
