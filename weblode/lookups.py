"""Fixed values the results depend on: extension sets, labels, MIME types, patterns and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------

TRACKING_PARAMS = [
    "from_page", "replytocom", "utm_source", "utm_medium", "utm_campaign",
    "utm_term", "utm_content", "fbclid", "gclid", "ref", "source",
]

SKIP_URL_PATTERN = r"\?replytocom=|/feed/\?|/feed$"

HTML_EXTENSIONS = [".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".shtml"]

COMMON_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".csv", ".rtf", ".odt",
]

ALL_EXTENSIONS = COMMON_EXTENSIONS + [
    ".zip", ".rar", ".7z", ".tar", ".gz", ".bz2",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".bmp", ".ico",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".flac",
    ".exe", ".dmg", ".iso", ".apk", ".deb", ".rpm",
    ".json", ".xml", ".yaml", ".yml", ".sql",
]

FILTER_EXTENSIONS = {
    "common": COMMON_EXTENSIONS,
    "all": ALL_EXTENSIONS,
    "pdf_only": [".pdf"],
}

FILTER_NAMES = {
    "common": "Common Documents (PDF, Word, Excel, etc.)",
    "all": "All Files",
    "pdf_only": "PDFs Only",
}

FILTER_SHORT_NAMES = {"common": "Common Documents", "all": "All Files", "pdf_only": "PDFs Only"}

MODE_NAMES = {"single page": "Single", "batch": "Batch", "continuous": "Continuous"}

CRAWL_OPTIONS = ["single", "follow"]

TYPE_LABELS = {
    ".pdf": "PDF Document",
    ".doc": "Legacy Word Document",
    ".docx": "Word Document",
    ".rtf": "Rich Text Document",
    ".txt": "Plain Text File",
    ".odt": "OpenDocument Text",
    ".pages": "Apple Pages Document",
    ".tex": "LaTeX Document",
    ".md": "Markdown Document",
    ".xls": "Legacy Excel Spreadsheet",
    ".xlsx": "Excel Spreadsheet",
    ".xlsm": "Excel Macro-Enabled Spreadsheet",
    ".xlsb": "Excel Binary Spreadsheet",
    ".csv": "CSV Spreadsheet",
    ".tsv": "Tab-Separated Values File",
    ".ods": "OpenDocument Spreadsheet",
    ".numbers": "Apple Numbers Spreadsheet",
    ".ppt": "Legacy PowerPoint Presentation",
    ".pptx": "PowerPoint Presentation",
    ".odp": "OpenDocument Presentation",
    ".key": "Apple Keynote Presentation",
    ".jpg": "JPEG Image",
    ".jpeg": "JPEG Image",
    ".png": "PNG Image",
    ".gif": "GIF Image",
    ".bmp": "Bitmap Image",
    ".svg": "SVG Vector Image",
    ".tif": "TIFF Image",
    ".tiff": "TIFF Image",
    ".webp": "WebP Image",
    ".ico": "Icon File",
    ".json": "JSON Data File",
    ".xml": "XML Document",
    ".yaml": "YAML Data File",
    ".yml": "YAML Data File",
    ".html": "HTML Document",
    ".htm": "HTML Document",
    ".xhtml": "XHTML Document",
    ".zip": "ZIP Archive",
    ".rar": "RAR Archive",
    ".7z": "7-Zip Archive",
    ".tar": "TAR Archive",
    ".gz": "Gzip Archive",
    ".bz2": "Bzip2 Archive",
    ".xz": "XZ Archive",
    ".mp3": "MP3 Audio",
    ".wav": "WAV Audio",
    ".mp4": "MP4 Video",
    ".avi": "AVI Video",
    ".mov": "QuickTime Video",
    ".wmv": "Windows Media Video",
    ".flv": "Flash Video",
    ".mkv": "Matroska Video",
    ".epub": "EPUB E-Book",
    ".mobi": "Kindle E-Book",
    ".py": "Python Script",
    ".js": "JavaScript File",
    ".java": "Java Source File",
    ".c": "C Source File",
    ".cpp": "C++ Source File",
    ".sql": "SQL Script",
    ".sh": "Shell Script",
    ".exe": "Windows Executable",
    ".dmg": "macOS Disk Image",
    ".iso": "Disk Image",
    ".msi": "Windows Installer",
    ".apk": "Android Package",
}

FILE_ICONS = {
    ".pdf": "file-pdf",
    ".doc": "file-word",
    ".docx": "file-word",
    ".xls": "file-excel",
    ".xlsx": "file-excel",
    ".ppt": "file-powerpoint",
    ".pptx": "file-powerpoint",
    ".txt": "file-text",
    ".csv": "file-spreadsheet",
    ".zip": "file-archive",
    ".rar": "file-archive",
    ".7z": "file-archive",
    ".jpg": "file-image",
    ".jpeg": "file-image",
    ".png": "file-image",
    ".gif": "file-image",
    ".mp3": "file-audio",
    ".mp4": "file-video",
}

DEFAULT_ICON = "file"

MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".doc": "application/msword",
    ".xls": "application/vnd.ms-excel",
    ".txt": "text/plain",
    ".csv": "text/csv",
}

DEFAULT_MIME = "application/octet-stream"

PLAIN_TEXT_EXTENSIONS = ["txt", "csv", "md", "json", "xml", "html", "htm"]

SPREADSHEET_EXTENSIONS = [".xlsx", ".xls", ".xlsm", ".xlsb", ".csv", ".tsv", ".ods"]

SCRIPT_REDIRECT_MARKERS = [
    "window.location", "window.onload", "document.location", "location.href", "location.replace",
]

SUMMARY_STATUSES = ["pending", "complete", "failed", "skipped"]

RETRYABLE_HTTP = [429, 500, 502, 503, 504]

RETRYABLE_MARKERS = ["timed out", "Connection failed", "ServerDisconnectedError"]

RETRY_DELAYS = [5, 15]

UNSUMMARIZABLE_ERROR = "Text extraction failed or unsupported file type"

NO_TEXT_ERROR = "No extracted text available"

MISSING_TITLE = "<automated title extraction failed>"

MISSING_SUMMARY = "<automated summary extraction failed>"

EXPORT_HEADER = [
    "Document Title", "Short Summary", "Document URL", "Filename", "Document Type", "Version",
]

MASKED_KEY = "********"

#: What Python's ``str.strip`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

#: Settings: default value, and the bounds the numeric ones are clamped to.
SETTING_DEFAULTS = {
    "max_pages_per_scan": 500,
    "request_timeout": 30,
    "requests_per_second": 2.0,
    "default_crawl_depth": 2,
    "max_crawl_depth": 10,
    "max_concurrent_requests": 10,
    "scan_history_limit": 20,
    "mongodb_uri": "mongodb://localhost:27017",
    "mongodb_database": "documents",
    "ai_api_url": "",
    "ai_api_key": "",
    "ai_model": "",
    "stirling_pdf_url": "http://localhost:8080",
}

SETTING_BOUNDS = {
    "max_pages_per_scan": (10, 10000),
    "request_timeout": (5, 120),
    "requests_per_second": (0.5, 10.0),
    "max_crawl_depth": (1, 10),
    "max_concurrent_requests": (1, 50),
    "scan_history_limit": (5, 100),
}

KEEP_WHEN_BLANK = ["ai_api_url", "ai_api_key", "ai_model", "mongodb_uri", "mongodb_database"]

# --- end of fixed values ------------------------------------------------------------------------


def literal_map(table: dict[str, str]) -> Column:
    """A lookup table as a constant map column (folded once, no join)."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + ")")


def lookup(table: dict[str, str], key: Column, default: Column | str | None = None) -> Column:
    """``table[key]`` with a default; a left outer join against a constant table."""
    found = F.try_element_at(literal_map(table), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))

