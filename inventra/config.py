"""Rules and enumerations of the inventory audit. Values that must equal the audited application's are marked fixed."""

from __future__ import annotations

from dataclasses import dataclass, field

MB = 1 << 20
GB = 1 << 30
#: Largest size that takes part in duplicate detection.
LARGEST_DUPLICATE = 1 << 48

# Verdict enumerations.
SECURITY_CLASSES = ("C0", "C1", "C2", "C3")
GDPR_RISKS = ("none", "low", "medium", "high", "critical")
FINANCE_TYPES = ("none", "invoice", "contract", "budget", "accounting", "payment")
LEGAL_TYPES = ("none", "employment", "lease", "sale", "nda", "compliance", "litigation")
SENSITIVE_LEGAL = ("nda", "litigation")
OTHER = "Autres"
UNKNOWN_OWNER = "Unknown"

# The inventory's columns by position, and those that are quoted in strict files.
INVENTORY_COLUMNS = (
    "Name", "Host", "Extension", "Username", "Hostname", "UNCDirectory", "CreationTime", "LastWriteTime", "Readable", "Writeable",
    "Deletable", "DirectoryType", "Base", "FileSize", "AccessTime", "FileAttributes", "Owner", "FastHash", "FileSignature",
)

# Size buckets in MB and ages in years of 365 days.
SIZE_BUCKETS = (("<50MB", 0, 50), ("50-100MB", 50, 100), ("100-150MB", 100, 150), ("150-200MB", 150, 200), ("200-300MB", 200, 300), ("300-500MB", 300, 500), (">500MB", 500, None))
YEAR_BUCKETS = (("0_1y", 0, 1), ("1_2y", 1, 2), ("2_3y", 2, 3), ("3_4y", 3, 4), ("4_5y", 4, 5), ("5_6y", 5, 6), ("6plus", 6, None))
DUPLICATE_LEVELS = ("1x", "2x", "3x", "4x", "5x", "6x", "7x+")
FILE_TYPES = {"pdf": "PDF", "doc": "DOC", "docx": "DOC", "xls": "XLS", "xlsx": "XLS", "ppt": "PPT", "pptx": "PPT", "jpg": "IMG", "jpeg": "IMG", "png": "IMG", "gif": "IMG", "txt": "TXT", "csv": "CSV", "json": "JSON", "xml": "XML"}

AS_OF = "2024-06-01 00:00:00"


# The defaults of rules and settings below, the file types and the duplicate levels above.
@dataclass(frozen=True)
class Rules:
    """Exclusion and scoring rules of files."""

    blocked_extensions: tuple[str, ...] = (".tmp", ".log", ".bak", ".cache", ".zip")
    min_size: int = 100
    max_size: int = 104_857_600
    skip_system: bool = True
    skip_hidden: bool = False
    excluded_paths: tuple[str, ...] = ()
    high_extensions: tuple[str, ...] = (".pdf", ".docx", ".doc", ".xlsx")
    low_extensions: tuple[str, ...] = (".txt", ".ini", ".cfg")
    size_weight: int = 30
    type_weight: int = 40
    age_weight: int = 20
    special_weight: int = 10


@dataclass(frozen=True)
class Settings:
    rules: Rules = field(default_factory=Rules)
    strict_csv: bool = False
    cache_ttl_hours: int = 168
    prompt_green: int = 3500
    prompt_red: int = 3950
    prompt_limit: int = 4000
