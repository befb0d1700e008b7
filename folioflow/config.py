"""Driver-side settings.

These are small frozen objects that become literals in a plan. None of them
holds a credential: secrets stay with the translator the caller supplies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# Results depend on them.
DEFAULT_FONT = "helvetica"
DEFAULT_FONT_SIZE = 11.0
MIN_BLOCK_CHARS = 3
MULTIPART_ALLOWANCE = 65_536
MAX_INPUT_BYTES = 1_048_576
MAX_PAGES = 3
MAX_OUTPUT_BYTES = 3_200_000
LANGUAGES = (
    "Arabic", "Chinese", "Dutch", "English", "French", "German", "Greek",
    "Hebrew", "Hindi", "Italian", "Japanese", "Korean", "Norwegian",
    "Polish", "Portuguese", "Russian", "Spanish", "Swedish", "Turkish",
    "Ukrainian",
)


@dataclass(frozen=True)
class TranslationConfig:
    """What to translate and how to cut it up."""

    source_lang: str
    target_lang: str
    model: str | None = None
    fallback_font: str = DEFAULT_FONT
    batch_size: int = 10
    skip_pages: Sequence[int] = ()
    max_chunk_size: int = 1000
    preserve_layout: bool = True

    def __post_init__(self) -> None:
        for name in ("source_lang", "target_lang"):
            value = getattr(self, name)
            if not isinstance(value, str) or value.strip() == "":
                raise ValueError(f"{name} must be a non-blank string")
        if self.batch_size < 1:
            raise ValueError("batch_size must be 1 or more")
        if self.max_chunk_size < 100:
            raise ValueError("max_chunk_size must be 100 or more")
        object.__setattr__(self, "skip_pages", tuple(self.skip_pages or ()))


@dataclass(frozen=True)
class Endpoint:
    """Where a job's requests go when the job itself names nothing."""

    base_url: str
    model: str


@dataclass(frozen=True)
class AdmissionRules:
    """Limits of the intake. ``hosted`` switches the URL screen on."""

    languages: Sequence[str] = LANGUAGES
    magic: bytes = b"%PDF-"
    max_bytes: int = MAX_INPUT_BYTES
    max_pages: int = MAX_PAGES
    hosted: bool = True
    server_has_key: bool = False

    @property
    def max_declared(self) -> int:
        return self.max_bytes + MULTIPART_ALLOWANCE


@dataclass(frozen=True)
class Quota:
    """At most ``limit`` arrivals per client and calendar ``period`` (UTC)."""

    period: str
    limit: int

    def __post_init__(self) -> None:
        if self.period not in ("minute", "hour", "day"):
            raise ValueError("period must be minute, hour or day")
        if self.limit < 1:
            raise ValueError("limit must be 1 or more")


@dataclass(frozen=True)
class RouteLabels:
    """Values of the ``route`` column."""

    translate: str = "translate"
    skipped_page: str = "skipped_page"
    short: str = "short"


@dataclass(frozen=True)
class StatusLabels:
    """Values of the ``status`` column of pages and documents."""

    translated: str = "translated"
    unreadable: str = "unreadable"
    no_pages: str = "no_pages"
    incomplete: str = "incomplete"  # pages that were announced did not arrive in time


ROUTE = RouteLabels()
STATUS = StatusLabels()
# Messages of error events.
TOO_LARGE_MESSAGE = "Translated PDF is too large to return."
FAILED_MESSAGE = "Translation failed. Please try again."
REFUSED_MESSAGES = {
    "language": "Unsupported language selection.",
    "credentials": "Enter your API key to use the cloud demo.",
    "url": "That endpoint is not allowed.",
    "declared_length": "File too large — 1 MB max.",
    "empty": "No file received.",
    "magic": "Only PDF files are supported.",
    "size": "File too large — 1 MB max.",
    "unreadable": "Could not read this PDF.",
    "pages": "PDF too long — 3 pages max for this demo.",
}
NOT_HTTPS_MESSAGE = "Only https:// endpoints are allowed."
TRANSLATE_QUOTAS = (Quota("hour", 5), Quota("day", 20))
MODEL_LIST_QUOTAS = (Quota("minute", 30),)


@dataclass(frozen=True)
class ServerDefaults:
    """Endpoints by who pays for the call: the caller's key, the server's key, or nobody."""

    caller: Endpoint
    server: Endpoint
    local: Endpoint
    hosted: bool = True
    server_has_key: bool = False
