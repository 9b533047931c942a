"""Fixed parameters of the enrichment stages."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

#: Strings that a corpus export writes for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: The locale that a site address carries for each country of collection.
LOCALES = {"Bulgaria": "bg-BG", "Croatia": "hr-HR", "Finland": "fi-FI", "France": "fr-FR", "Germany": "de-DE", "Global": "en-IE", "Hungary": "hu-HU", "Poland": "pl-PL", "Portugal": "pt-PT", "Spain": "es-ES", "Sweden": "sv-SE"}
DEFAULT_LOCALE = "en-IE"
#: Seconds between keyframes; of a short plan its seconds and frames at most; and characters that are translated at once.
FRAME_STEP, FRAME_CAP, MAX_FRAMES, TRANSLATE_CHARS = 30, 180, 6, 3000
#: Languages that on-screen text is read in.
OCR_LANGUAGES = ("en", "fr", "pl", "sv", "pt", "de", "es", "hu", "hr")


@dataclass(frozen=True)
class Decoding:
    """How a language model decodes. The values are fixed but for the context size."""

    num_ctx: int = 8096
    num_predict: int = 2048
    repeat_last_n: int = 64
    repeat_penalty: float = 1.1
    top_p: float = 0.9
    top_k: int = 40
    min_p: float = 0.0
    temperature: float = 0.0


@dataclass(frozen=True)
class ModelSpec:
    """A model call: what goes into the key of its cached results."""

    name: str
    system: str
    options: Decoding = field(default_factory=Decoding)
    schema: str | None = None

    @property
    def version(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]
