"""Terms of texts: runs of ASCII letters, digits and all other characters beyond ASCII."""

from __future__ import annotations

import re

#: Maximal matches in a text whose A-Z are lower-cased; all else of ASCII separates.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms in order, as UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []
