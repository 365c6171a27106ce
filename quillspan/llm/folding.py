"""Letters without marks."""

from __future__ import annotations

import unicodedata


class _Plain(dict):
    """What each character is after NFKD without its combining marks; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        self[code] = plain
        return plain


_PLAIN = _Plain()


def without_marks(text: str) -> str:
    """NFKD without combining marks; character by character, since only such marks change places in NFKD."""
    return text if text.isascii() else text.translate(_PLAIN)
