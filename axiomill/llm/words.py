"""Words of long texts, a slice at a time."""

from __future__ import annotations

from collections.abc import Iterator

SLICE = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"


def word_slices(raw: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """Lists of the whitespace-separated words of raw in order, cut from about `size` bytes each."""
    if len(raw) <= size:
        yield raw.split()
        return
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end].split()
        at = end
