"""Words of whole texts as bytes, by tables of the bytes that words are made of."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def letters(*also: str) -> bytes:
    """A translation table: A-Z to a-z; a-z, bytes of characters beyond ASCII and `also` stay; the rest is a blank."""
    kept = set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256)) | set("".join(also).encode())
    return bytes(b + 32 if 65 <= b <= 90 else b if b in kept else 32 for b in range(256))


def words(text: bytes | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in order, as lists: one for each PIECE bytes, cut where a word ends."""
    if not text:
        return
    plain, at = text.translate(table), 0
    while at < len(plain):
        end = at + PIECE
        if end < len(plain):
            end = plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        if found := plain[at:end].split():
            yield found
        at = end
