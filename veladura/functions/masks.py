"""One-way masks.  Each expects a value that fits its template; see ``operators.protect``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stars(n: Column, character: str) -> Column:
    return F.repeat(F.lit(character), n)


def mask_groups(c: Column, pattern: str, hidden: set[int], groups: int, character: str = "*"):
    """Hide the given groups of a pattern that covers the whole value, keeping length."""
    pieces = []
    for number in range(1, groups + 1):
        piece = F.regexp_extract(c, pattern, number)
        pieces.append(_stars(F.length(piece), character) if number in hidden else piece)
    return F.concat(*pieces)


def mask_email(c: Column, character: str = "*") -> Column:
    """First letter of mailbox and host, and all from the host's first dot, stay."""
    at = F.instr(c, "@")
    host = F.substring(c, at + 1, F.length(c))
    dot = F.instr(host, ".")
    return F.concat(
        F.left(c, F.lit(1)),
        _stars(at - 2, character),
        F.lit("@"),
        F.left(host, F.lit(1)),
        _stars(dot - 2, character),
        F.substring(host, dot, F.length(host)),
    )


def mask_name(c: Column, character: str = "*") -> Column:
    """Word by word: an upper-case initial stays, every other character is hidden."""
    inside_word, small_initial = r"(?<=[^ ])[^ ]", r"(?<![^ ])[^ \p{Lu}]"
    return F.regexp_replace(c, f"{inside_word}|{small_initial}", character)


def mask_dob(c: Column, character: str = "*") -> Column:
    """dd/MM/yyyy: the year stays."""
    pair = character * 2
    return F.concat(F.lit(f"{pair}/{pair}/"), F.right(c, F.lit(4)))


def mask_all(c: Column, character: str = "*") -> Column:
    """Every character hidden, length kept (card verification codes)."""
    return _stars(F.length(c), character)


MASKS = {
    "mask-email": mask_email,
    "mask-nome": mask_name,
    "mask-dob": mask_dob,
    "mask-cvv": mask_all,
}
