"""Exact numbers from text: integers, and strengths as reduced ratios."""

from __future__ import annotations

import re
from math import gcd

from tessera.errors import UsageError

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: White space that is stripped, and the most digits and powers of ten taken.
SPACE, MOST_POWER, MOST_DIGITS = " \t\n\r\x0b\x0c", 38, 39
DECIMAL = re.compile(r"([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,18}))?")


def integer(text: str) -> int | None:
    """A base-ten integer with a sign, decimal digits of any script, single underscores between digits;
    held to 64 bits.  None for anything else."""
    x = text.strip(SPACE)
    body = x[1:] if x[:1] in ("+", "-") else x
    if not re.fullmatch(r"\d+(?:_\d+)*", body):
        return None
    # beyond twenty digits the value is at the bound whatever follows
    digits = body.replace("_", "").translate({ord(c): str(int(c)) for c in set(body) - {"_"}}).lstrip("0")
    value = int(digits or "0") if len(digits) <= 20 else MOST + 1
    return max(LEAST, min(MOST, -value if x[:1] == "-" else value))


def ratio(num: int, den: int) -> tuple[int, int]:
    """The ratio in lowest terms; nothing of nothing is 0/1."""
    if not num:
        return 0, 1
    g = gcd(num, den)
    return num // g, den // g


def strength(text: str) -> tuple[int, int]:
    """A decimal between 0 and 1, exponents allowed, as the exact ratio in lowest terms."""
    bad = UsageError("a dither strength must be a decimal between 0 and 1")
    m = DECIMAL.fullmatch(text.strip(SPACE))
    if not m or not (m[2] or m[3]):
        raise bad
    digits, scale = m[2] + (m[3] or ""), int(m[4] or 0) - len(m[3] or "")
    if abs(scale) > MOST_POWER or len(digits.lstrip("0")) >= MOST_DIGITS:
        raise bad
    num, den = int(digits) * 10 ** max(scale, 0), 10 ** max(-scale, 0)
    num, den = ratio(-num if m[1] == "-" else num, den)
    if not 0 <= num <= den or den > MOST:
        raise bad
    return num, den
