"""FF3-1 over any alphabet, vectorised over an Arrow batch.

Numerals of a half can need 96 bits.  They are kept as arrays of base-``radix`` digits,
the first character least significant, as the method reads them; only the cipher's input
is packed into three 32-bit words.  Reducing the cipher's output modulo ``radix**m`` is
taking its lowest ``m`` digits, so no number wider than 64 bits is ever needed.
"""

from __future__ import annotations

import numpy as np

from veladura.functions.ff3 import CHUNK, ROUNDS, BlockCipher, Ff3

FEWEST_VALUES = 1_000_000  # what FF3-1 asks for
_WORD = np.uint64(32)


def shortest(radix: int) -> int:
    """The least length with a million possible values, two at least."""
    n = 2
    while radix**n < FEWEST_VALUES:
        n += 1
    return n


def longest(radix: int) -> int:
    """The greatest length: each half must fit 96 bits."""
    n = 1
    while radix ** (n + 1) <= 2**96:
        n += 1
    return 2 * n


class RadixFf3:
    """FF3-1 on arrays of equally long texts, given as ``(rows, length)`` arrays of digits.

    A tweak of eight bytes is taken as FF3 did before its revision.
    """

    def __init__(self, key: bytes, tweak: bytes, radix: int):
        if not 2 <= radix <= 65_536:
            raise ValueError("a radix is 2 to 65536")
        self.radix = radix
        if len(tweak) == 8:
            self.cipher = BlockCipher(key[::-1])
            halves = [int.from_bytes(tweak[4:], "big"), int.from_bytes(tweak[:4], "big")]
            self.tweak_words = [halves[i % 2] ^ i for i in range(ROUNDS)]
        else:
            decimal = Ff3(key, tweak)
            self.cipher, self.tweak_words = decimal.cipher, decimal.tweak_words

    def _words(self, half: np.ndarray) -> list[np.ndarray]:
        """The number of a half, whose last digit is most significant, in three words."""
        words = [np.zeros(len(half), dtype=np.uint64) for _ in range(3)]
        radix, low = np.uint64(self.radix), np.uint64(0xFFFFFFFF)
        for place in range(half.shape[1] - 1, -1, -1):
            carry = half[:, place].astype(np.uint64)
            for i in range(3):
                carry = words[i] * radix + carry
                words[i] = carry & low
                carry = carry >> _WORD
        return words

    def _shift(self, half: np.ndarray, step: int, width: int) -> np.ndarray:
        """The lowest ``width`` digits of the round function of a half."""
        state = [w.astype("<u4") for w in self._words(half)]
        state.append(np.full(len(half), self.tweak_words[step], dtype="<u4"))
        words = [w.astype(np.uint64) for w in self.cipher.encrypt(state)]
        radix = np.uint64(self.radix)
        out = np.empty((len(half), width), dtype=np.int64)
        for place in range(width):
            rest = np.zeros(len(half), dtype=np.uint64)
            for i in (3, 2, 1, 0):
                rest = (rest << _WORD) | words[i]
                words[i] = rest // radix
                rest = rest - words[i] * radix
            out[:, place] = rest
        return out

    def _add(self, half: np.ndarray, shift: np.ndarray, sign: int) -> np.ndarray:
        out = half + sign * shift
        carry = np.zeros(len(half), dtype=np.int64)
        for place in range(half.shape[1]):
            carry, out[:, place] = np.divmod(out[:, place] + carry, self.radix)
        return out

    def run(self, digits: np.ndarray, decode: bool) -> np.ndarray:
        length = digits.shape[1]
        if not shortest(self.radix) <= length <= longest(self.radix):
            raise ValueError(f"{length} characters are too few or too many for {self.radix} characters")
        out = np.empty_like(digits)
        for start in range(0, len(digits), CHUNK):
            part = digits[start : start + CHUNK].astype(np.int64)
            upper = (length + 1) // 2
            a, b = part[:, :upper], part[:, upper:]
            if not decode:
                for step in range(ROUNDS):
                    a, b = b, self._add(a, self._shift(b, step, a.shape[1]), 1)
            else:
                for step in reversed(range(ROUNDS)):
                    a, b = self._add(b, self._shift(a, step, b.shape[1]), -1), a
            out[start : start + CHUNK] = np.concatenate([a, b], axis=1)
        return out


class TextCipher:
    """FF3-1 on texts of an alphabet, of any mixture of lengths."""

    def __init__(self, key: bytes, tweak: bytes, alphabet: str):
        self.cipher = RadixFf3(key, tweak, len(alphabet))
        self.letters = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        self.order = np.argsort(self.letters)

    def run(self, texts: list[str], decode: bool) -> list[str]:
        """Texts must fit the alphabet; a repeated text is worked on once."""
        distinct, place = np.unique(np.array(texts, dtype=object), return_inverse=True)
        sizes = np.array([len(t) for t in distinct])
        out = np.empty(len(distinct), dtype=object)
        for size in np.unique(sizes):
            here = np.flatnonzero(sizes == size)
            points = np.array(list(distinct[here]), dtype=f"<U{size}").view(np.uint32).reshape(-1, size)
            digits = self.order[np.searchsorted(self.letters, points, sorter=self.order)]
            coded = self.letters[self.cipher.run(digits, decode)]
            out[here] = np.ascontiguousarray(coded).view(f"<U{size}").ravel()
        return out[place].tolist()
