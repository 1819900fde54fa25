"""Templates and alphabets of one's own: which characters of a text are protected, and as what.

A template is a regular expression whose groups mark the characters to protect; what
stands between the groups stays where it is.  The groups' characters together are one
value of the alphabet: they are taken out, encoded as one, and put back into their places.
Everything but the cipher itself is column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from veladura.functions import ff3, radix
from veladura.keys import Keyring

cloudpickle.register_pickle_by_value(ff3)
cloudpickle.register_pickle_by_value(radix)

# The alphabets that are known by name.
NUMERIC = "0123456789"
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _pieces(pattern: str) -> list[tuple[bool, str]]:
    """The pattern in pieces that are a group (true) or stand between groups."""
    out, depth, begin, i, in_set = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_set:
            in_set = c != "]"
        elif c == "[":
            in_set = True
            i += pattern[i + 1 : i + 2] in ("]", "^")
        elif c == "(":
            if pattern[i + 1 : i + 2] != "?":
                if depth:
                    raise ValueError(f"a group inside a group: {pattern}")
                out.append((False, pattern[begin:i]))
                begin = i + 1
            elif not depth:
                raise ValueError(f"only plain groups may stand outside of groups: {pattern}")
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                out.append((True, pattern[begin:i]))
                begin = i + 1
                if pattern[i + 1 : i + 2] in tuple("?*+{"):
                    raise ValueError(f"a group cannot be repeated: {pattern}")
        elif c == "|" and not depth:
            raise ValueError(f"alternatives belong into a group: {pattern}")
        i += 1
    return [*out, (False, pattern[begin:])]


@dataclass(frozen=True)
class Template:
    """``pattern`` must match the whole text; anchors in it are allowed and mean nothing.

    For an encoded text to be decoded again the pattern must also match it: let each group
    accept every character of the alphabet.
    """

    pattern: str
    alphabet: str = NUMERIC

    def __post_init__(self):
        if len(set(self.alphabet)) != len(self.alphabet) or len(self.alphabet) < 2:
            raise ValueError("an alphabet has two or more characters, each once")
        if not any(group for group, _ in _pieces(self.pattern)):
            raise ValueError(f"a template needs a group: {self.pattern}")
        re.compile(self.pattern)

    @cached_property
    def parts(self) -> list[tuple[bool, str]]:
        """Groups and what is between them, without the anchors at the pattern's ends."""
        pieces = _pieces(self.pattern)
        text = [p for _, p in pieces]
        for i in (0, 1):
            text[i] = text[i].removeprefix("^")
        for i in (-1, -2):
            if text[i].endswith("$") and not text[i].endswith("\\$"):
                text[i] = text[i][:-1]
        return [(group, t) for (group, _), t in zip(pieces, text)]

    @cached_property
    def whole(self) -> str:
        """The pattern with every part a group."""
        return "(?s)^" + "".join(f"({p})" for _, p in self.parts) + r"\z"

    def _part(self, value: Column, place: int) -> Column:
        return F.regexp_extract(value, self.whole, place + 1)

    def taken_out(self, value: Column) -> Column:
        """The characters of the groups together; null if the text does not match."""
        groups = [self._part(value, i) for i, (group, _) in enumerate(self.parts) if group]
        return F.when(value.rlike(self.whole), F.concat(*groups))

    def put_back(self, value: Column, coded: Column) -> Column:
        """The text with these characters, as many as there were, in place of its groups' own."""
        out, before = [], F.lit(0)
        for i, (group, _) in enumerate(self.parts):
            own = self._part(value, i)
            if group:
                out.append(F.substr(coded, before + 1, F.length(own)))
                before = before + F.length(own)
            else:
                out.append(own)
        return F.concat(*out)

    def fits(self, value: Column) -> Column:
        """Whether a text matches, in the alphabet and in a length that FF3-1 can encode."""
        inside = self.taken_out(value)
        known = F.length(F.translate(inside, self.alphabet, "")) == 0
        n = len(self.alphabet)
        return F.coalesce(
            known & F.length(inside).between(radix.shortest(n), radix.longest(n)), F.lit(False)
        )


def code_by_template(
    value: Column, template: Template, name: str, keyring: Keyring, decode: bool = False
) -> Column:
    """Encode (or decode) by a template, under the key and tweak of ``name``; null where it does not fit."""
    cipher = radix.TextCipher(*keyring.fpe(name), template.alphabet)

    def run(texts: pa.Array) -> pa.Array:
        coded = iter(cipher.run(texts.drop_null().to_pylist(), decode) if texts.null_count < len(texts) else ())
        return pa.array([next(coded) if there.as_py() else None for there in texts.is_valid()], pa.string())

    run.__name__ = f"{'decode' if decode else 'encode'}_by_template"
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    inside = F.when(template.fits(value), template.taken_out(value))
    coded = F.arrow_udf(run, "string")(inside)
    return template.put_back(value, coded)


def mask_by_template(value: Column, template: Template, character: str = "*") -> Column:
    """Every character of the groups replaced by ``character``; null where the text does not match.

    The alphabet does not matter here.
    """
    inside = template.taken_out(value)
    return template.put_back(value, F.repeat(F.lit(character), F.length(inside)))
