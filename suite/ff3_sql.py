"""FF3-1 in plain SQL, so that another engine can check the cipher value by value.

A recursive query walks all values through the 8 x 11 block-cipher steps at once.
"""

from __future__ import annotations

from veladura.functions.ff3 import ROUNDS, BlockCipher, Ff3
from veladura.keys import Keyring

_FIELDS = ("w0", "w1", "w2", "w3")


def _mixed(kind: str, column: int) -> str:
    """One output column of a block-cipher round: four table lookups and a round key."""
    terms = []
    for row in range(4):
        source = f"w{(column + row) % 4}"
        byte = f"((v.{source} >> {8 * row}) & 255)"
        terms.append(f"t.{kind}{row}[1 + {byte}]")
    text = terms[0]
    for term in terms[1:] + [f"s.k{column}"]:
        text = f"xor({text}, {term})"
    return text


def _as_number(text: str, alphabet: str) -> str:
    """The number of a text whose first character is least significant."""
    place = f"(strpos('{alphabet}', substr({text}, k + 1, 1)) - 1) * CAST(pow({len(alphabet)}, k) AS BIGINT)"
    return f"CAST(list_sum(list_transform(range(length({text})), lambda k: {place})) AS BIGINT)"


def _as_text(number: str, width: str, alphabet: str) -> str:
    digit = f"({number} // CAST(pow({len(alphabet)}, k) AS BIGINT)) % {len(alphabet)}"
    return (
        f"array_to_string(list_transform(range({width}), lambda k: "
        f"substr('{alphabet}', CAST(1 + {digit} AS BIGINT), 1)), '')"
    )


def ff3_ctes(
    keyring: Keyring, names: list[str], source: str, result: str, alphabet: str | None = None
) -> str:
    """CTEs that turn ``source(id, name, x, n)`` into ``result(id, name, y)``.

    ``x`` is the number to encode as bigint, ``n`` its digit count, ``name`` the
    transformation; ``y`` is the encoded text.  With an ``alphabet``, ``x`` is a text of it,
    of which half must fit 32 bits.  Goes after WITH RECURSIVE.
    """
    radix = len(alphabet) if alphabet else 10
    digits = "x" if alphabet else "lpad(CAST(x AS VARCHAR), CAST(n AS INTEGER), '0')"
    if alphabet:
        halves = [_as_number(f"substr(digits, {part})", alphabet) for part in ("1, u", "u + 1")]
        done = f"{_as_text('a', 'u', alphabet)} || {_as_text('b', 'n - u', alphabet)}"
    else:
        halves = [f"CAST(reverse(substr(digits, {part})) AS BIGINT)" for part in ("1, u", "u + 1")]
        done = (
            "reverse(lpad(CAST(a AS VARCHAR), CAST(u AS INTEGER), '0'))\n"
            "         || reverse(lpad(CAST(b AS VARCHAR), CAST(n - u AS INTEGER), '0'))"
        )
    schedule, tweaks = [], []
    for name in names:
        cipher = Ff3(*keyring.fpe(name))
        rounds = cipher.cipher.round_keys
        if len(rounds) != 11:
            raise ValueError("written for 128-bit keys")
        for r, words in enumerate(rounds):
            schedule.append(f"('{name}', {r}, {', '.join(str(int(w)) for w in words)})")
        for i, word in enumerate(cipher.tweak_words):
            tweaks.append(f"('{name}', {i}, {word})")
    any_cipher = BlockCipher(bytes(16))
    lists = []
    for kind, tables in (("m", any_cipher.column_tables), ("l", any_cipher.last_tables)):
        for row, table in enumerate(tables):
            numbers = ", ".join(str(int(v)) for v in table)
            lists.append(f"CAST([{numbers}] AS BIGINT[]) AS {kind}{row}")
    p = result
    middle = [f"CASE v.r WHEN 10 THEN {_mixed('l', c)} ELSE {_mixed('m', c)} END" for c in range(4)]
    steps = ", ".join(
        f"CASE v.r WHEN 0 THEN xor({start}, s.k{c}) ELSE {middle[c]} END AS w{c}"
        for c, start in enumerate(("b", "CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)", "w.word"))
    )
    modulus = f"CAST(pow({radix}, CASE (step // 11) % 2 WHEN 0 THEN u ELSE n - u END) AS BIGINT)"
    horner = "w3 % m"
    for word in ("w2", "w1", "w0"):
        horner = f"(({horner}) * 4294967296 + {word}) % m"
    return f"""
{p}_tables AS MATERIALIZED (SELECT {', '.join(lists)}),
{p}_schedule(name, r, k0, k1, k2, k3) AS MATERIALIZED (VALUES {', '.join(schedule)}),
{p}_tweaks(name, i, word) AS MATERIALIZED (VALUES {', '.join(tweaks)}),
{p}_start AS (
  SELECT id, name, n, (n + 1) // 2 AS u, {digits} AS digits FROM {source}
),
{p}_run(id, name, n, u, a, b, step, w0, w1, w2, w3) AS (
  SELECT id, name, CAST(n AS BIGINT), CAST(u AS BIGINT),
         {halves[0]},
         {halves[1]},
         CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM {p}_start
  UNION ALL
  SELECT id, name, n, u,
         CASE r WHEN 10 THEN b ELSE a END,
         CASE r WHEN 10 THEN (a + ({horner})) % m ELSE b END,
         step + 1, w0, w1, w2, w3
  FROM (
    SELECT v.id, v.name, v.n, v.u, v.a, v.b, v.step, v.m, v.r, {steps}
    FROM (SELECT *, step % 11 AS r, {modulus} AS m FROM {p}_run WHERE step < {11 * ROUNDS}) v
    JOIN {p}_schedule s ON s.name = v.name AND s.r = v.r
    JOIN {p}_tweaks w ON w.name = v.name AND w.i = v.step // 11
    CROSS JOIN {p}_tables t
  )
),
{p} AS (
  SELECT id, name, {done} AS y
  FROM {p}_run WHERE step = {11 * ROUNDS}
)"""
