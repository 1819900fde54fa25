"""Format-preserving encryption of digit strings as a column expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from veladura.functions import ff3
from veladura.keys import Keyring
from veladura.policy import transformation

# Ship the kernel inside the serialised function: executors need numpy and
# pyarrow, but no copy of this package.
cloudpickle.register_pickle_by_value(ff3)


def cipher_udf(name: str, keyring: Keyring, digits: int | None = None, decode: bool = False):
    """Arrow function over bigint digits; takes the digit count too unless it is fixed."""
    cipher = ff3.Ff3(*keyring.fpe(name))

    def run(values: pa.Array, widths: pa.Array | None) -> pa.Array:
        # rows without a usable value arrive as null and cost nothing
        given = values.is_valid()
        numbers = values.drop_null().to_numpy(zero_copy_only=False)
        sizes = digits if widths is None else widths.filter(given).to_numpy(zero_copy_only=False)
        coded = cipher.run(numbers, sizes, decode)
        if not values.null_count:
            return pa.array(coded)
        mask = given.to_numpy(zero_copy_only=False)
        out = np.zeros(len(values), dtype=np.int64)
        out[mask] = coded
        return pa.array(out, mask=~mask)

    def fixed(values: pa.Array) -> pa.Array:
        return run(values, None)

    def varying(values: pa.Array, widths: pa.Array) -> pa.Array:
        return run(values, widths)

    chosen = varying if digits is None else fixed
    chosen.__name__ = f"{'decode' if decode else 'encode'}_{name.replace('-', '_')}"
    hints = {h: pa.Array for h in chosen.__annotations__}
    chosen.__annotations__ = hints  # as objects, for the kind of function to be inferred
    return F.arrow_udf(chosen, "bigint")


def fpe(
    digits: Column, name: str, keyring: Keyring, decode: bool = False, pin: bool = False
) -> Column:
    """Encode (or decode) text of digits; null where it does not fit the template.

    ``pin`` keeps the optimizer from copying the cipher into a filter: a join on the
    result, or a condition on it, would else run the cipher twice per row.  The price
    is that no filter moves below it, so filter first.
    """
    t = transformation(name)
    number = F.when(digits.rlike(t.template), digits.cast("bigint"))
    function = cipher_udf(name, keyring, t.digits, decode)
    if pin:
        function = function.asNondeterministic()
    if t.digits is not None:
        return F.lpad(function(number).cast("string"), t.digits, "0")
    width = F.length(digits)
    return F.lpad(function(number, width).cast("string"), width, "0")


# Where separators may stand in the numbers that are written with them.
_SEPARATED = {
    "ff-cpf": (r"^([0-9]{3})(\.?)([0-9]{3})(\.?)([0-9]{3})([-./]?)([0-9]{2})\z", (3, 3, 3, 2)),
    "ff-cnpj": (
        r"^([0-9]{2})(\.?)([0-9]{3})(\.?)([0-9]{3})([-./]?)([0-9]{4})([-./]?)([0-9]{2})\z",
        (2, 3, 3, 4, 2),
    ),
}


def like_original(coded: Column, original: Column, name: str) -> Column:
    """Put the separators of the original back between the coded digits."""
    if name not in _SEPARATED:
        return coded
    pattern, sizes = _SEPARATED[name]
    pieces, start = [], 1
    for place, size in enumerate(sizes):
        if place:
            pieces.append(F.regexp_extract(original, pattern, 2 * place))
        pieces.append(F.substring(coded, start, size))
        start += size
    return F.when(original.rlike(pattern), F.concat(*pieces)).otherwise(coded)
