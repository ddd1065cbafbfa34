"""SHA-512 as SQL, for checks in an engine that has no such function."""

from __future__ import annotations

# Texts are shorter than a block of 128 bytes, so one block is all. round
# constants and first state of the standard, the first 64 bits of the fractions of the cube and square roots of primes.
def _primes(n: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < n:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _fraction_of_root(number: int, power: int) -> int:
    """First 64 bits of the fraction of a root, exact."""
    scaled, low, high = number << (64 * power), 0, 1 << 68
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle)
    return low % (1 << 64)


_M64 = "18446744073709551615::UHUGEINT"


def _rotated(x: str, n: int) -> str:
    return f"((({x}) >> {n}) | ((({x}) << {64 - n}) & {_M64}))"


def _mixed(x: str, a: int, b: int, c: int, shift: bool) -> str:
    last = f"(({x}) >> {c})" if shift else _rotated(x, c)
    return f"xor(xor({_rotated(x, a)}, {_rotated(x, b)}), {last})"


def sha512_sql(table: str, key: str, value: str) -> str:
    """(key, digest) of a text column of at most 111 bytes."""
    constants = ", ".join(f"{_fraction_of_root(p, 3)}::UHUGEINT" for p in _primes(80))
    first = [_fraction_of_root(p, 2) for p in _primes(8)]
    names = "abcdefgh"
    block = f"hex({value}) || '80' || repeat('0', 238 - 2 * strlen({value})) || lpad(printf('%x', 8 * strlen({value})), 16, '0')"
    digest = " || ".join(f"lpad(printf('%x', (({n} + {v}::UHUGEINT) & {_M64})::UBIGINT), 16, '0')" for n, v in zip(names, first, strict=True))
    t1 = (f"(h + {_mixed('e', 14, 18, 41, False)} + xor(e & f, xor(e, {_M64}) & g) + ([{constants}])[i + 1] + w[i + 1])")
    t2 = f"({_mixed('a', 28, 34, 39, False)} + xor(xor(a & b, a & c), b & c))"
    return f"""
WITH RECURSIVE blocks AS (SELECT {key}, {block} AS m FROM {table}),
w AS (
  SELECT {key}, list_transform(range(0, 16), lambda j: ('0x' || m[16 * j + 1:16 * j + 16])::UBIGINT::UHUGEINT) AS w FROM blocks
  UNION ALL
  SELECT {key}, list_append(w, (w[len(w) - 15] + {_mixed('w[len(w) - 14]', 1, 8, 7, True)} + w[len(w) - 6]
    + {_mixed('w[len(w) - 1]', 19, 61, 6, True)}) & {_M64}) FROM w WHERE len(w) < 80
), s AS (
  SELECT {key}, 0 AS i, w, {", ".join(f"{v}::UHUGEINT AS {n}" for n, v in zip(names, first, strict=True))} FROM w WHERE len(w) = 80
  UNION ALL
  SELECT {key}, i + 1, w, ({t1} + {t2}) & {_M64}, a, b, c, (d + {t1}) & {_M64}, e, f, g FROM s WHERE i < 80
)
SELECT {key}, {digest} AS digest FROM s WHERE i = 80
"""
