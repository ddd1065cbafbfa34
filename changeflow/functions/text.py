"""Text predicates and masks.

White space is meant in the Unicode sense and digits likewise, hence the ``(?U)`` flag there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in a pattern that starts with ``(?U)``; the four separators count as well.
_SPACE, _NO_SPACE = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def contains_ci(x: Column, term: str) -> Column:
    return F.upper(x).contains(term.upper())


def not_system_schema(schema: Column) -> Column:
    """False for system schemas; ``_`` in the second pattern stands for any one character."""
    return ~schema.like("SYS%") & ~schema.like("_SYS%")


def row_json(*columns: Column) -> Column:
    """A row as JSON text with null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def python_slice(x: Column, start: int, length: int | None) -> Column:
    """``x[start:start+length]`` with slice rules for negative and outlying ends."""
    n = F.length(x)

    def bound(i: int) -> Column:
        return F.greatest(n + F.lit(i), F.lit(0)) if i < 0 else F.least(F.lit(i), n)

    first = bound(start)
    last = bound(start + length) if length else n
    return F.substring(x, first + 1, F.greatest(last - first, F.lit(0)))


def replace_literal(x: Column, pattern: str, replacement: str) -> Column:
    """Literal replacement; an empty pattern inserts between all characters."""
    if pattern == "":
        quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(x, "", quoted)
    return F.replace(x, F.lit(pattern), F.lit(replacement))


def mask_full(x: Column) -> Column:
    return F.when(x.isNotNull(), F.lit("***REDACTED***"))


def mask_other(x: Column) -> Column:
    return F.when(x.isNotNull(), F.lit("***MASKED***"))


def mask_partial(x: Column) -> Column:
    n = F.length(x)
    middle = F.repeat(F.lit("*"), n - 4)
    return F.when(n <= 4, F.lit("****")).when(
        n > 4, F.concat(F.left(x, F.lit(2)), middle, F.right(x, F.lit(2)))
    )


def _ends(word: Column) -> Column:
    """First character, three stars, last character when there is more than one."""
    last = F.when(F.length(word) > 1, F.right(word, F.lit(1))).otherwise(F.lit(""))
    return F.concat(F.left(word, F.lit(1)), F.lit("***"), last)


def mask_email(x: Column) -> Column:
    """Keep the ends of the local part and of the first domain label.

    Text without exactly one ``@``, or with nothing before it or right after it, is hidden whole.
    """
    sides = F.split(x, "@", -1)
    local, domain = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    labels = F.split(domain, r"\.", -1)
    first = F.get(labels, F.lit(0))
    rest = F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")
    usable = (F.size(sides) == 2) & (local != "") & (first != "")
    shown = F.concat(_ends(local), F.lit("@"), _ends(first), F.lit("."), rest)
    return F.when(x.isNull(), None).when(usable, shown).otherwise(F.lit("***@***.***"))


def _mask_digits(x: Column, lead: str, hidden: str) -> Column:
    digits = F.regexp_replace(x, r"(?U)\D", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit(lead), F.right(digits, F.lit(4)))).when(
        x.isNotNull(), F.lit(lead + hidden)
    )


def mask_phone(x: Column) -> Column:
    return _mask_digits(x, "***-***-", "****")


def mask_ssn(x: Column) -> Column:
    return _mask_digits(x, "***-**-", "****")


def mask_name(x: Column) -> Column:
    words = F.regexp_replace(x, rf"(?U)({_NO_SPACE}){_NO_SPACE}*", "$1***")
    return F.trim(F.regexp_replace(words, rf"(?U){_SPACE}+", " "))


MASKS = {
    "full": mask_full,
    "partial": mask_partial,
    "email": mask_email,
    "phone": mask_phone,
    "ssn": mask_ssn,
    "name": mask_name,
}


def mask(x: Column, kind: str) -> Column:
    return MASKS.get(kind, mask_other)(x)
