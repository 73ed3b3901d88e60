"""What is said about models, in one form: families, quantisations, sizes and contexts; and where what is declared differs from what is observed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Families by words in a name, the first that matches, and versions of one of them.
FAMILIES = (("DEEPSEEK", ("deepseek",)), ("LLAMA", ("llama",)), ("QWEN", ("qwen",)))
QWEN_VERSIONS = (("QWEN2.5", "2.5"), ("QWEN3", "3"))
KINDS = ("quantization", "parameter_size", "runtime_context_length", "max_context_length", "context_length")


def model_family(name: Column) -> Column:
    """DEEPSEEK, LLAMA, QWEN2.5, QWEN3, QWEN_OTHER, or null; a distilled model is of the family named first in FAMILIES."""

    def told(low):
        version = F.lit("QWEN_OTHER")
        for family, mark in reversed(QWEN_VERSIONS):
            version = F.when(F.contains(low, F.lit(mark)), family).otherwise(version)
        out = F.lit(None).cast("string")
        for family, words in reversed(FAMILIES):
            named = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
            out = F.when(named, version if family == "QWEN" else F.lit(family)).otherwise(out)
        return out

    return bound(F.lower(F.trim(name)), told)


def number(value: Column) -> Column:
    """A number as text without needless decimals; null of anything else."""
    whole = lambda x: F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))
    return bound(F.trim(value).try_cast("double"), whole)


def parameter_size(value: Column) -> Column:
    """7B, 7.0 b and ' 7b ' as 7b; other texts in lower case without blanks."""
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$"
    return bound(F.lower(F.trim(value)), lambda x: F.when(x.rlike(pattern), F.concat(number(F.regexp_extract(x, pattern, 1)), F.regexp_extract(x, pattern, 2))).otherwise(F.replace(x, F.lit(" "), F.lit(""))))


def canonical(kind: str, value: Column) -> Column:
    """A declared or observed value in the form in which it is compared."""
    if kind == "parameter_size":
        return parameter_size(value)
    low = F.lower(F.trim(value))
    return F.coalesce(number(value), low) if kind.endswith("context_length") else low


def discrepancies(declared: dict[str, Column], observed: dict[str, Column]) -> Column:
    """The kinds whose declared and observed values differ, in the order of KINDS; what isn't known on one side doesn't."""
    each = [F.when(canonical(k, declared[k]) != canonical(k, observed[k]), F.lit(k)) for k in KINDS if k in declared and k in observed]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
