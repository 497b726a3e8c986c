"""Name text as column expressions; the only Python is ``fold``, for callers who want marks removed and nothing else."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .reference_data import GENERIC, JURISDICTION, LEADING, TRAILING


def py_fold(s: str) -> str:
    """NFKD without characters that combine."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def py_normalize(s: str) -> str:
    return re.sub("[^A-Z0-9]+", " ", py_fold(s).upper().replace("&", " AND ")).strip()


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(py_fold, na_action="ignore")


@functools.cache
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Characters that become one other (from, to), those that become several, those that vanish."""
    one, several, gone = {}, {}, []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if not unicodedata.decomposition(c) and not unicodedata.combining(c) and not c.upper().isascii():
            continue  # most: a separator
        out = py_fold(c).upper().replace("&", " AND ")
        out = re.sub("[^A-Z0-9]", " ", out)
        if not out:
            gone.append(c)
        elif out == " ":
            continue
        elif len(out) == 1:
            one[c] = out
        elif out.strip():
            several[c] = out
    return "".join(one), "".join(one.values()), several, "".join(gone)


def upper_ascii(col: Column) -> Column:
    """Folded and upper-cased, where only ASCII letters and digits matter afterwards; lone ASCII skips the tables."""
    one_from, one_to, several, gone = _fold_tables()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one constant, not a tree of two thousand
    expand = F.when(
        col.rlike("[" + "".join(several) + "]"),
        F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""),
    ).otherwise(col)
    # characters past the end of the second list are removed
    full = F.translate(expand, one_from + gone, one_to)
    return F.upper(F.when(F.octet_length(col) == F.char_length(col), col).otherwise(full))


def normalize(col: Column) -> Column:
    """Marks folded, upper case, ``&`` as AND, runs of anything else than A-Z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(upper_ascii(col), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))


def tokens(norm: Column) -> Column:
    """Words of a normalised name; none for the empty one."""
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


_TRAIL, _LEAD = "|".join(TRAILING), "|".join(LEADING)


def find_legal_suffix(norm: Column) -> Column:
    """The longest legal form that ends the name (or is it), else null."""
    return F.nullif(F.regexp_extract(norm, f"(?:^| )({_TRAIL})$", 1), F.lit(""))


def jurisdiction(norm: Column) -> Column:
    """The country that the name's trailing legal form suggests, else null."""
    table = F.create_map(*[F.lit(x) for kv in JURISDICTION.items() for x in kv])
    return F.try_element_at(table, find_legal_suffix(norm))


def strip_legal_suffix(norm: Column) -> Column:
    """Without one trailing legal form; may leave nothing."""
    return F.regexp_replace(norm, f"(?:^| )(?:{_TRAIL})$", "")


def strip_legal_forms(norm: Column) -> Column:
    """Without all legal forms at both ends: one at the end, then one at the front, as often as there are words.

    A rest that is a legal form itself stays, so a name never becomes empty.
    """
    alone = F.array(*map(F.lit, TRAILING))
    strip = lambda acc, _: F.regexp_replace(
        F.when(F.array_contains(alone, acc), acc).otherwise(F.regexp_replace(acc, f" (?:{_TRAIL})$", "")), f"^(?:{_LEAD}) ", ""
    )
    affected = norm.rlike(f"(?: (?:{_TRAIL})$)|(?:^(?:{_LEAD}) )")
    return F.when(affected, F.aggregate(F.sequence(F.lit(1), F.size(F.split(norm, " "))), norm, strip)).otherwise(norm)


def distinctive_tokens(norm: Column) -> Column:
    """Words of the stem that are longer than one letter, not generic and not the name's own legal form."""
    generic = F.array(*map(F.lit, sorted(GENERIC)))
    suffix = F.coalesce(find_legal_suffix(norm), F.lit(""))
    return F.filter(tokens(F.trim(strip_legal_suffix(norm))), lambda t: (F.char_length(t) > 1) & ~F.array_contains(generic, t) & (t != suffix))


def natural_order(name: Column, individual: Column) -> Column:
    """``LAST, First`` as ``First LAST``, for individuals only."""
    return F.when(individual, F.regexp_replace(name, "(?s)^(.*?), (.*)$", "$2 $1")).otherwise(name)


def full_name(last: Column, first: Column) -> Column:
    return F.when(F.coalesce(last, F.lit("")) == "", None).when(F.coalesce(first, F.lit("")) == "", last).otherwise(F.concat(last, F.lit(", "), first))


def feature_type(name: Column) -> Column:
    """``SWIFT/BIC`` as ``swift_bic``."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def listed_date(raw: Column) -> Column:
    """``10 Dec 1948`` as a date; years, ranges and ``circa`` are null."""
    return F.try_to_date(F.initcap(F.lower(F.trim(raw))), "d MMM yyyy")


def title_case(col: Column) -> Column:
    """Every run of cased letters with a capital (``Al-Zawahiri``), unlike ``initcap``; a leading ``ß`` becomes ``Ss``."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    first = lambda t: F.upper(F.left(t, F.lit(1)))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.left(first(t), F.lit(1)), F.lower(F.substr(first(t), F.lit(2))), F.substr(t, F.lit(2)))), "")


def years(col: Column) -> Column:
    """All years from 1800 to 2099 in a text."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"\b(1[89]\d\d|20\d\d)\b"), 1), lambda y: y.cast("int"))
