"""Keys under which names are found: trigrams, sounds, initials."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .reference_data import MIN_ACRONYM
from .text import strip_legal_forms, strip_legal_suffix, tokens


def explode_keys(col: Column | str) -> Column:
    """One row a key; rows without keys have a null one, which joins drop.

    A plain ``explode`` makes Spark infer ``size(col) > 0`` and push it to the scan, where all that ``col`` is made of is
    spelled out and worked out a second time.
    """
    return F.explode_outer(col)


def trigrams(norm: Column) -> Column:
    """Distinct three-letter windows of each lower-cased word, padded with two blanks before and one behind.

    A window is one long, its three code points side by side: sets of longs are intersected and shuffled faster than strings.
    """
    point = lambda s, i: F.ascii(F.substr(s, i, F.lit(1))).cast("long")
    window = lambda s, i: F.shiftleft(point(s, i), 42) + F.shiftleft(point(s, i + 1), 21) + point(s, i + 2)
    padded = lambda w: F.concat(F.lit("  "), F.lower(w), F.lit(" "))
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: window(w, i))
    return F.array_distinct(F.flatten(F.transform(F.transform(tokens(norm), padded), windows)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


_VOWELS = "aeiou"
_SAME = "fjlmnr"


@functools.lru_cache(200_000)
def metaphone(word: str) -> str:
    """Metaphone of one ASCII word, after the rules that Lawrence Philips published (Computer Language 7 (12), 1990)."""
    w = word.lower()
    if w[:2] in ("ae", "gn", "kn", "pn", "wr"):
        w = w[1:]
    out, i, n = [], 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    is_in = lambda c, group: bool(c) and c in group
    while i < n:
        c, d, e, before = w[i], at(i + 1), at(i + 2), at(i - 1)
        step = 1
        if c == d and c != "c":
            i += 1
            continue
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c in _SAME:
            out.append(c)
        elif c == "b":
            if before != "m" or d:
                out.append("b")
        elif c == "c":
            if d == "h" or (d == "i" and e == "a"):
                out.append("x")
                step = 2
            elif is_in(d, "iey"):
                out.append("s")
                step = 2
            else:
                out.append("k")
        elif c == "d":
            soft = d == "g" and is_in(e, "iey")
            out.append("j" if soft else "t")
            step = 3 if soft else 1
        elif c == "g":
            if is_in(d, "iey"):
                out.append("j")
            elif (d == "h" and e and e not in _VOWELS) or (d == "n" and not e):
                step = 2
            else:
                out.append("k")
        elif c == "h":
            if i == 0 or is_in(d, _VOWELS) or before not in _VOWELS:
                out.append("h")
        elif c == "k":
            if before != "c":
                out.append("k")
        elif c == "p":
            out.append("f" if d == "h" else "p")
            step = 2 if d == "h" else 1
        elif c == "q":
            out.append("k")
        elif c == "s":
            if d == "h":
                out.append("x")
                step = 2
            elif d == "i" and is_in(e, "oa"):
                out.append("x")
                step = 3
            else:
                out.append("s")
        elif c == "t":
            if d == "i" and is_in(e, "oa"):
                out.append("x")
            elif d == "h":
                out.append("0")
                step = 2
            elif d != "c" or e != "h":
                out.append("t")
        elif c == "v":
            out.append("f")
        elif c == "w":
            if i == 0 and d == "h":
                step, d = 2, e
            if is_in(d, _VOWELS):
                out.append("w")
        elif c == "x":
            if i:
                out.append("ks")
            else:
                out.append("x" if d == "h" or (d == "i" and is_in(e, "oa")) else "s")
        elif c == "y":
            if is_in(d, _VOWELS):
                out.append("y")
        elif c == "z":
            out.append("s")
        i += step
    return "".join(out).upper()


@F.arrow_udf(ArrayType(StringType()))
def phonetic_keys(norm: pa.Array) -> pa.Array:
    """Sorted metaphones of the alphabetic words of three letters or more; each distinct word of a batch is worked out once."""
    lists = pc.split_pattern(pc.fill_null(norm, ""), " ")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    sounds = [metaphone(t) if len(t) >= 3 and t.isalpha() else "" for t in coded.dictionary.to_pylist()]
    order, number = np.unique(np.array(sounds, dtype=object).astype(str), return_inverse=True) if sounds else (np.zeros(0, str), np.zeros(0, int))
    number = number[coded.indices.to_numpy(zero_copy_only=False)]
    heard = order[number] != "" if len(order) else np.zeros(0, bool)
    pairs = np.unique(rows[heard].astype(np.int64) * max(1, len(order)) + number[heard])  # by row, then by sound
    row, sound = pairs // max(1, len(order)), pairs % max(1, len(order))
    offsets = np.searchsorted(row, np.arange(len(norm) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order[sound].tolist(), pa.string()))


def initials(norm: Column) -> Column:
    return F.array_join(F.transform(tokens(norm), lambda t: F.left(t, F.lit(1))), "")


def _variants(norm: Column) -> list[Column]:
    return [norm, F.trim(strip_legal_suffix(norm)), strip_legal_forms(norm)]


def acronyms(norm: Column) -> Column:
    """Initials with no, one and all legal forms stripped; three letters at least, sorted."""
    return F.array_sort(F.filter(F.array_distinct(F.array(*map(initials, _variants(norm)))), lambda a: F.char_length(a) >= MIN_ACRONYM))


def query_acronyms(norm: Column, subject_type: Column) -> tuple[Column, Column]:
    """Of an entity: the acronym that the query may be, and those that it may spell out."""
    none = F.array().cast("array<string>")
    entity = subject_type == "entity"
    single = ~norm.contains(" ") & (F.char_length(norm) >= MIN_ACRONYM)
    spelled = F.array_distinct(F.filter(F.array(*[F.when(v.contains(" "), initials(v)).otherwise("") for v in _variants(norm)]), lambda a: F.char_length(a) >= MIN_ACRONYM))
    return F.when(entity & single, F.array(norm)).otherwise(none), F.when(entity, F.array_sort(spelled)).otherwise(none)
