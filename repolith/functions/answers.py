"""JSON out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"
_FENCED = r"(?s)```(?:json)?\s*(.*?)```"


def is_json(text: Column) -> Column:
    """Whether all of a text is one JSON value; an object that repeats a key is none.

    The parser stops after a value, so the text stands before a mark that it can't hold itself.
    """
    mark = F.sha2(text, 256)
    held = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.coalesce(F.try_variant_get(held, "$[1]", "string") == mark, F.lit(False))


def json_part(text: Column) -> Column:
    """The part of a text that is JSON: all of it, its first fenced block, or from its first brace to its last; else null."""
    whole = F.regexp_replace(text, _EDGES, "")
    fenced = F.regexp_replace(F.regexp_extract(whole, _FENCED, 1), _EDGES, "")
    first, last = F.instr(whole, "{"), F.length(whole) - F.instr(F.reverse(whole), "}") + 1
    braced = F.when((first > 0) & F.contains(whole, F.lit("}")) & (last > first), F.substring(whole, first, last - first + 1))
    return F.get(F.filter(F.array(whole, F.when(fenced != "", fenced), braced), is_json), F.lit(0))


def loose_json(text: Column) -> Column:
    """What ``json_part`` finds, as a variant; null where there is no JSON, a variant's null for the word null."""
    return F.try_parse_json(json_part(text))
