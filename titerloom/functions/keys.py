"""Normalised keys and cleaned text, as Column -> Column functions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from titerloom.functions.binding import let

WHITE = r"(?U)\s+"
PUNCTUATION = ".:;,()[]{}"


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_chars(x: Column, characters: str) -> Column:
    return F.btrim(x, F.lit(characters))


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, WHITE, " "))


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, str]:
    """Compatibility decompositions, reduced to ASCII, of all characters that have one: characters and
    the letters they become, in two texts, and a JSON map of those that become several."""
    one, letters, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ascii_ = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(ascii_) == 1:
            one.append(chr(code))
            letters.append(ascii_)
        elif ascii_:
            several[chr(code)] = ascii_
    return "".join(one), "".join(letters), json.dumps(several)


def to_ascii(x: Column) -> Column:
    """Accents off, compatibility forms spelled out, whatever is left beyond ASCII dropped."""
    one, letters, several = _folds()
    plain = lambda t: F.char_length(t) == F.octet_length(t)
    spelled = F.from_json(F.lit(several), "map<string,string>")
    each = lambda t: F.transform(F.split(t, ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.coalesce(F.try_element_at(spelled, c), F.lit(""))))
    rest = let(F.translate(x, one, letters), lambda t: F.when(plain(t), t).otherwise(F.array_join(each(t), "")))
    return F.when(plain(x), x).otherwise(rest)


def folded(x: Column) -> Column:
    """to_ascii of an expression worth computing once."""
    return let(x, to_ascii)


def unit_key(unit: Column, decimal_comma: bool = True) -> Column:
    """Units alike in this key are the same unit; decimal_comma=False is the client's form."""
    x = strip(unit)
    if decimal_comma:
        x = F.regexp_replace(x, r"(?<=\d),(?=\d)", ".")
    x = F.translate(casefold(F.regexp_replace(x, WHITE, "")), "μµ", "uu")
    return blank_to_null(x)


def units_equivalent(a: Column, b: Column, both_null: bool = False) -> Column:
    """both_null: what two absent units are; the server says False, the client True."""
    x, y = unit_key(a), unit_key(b)
    return F.when(x.isNull() & y.isNull(), F.lit(both_null)).otherwise(F.coalesce(x == y, F.lit(False)))


def marker_key(name: Column) -> Column:
    return casefold(to_ascii(name))


def alias_key(name: Column) -> Column:
    x = casefold(to_ascii(name))
    x = F.regexp_replace(x, r"(?<=\S)\[", " [")
    x = F.regexp_replace(x, r"\s+-\s*|\s*-\s+", " ")
    x = F.replace(x, F.lit("+"), F.lit(""))
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def lookup_key(name: Column) -> Column:
    return alias_key(F.regexp_replace(name, r"\[[^\]]*\]", " "))


def source_value(x: Column) -> Column:
    x = strip(casefold(to_ascii(x)))
    x = F.regexp_replace(F.regexp_replace(x, r"[\s_./]+", "-"), r"[^a-z0-9-]", "")
    return strip_chars(F.regexp_replace(x, "-{2,}", "-"), "-")


def source_tag(x: Column) -> Column:
    return F.when(source_value(x) != "", F.concat(F.lit("source:"), source_value(x)))


def is_source_tag(tag: Column) -> Column:
    return F.startswith(F.lower(tag), F.lit("source:"))


def source_tag_value(tag: Column) -> Column:
    return F.when(is_source_tag(tag), blank_to_null(strip(F.substring(tag, 8, 1 << 20))))


def normal_tag(raw: Column) -> Column:
    x = strip(raw)
    value = F.regexp_extract(x, r"(?i)^source\s*:\s*(.*)$", 1)
    tagged = F.rlike(x, F.lit(r"(?i)^source\s*:"))
    return F.when(tagged, F.coalesce(source_tag(value), F.lit(""))).otherwise(x)


def clean_qualitative(x: Column) -> Column:
    return blank_to_null(strip(casefold(strip_chars(collapse(x), PUNCTUATION))))


def qualitative_key(x: Column) -> Column:
    def key(y: Column) -> Column:
        words = F.trim(F.regexp_replace(F.replace(y, F.lit("-"), F.lit(" ")), WHITE, " "))
        return blank_to_null(F.when(F.rlike(y, F.lit(r"^[+\-/]+$")), y).otherwise(words))

    return let(strip_chars(folded(clean_qualitative(x)), PUNCTUATION), key)


def search_text(x: Column) -> Column:
    return F.coalesce(collapse(x), F.lit(""))


def document_text(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "\n{3,}", "\n\n")
    return blank_to_null(strip(x))


def optional_text(x: Column) -> Column:
    return blank_to_null(strip(x))


def file_task_key(file_id: Column, kind: Column | str, start: Column, stop: Column, dpi: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", F.lit("file"), file_id.cast("string"), kind, start.cast("string"), stop.cast("string"), dpi.cast("string"))


def rule_task_key(type_id: Column, original: Column, target: Column) -> Column:
    return F.concat_ws("|", type_id.cast("string"), original, target)


def measurement_of_task(key: Column) -> Column:
    return F.regexp_extract(key, r"^measurement:(\d+)$", 1).try_cast("bigint")


def slug(x: Column) -> Column:
    y = F.regexp_replace(F.regexp_replace(to_ascii(x), r"\.[A-Za-z0-9]+$", ""), r"[^\w\s-]", "")
    y = strip_chars(F.lower(F.regexp_replace(strip(y), r"[\s_-]+", "-")), "-")
    return F.coalesce(blank_to_null(y), F.lit("export"))


def markdown_cell(x: Column) -> Column:
    return F.replace(strip(F.regexp_replace(x, r"[\r\n]+", " ")), F.lit("|"), F.lit("\\|"))


def query_tokens(q: str) -> list[str]:
    """The words of a search: letters, digits and underscores, lowered, in order."""
    import re

    return re.findall(r"\w+", q.casefold())


def text_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def snippet(x: Column, tokens: list[str], before: int = 60, after: int = 140) -> Column:
    """The stretch around the earliest token, with marks where the text goes on; null without a hit."""
    low = F.lower(x)
    hits = F.filter(F.array(*[F.instr(low, t) for t in tokens]), lambda i: i > 0)
    at = F.array_min(hits) - 1
    start, stop = F.greatest(at - before, F.lit(0)), F.least(at + after, F.length(x))
    body = strip(F.substring(x, start + 1, stop - start))
    return F.when(F.size(hits) > 0, F.concat(F.when(start > 0, F.lit("… ")).otherwise(""), body, F.when(stop < F.length(x), F.lit(" …")).otherwise("")))


def distinct_aliases(aliases: Column, name: Column) -> Column:
    """Aliases other than the name itself, distinct by key, sorted without regard to case."""
    other = F.filter(F.transform(aliases, strip), lambda a: (a != "") & (alias_key(a) != alias_key(name)))
    first = F.filter(other, lambda a, i: F.array_position(F.transform(other, alias_key), alias_key(a)) == i + 1)
    return F.array_sort(first, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))


def union_tags(*tags: Column) -> Column:
    """Tag lists in order, normalised, blanks dropped, the first of equals kept."""
    return F.array_distinct(F.filter(F.transform(F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in tags]), normal_tag), lambda t: t != ""))


def json_object_map(text: Column) -> Column:
    """A JSON object as a map of texts; anything else, broken JSON and null, as the empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def cache_key(version: Column, name: Column, signature: Column) -> Column:
    """24 hexadecimal digits that name what is drawn of a marker in one version of the style."""
    return F.substring(F.sha2(F.concat(version, F.lit(":"), name, F.lit(":"), signature).cast("binary"), 256), 1, 24)
