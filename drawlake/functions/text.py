"""Visible text of HTML and its normalisation."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

SPACE = r"[\s\x{00a0}\x{3000}]"


def strip(text: Column) -> Column:
    """Trim all kinds of blanks, including NBSP and the ideographic space."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def ascii_digits(text: Column) -> Column:
    """Full-width digits and parentheses to ASCII."""
    return F.translate(text, "０１２３４５６７８９（）", "0123456789()")


# Names of character references with their text, from the standard library's HTML table.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
# Those that also hold without a semicolon, as the beginning of a longer word too.
LENIENT = {name: text for name, text in html5.items() if not name.endswith(";")}
# Looked for before the whole table, which is searched from its start.
USUAL = ("nbsp", "amp", "lt", "gt", "quot", "apos")
# References to the C1 range mean the Windows letters at these places.
WINDOWS = {f"{b:X}": bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
REFERENCE = r"^(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*)(?=;));?"
WORD = r"^[A-Za-z][A-Za-z0-9]*"


def _table(texts: dict[str, str]) -> Column:
    """A constant map; one literal that the optimiser folds."""
    return F.from_json(F.lit(json.dumps(texts)), "map<string,string>")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read; lambdas share no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(text: Column) -> Column:
    """HTML character references as browsers take them: names, decimal and hexadecimal forms.

    Numbers need no semicolon, and neither do the old names: of a word that is no name
    the longest beginning that is one of these counts. Each reference is read once, so
    an escaped one stays text. Numbers beyond Unicode, surrogates and zero become the
    replacement character; unknown names stay.
    """

    def code_point(digits: Column) -> Column:
        return _once(F.upper(F.ltrim(digits, F.lit("0"))), short_code_point)

    def short_code_point(digits: Column) -> Column:
        number = F.when(F.length(digits) <= 6, F.conv(digits, 16, 10).cast("bigint"))
        plain = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        known = F.coalesce(F.try_element_at(_table(WINDOWS), digits), plain)
        real = lambda v: F.coalesce((v > 0) & (v <= 0x10FFFF) & ~v.between(0xD800, 0xDFFF), F.lit(False))
        return F.when(_once(number, real), known).otherwise("\ufffd")

    def named(name: Column) -> Column:
        usual = F.when(name == USUAL[0], F.lit(NAMED[USUAL[0]]))
        for known in USUAL[1:]:
            usual = usual.when(name == known, F.lit(NAMED[known]))
        return usual.otherwise(F.try_element_at(_table(NAMED), name))

    def lenient(p: Column) -> Column:
        sizes = sorted({len(n) for n in LENIENT}, reverse=True)
        found = [F.concat(F.try_element_at(_table(LENIENT), F.substring(p, 1, n)), F.substr(p, F.lit(n + 1))) for n in sizes]
        length = F.length(F.regexp_extract(p, WORD, 0))
        return _once(length, lambda word: F.coalesce(*[F.when(word >= n, f) for n, f in zip(sizes, found)]))

    def hexadecimal(decimal: Column) -> Column:
        return F.when(F.length(F.ltrim(decimal, F.lit("0"))) <= 7, F.conv(decimal, 10, 16)).otherwise("FFFFFFF")

    def read(reference: Column) -> Column:
        decimal, hexa, name = (reference[c] for c in ("decimal", "hexadecimal", "name"))
        # One kind of number at most.
        digits = F.when(decimal != "", hexadecimal(decimal)).when(hexa != "", hexa)
        return F.when((decimal != "") | (hexa != ""), code_point(digits)).when(name != "", named(name))

    def piece(p: Column) -> Column:
        groups = {name: F.regexp_extract(p, REFERENCE, g) for g, name in enumerate(("decimal", "hexadecimal", "name"), 1)}
        rest = F.regexp_replace(p, REFERENCE, "")
        known = F.concat(_once(F.struct(*[v.alias(k) for k, v in groups.items()]), read), rest)
        return F.coalesce(known, lenient(p), F.concat(F.lit("&"), p))

    pieces = F.split(text, "&")
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


def drop_invisible(html: Column) -> Column:
    """Remove comments and script, style and template elements."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, r"(?is)<(script|style|template)\b.*?</\1\s*>", "")


def visible_text(html: Column, separator: str) -> Column:
    """Non-empty text pieces between tags, trimmed and joined by ``separator``."""
    pieces = F.split(F.regexp_replace(html, r"<[^>]*>", "\u0001"), "\u0001")
    stripped = F.transform(pieces, lambda p: strip(unescape(p)))
    return F.array_join(F.filter(stripped, lambda p: p != ""), separator)


def normalise_page(text: Column) -> Column:
    """NBSP and ideographic space to space, ASCII digits and parentheses, blanks squeezed."""
    out = ascii_digits(F.translate(text, " 　", "  "))
    out = F.regexp_replace(out, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(out, r"\n+", "\n")
