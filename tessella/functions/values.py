"""Value semantics: cleaning, encoding repair, equivalence and keys, as column expressions.

All rules, repair of mis-decoded text included, are built-in functions, so comparisons stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Key parts that mean "nothing".
PLACEHOLDERS = ("n/a", "s/n", "sn", "null", "")
#: White space at the ends of a value, no-break space and byte order mark included.
_EDGE = r"^[\s ﻿]+|[\s ﻿]+$"


def clean_value(c: Column) -> Column:
    """Null becomes empty; trimmed; one quote off each end; trimmed; CR, LF, TAB and no-break space out; a final ".0" out.
    Values of letters, digits and a few marks, the most, have nothing to clean and pass one test only."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(_plain(text), text).otherwise(_cleaned(text))


def _plain(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9|_-]*\z")


def _cleaned(c: Column) -> Column:
    c = F.regexp_replace(c, _EDGE, "")
    c = F.regexp_replace(F.regexp_replace(c, "^[\"']", ""), "[\"']$", "")
    c = F.regexp_replace(F.regexp_replace(c, _EDGE, ""), "[\r\n\t ]", "")
    return F.regexp_replace(c, r"\.0$", "")


#: The characters that Windows-1252 has in places 80 to 9F, and those places.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_PLACES = "".join(chr(c.encode("cp1252")[0]) for c in _CP1252)


def repair_encoding(c: Column) -> Column:
    """Undoes one reading of UTF-8 as Windows-1252; a text that isn't such comes back as it is."""
    bytes_ = F.translate(c, _CP1252, _PLACES)
    text = F.encode(bytes_, "ISO-8859-1").cast("string")
    return F.when(c.rlike("[ÃÂ]") & bytes_.rlike(r"^[\x00-\xff]*$") & F.is_valid_utf8(text), text).otherwise(c)


def clean_key(c: Column, repair: bool = True) -> Column:
    """Keys compare in lower case after cleaning and repair; a plain one needs neither, so it is looked at once."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    odd = F.transform(F.array(_cleaned(text)), lambda x: F.lower(repair_encoding(x) if repair else x))[0]
    return F.when(_plain(text), F.lower(text)).otherwise(odd)


#: Characters that a wrong decoding leaves: replacement, Hangul, CJK, kana, private use, controls.
GLYPH = "[�가-힯ᄀ-ᇿ一-鿿㐀-䶿぀-ヿ-\u0080-\u009f]"


def has_glyphs(c: Column) -> Column:
    return F.coalesce(c.rlike(GLYPH), F.lit(False))


def glyph_match(damaged: Column, clean: Column) -> Column:
    """Whether a value with damaged characters can stand for the clean one: n of them in a row for n to 2n letters."""
    quoted = F.regexp_replace(damaged, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(quoted, GLYPH, r"\\p{L}{1,2}"), F.lit("$"))
    return (F.abs(F.length(damaged) - F.length(clean)) <= 5) & F.regexp_like(clean, pattern)


def equivalent(a: Column, b: Column, encoding: bool = True) -> Column:
    """Equality of cleaned values, case kept; with ``encoding`` also through repair and damaged characters, which is
    looked at only where a suspicious character stands."""
    return equivalent_cleaned(clean_value(a), clean_value(b), encoding)


def equivalent_cleaned(x: Column, y: Column, encoding: bool = True) -> Column:
    """``equivalent`` of values that are cleaned already."""
    if not encoding:
        return x == y
    odd = x.rlike(f"[ÃÂ]|{GLYPH}") | y.rlike(f"[ÃÂ]|{GLYPH}")
    damaged = F.when(has_glyphs(x) & ~has_glyphs(y), glyph_match(x, y)).when(has_glyphs(y) & ~has_glyphs(x), glyph_match(y, x)).otherwise(False)
    return F.when(x == y, True).when(odd, (repair_encoding(x) == repair_encoding(y)) | damaged).otherwise(False)


def composite_key(parts: list[Column], placeholders: bool = False, repair: bool = True) -> Column:
    """Cleaned parts joined by a pipe; null only if every part is empty (or a placeholder, if those count as such)."""
    cleaned = [clean_key(p, repair) for p in parts]
    if placeholders:
        cleaned = [F.when(c.isin(*PLACEHOLDERS), F.lit("")).otherwise(c) for c in cleaned]
    # Marks alone are as long as the marks just if every part is empty. Each part is named once: the code for cleaning is long.
    return F.nullif(F.concat_ws("|", *cleaned), F.lit("|" * (len(parts) - 1)))


def display_key(parts: list[Column]) -> Column:
    return F.concat_ws(" | ", *[F.nullif(clean_value(p), F.lit("")) for p in parts])


def content_signature(columns: list[Column]) -> Column:
    """Cleaned values as the text of a JSON array."""
    return F.to_json(F.array(*[clean_value(c) for c in columns]))


def fold(c: Column) -> Column:
    """Lower case without accents, for name search."""
    source, target = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"
    return F.translate(F.lower(c), source, target)


def normalised_name(c: Column) -> Column:
    """Column names: no accents, lower case, letters and digits only."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def urn_tail(c: Column) -> Column:
    """The number at the end of a URN, null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")), F.lit("9" * 18)).cast("bigint")


def key_segment(c: Column) -> Column:
    """Upper-case trimmed part of an address key; placeholders become NONE."""
    c = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(c.isin("S/N", "SN", "0", "", "N/A"), "NONE").otherwise(c)


def geo_bucket(lat: Column, lng: Column, parcel: Column) -> Column:
    """Rounded position as text: two decimals with a parcel number, three without; null without a position."""
    two = F.concat(F.format_number(lat, "0.00"), F.lit(","), F.format_number(lng, "0.00"))
    three = F.concat(F.format_number(lat, "0.000"), F.lit(","), F.format_number(lng, "0.000"))
    return F.when(F.coalesce(F.trim(parcel), F.lit("")) != "", two).otherwise(three)


def percentage_text(c: Column) -> Column:
    """A decimal without trailing zeros."""
    text = c.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def half_up(c: Column, factor: float) -> Column:
    """Rounding with ties toward plus infinity, to multiples of 1 / factor."""
    return F.floor(c * factor + F.lit(0.5)) / factor


def valid_date(text: Column, pattern: str) -> Column:
    """The calendar date in a compact text, null unless it is one."""
    return F.try_to_date(text, pattern)


def sql_literal(c: Column) -> Column:
    """Text as a SQL literal: NULL, or quotes doubled, in escape form with a backslash or line break."""
    doubled = F.regexp_replace(c, "'", "''")
    escaped = F.regexp_replace(F.regexp_replace(doubled, r"\\", r"\\\\"), "\n", r"\\n")
    return F.when(c.isNull(), "NULL").when(c.rlike(r"[\\\n]"), F.concat(F.lit("E'"), escaped, F.lit("'"))).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def sql_geometry(text: Column, file_srid: int, target_srid: int, multi: bool) -> Column:
    """A geometry text as a SQL expression: read with the file's SRID, transformed where the target's differs, as a multi-part
    geometry where the target's column wants it; NULL without one."""
    made = F.concat(F.lit("ST_GeomFromText("), sql_literal(text), F.lit(f", {file_srid})"))
    if target_srid != file_srid:
        made = F.concat(F.lit("ST_Transform("), made, F.lit(f", {target_srid})"))
    if multi:
        made = F.concat(F.lit("ST_Multi("), made, F.lit(")"))
    return F.when(text.isNull(), "NULL").otherwise(made)


def sql_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, no stretch edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]
