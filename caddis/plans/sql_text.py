"""SQL text functions for the checking queries, written from the operators' descriptions for the DuckDB dialect."""

from __future__ import annotations

from caddis.functions.text import EDITION_NAMES, EDITION_TAIL, KEPT_LATIN, LATIN_WORD, NAME_NOISE, NOISE, ROMAN, WS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def trim(c: str) -> str:
    return sub(c, f"^{WS}+|{WS}+$")


def squeeze(c: str) -> str:
    return trim(sub(c, f"{WS}+", " "))


def normalize(c: str) -> str:
    s = sub(f"lower({c})", "[®™©]", " ")
    s = sub(sub(s, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    s = sub(s, rf"\bps4{WS}*[&＆]{WS}*ps5\b", " ")
    s = sub(s, rf"\b(?:{NOISE})\b", " ")
    s = sub(s, r"[:\-–—_'’`.\"!?,+*/\\|]", " ")
    s = squeeze(sub(s, "&", " and "))
    words = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROMAN.items())
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda w: CASE w {words} ELSE w END), ' ')"


def sequels(c: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({c}, '\\b\\d{{1,2}}\\b')))"


def flat(c: str) -> str:
    return sub(f"strip_accents({c})", "[^a-z0-9 ]")


def identity_key(c: str) -> str:
    return sub(sub(sub(f"lower(strip_accents({c}))", "[®™©]"), "&", "and"), "[^a-z0-9]")


def history_key(c: str) -> str:
    return f"trim({sub(f'lower(coalesce({c}, {q('')}))', '[^a-z0-9一-鿿]+', ' ')})"


def edition_stripped(c: str) -> str:
    return sub(c, rf"{WS}*(?:{EDITION_TAIL})\b.*$")


def before_dash(c: str) -> str:
    return f"regexp_split_to_array({c}, {q(f'{WS}+[-–—]{WS}+')})[1]"


def grams(c: str) -> str:
    return f"CASE WHEN length({c}) >= 2 THEN list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)) ELSE [] END"


def dice(a: str, b: str) -> str:
    """By counting each distinct letter pair on both sides."""
    x, y = grams(a), grams(b)
    hits = f"list_sum(list_transform(list_distinct({x}), lambda g: least(len(list_filter({x}, lambda u: u = g)), len(list_filter({y}, lambda u: u = g)))))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce({hits}, 0) / (len({x}) + len({y})) END"


def same_start(a: str, b: str) -> str:
    fa, fb = flat(a), flat(b)
    return f"(list_contains(string_split({fb}, ' '), split_part({fa}, ' ', 1)) OR (starts_with(replace({fb}, ' ', ''), split_part({fa}, ' ', 1)) AND starts_with(replace({fa}, ' ', ''), split_part({fb}, ' ', 1))))"


def same_entry(a: str, b: str) -> str:
    return f"{sequels(a)} = {sequels(b)}"


def year(c: str) -> str:
    return f"nullif(try_cast(substring({c}, 1, 4) AS INTEGER), 0)"


def has_cjk(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '[一-鿿]'), false)"


def is_mixed(c: str) -> str:
    return f"len(list_filter(regexp_extract_all({c}, {q(LATIN_WORD)}), lambda w: NOT regexp_matches({sub('w', "['’.]")}, {q(KEPT_LATIN)}))) > 0"


def tidy(c: str) -> str:
    wide = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
    s = trim(f"translate({sub(c, '[®™©]')}, {q(wide)}, {q(''.join(chr(ord(x) - 0xFEE0) for x in wide))})")
    for _ in range(2):
        for pattern in NAME_NOISE:
            s = trim(sub(s, pattern))
    s = f"regexp_replace({s}, {q(f'《([^《》]+)》{WS}*')}, '\\1 ')"
    return trim(sub(sub(s, f"{WS}+", " "), rf"{WS}+([：:）)])", r"\1"))


def only_editions(c: str) -> str:
    return f"regexp_matches({c}, '^(?:{EDITION_NAMES})+$')"
