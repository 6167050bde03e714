"""Title and name normalisation as column expressions, all of them in the JVM.

Higher-order functions are interpreted there, so operators over many rows put shared parts into columns of their own
(``withColumn``) and keep ``let`` for single expressions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII word boundary, and white space as web text has it (no-break and ideographic blanks included).
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = "[一-鿿]"
# Words of platforms and editions that are no part of a title.
NOISE = (
    r"xbox (?:series x\|s|series x/s|one|360)?|windows \d*|pc|for windows|game preview|cross[- ]?gen|standalone|digital version|console version|"
    r"pc version|version|standard|deluxe|ultimate|complete|definitive|enhanced|remastered|anniversary|goty|game of the year|digital|bundle|"
    r"edition|editions|ps4|ps5|playstation ?hits|playstation ?[45]|for nintendo switch(?: 2)?|full game"
)
ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13}
# Edition words cut from a title's end by the history key, in this spelling only.
EDITION_TAIL = "standard|deluxe|ultimate|complete|definitive|enhanced|remastered|goty|game of the year|digital|bundle|edition|version|windows|pc"
# A store's platform words in localized names, and what marks a name as only an edition.
NAME_PLATFORM = rf"(?:xbox{WS}*(?:series{WS}*x{WS}*\|{WS}*s|series{WS}*x/s|one|360)?|windows(?:{WS}*10)?|pc|ps[45](?:{WS}*[&＆]{WS}*ps[45])?)"
NAME_NOISE = (
    rf"(?i){WS}*[(（]{WS}*{NAME_PLATFORM}{WS}*版?{WS}*[)）]",
    rf"(?i){WS}*[-–—]?{WS}*{NAME_PLATFORM}{WS}*版?{WS}*$",
    rf"(?i){WS}*\+{WS}*launcher{WS}*$",
    rf"{WS}*[(（]{WS}*游戏预览版{WS}*[)）]",
    rf"{WS}*[-–—]?{WS}*(?:数字|數位)?标准版{WS}*$",
    rf"{WS}*(?:跨越世代|跨世代)(?:礼包|包|版){WS}*$",
)
EDITION_NAMES = "终极|完整|标准|豪华|高级|年度游戏|游戏预览|导演剪辑|重制|高清|复刻|合辑|合集|典藏|收藏|数字|黄金|决定|周年|纪念|特别|版|包|礼包"
# What a store adds to console titles, what marks an extra, an image address with its steps, a bracket with
# Chinese, separators at a name's ends and between a name's languages, a Latin word, and an article's disambiguation.
CONSOLE_PAIR = rf"{WS}*[(\[]?{WS}*PS4[™®]?{WS}*[&＆]{WS}*PS5[™®]?{WS}*[)\]]?"
CONSOLE_HITS = rf"{WS}*-?{WS}*PlayStation®{WS}*Hits"
HANDHELD_EDITION = rf"{WS}*[-–—:]?{WS}*Nintendo Switch{WS}*2 Edition"
EXTRAS = "soundtrack|OST|art ?book|artbook|wallpapers?"
COVER_STEPS = "/image/(fetch|upload)/(?:[a-z]_[^/]*/)*"
COVER_FORM = "c_fill,ar_3:4,w_400,q_auto,f_auto"
BRACKET = rf"[(（]([^()（）]*{CJK}[^()（）]*)[)）]"
EDGE = rf"[{WS[1:-1]}/|—–:：-]+"
PART_SEPARATOR = rf"{WS}+[/|—–-]{WS}+"
LATIN_WORD = r"[A-Za-z][A-Za-z'’.]{2,}"
DISAMBIGUATION = rf"{WS}*[(（][^()（）]*(?:游戏|遊戲|电子游戏|版)[)）]{WS}*$"
KEPT_LATIN = r"(?i)^(?:[ivxlc]+|online|vr|hd|dlc|ex|dx)$"


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by decomposition of the Latin blocks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _accents()


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body names it, also inside its lambdas."""
    return F.transform(F.array(value), body)[0]


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def trim(c: Column) -> Column:
    """Trims every kind of white space, not only blanks."""
    return replace(c, rf"^{WS}+|{WS}+$")


def squeeze(c: Column) -> Column:
    return trim(replace(c, f"{WS}+", " "))


def unaccent(c: Column) -> Column:
    """Letters of the Latin blocks without their accents; combining accents are dropped."""
    return replace(F.translate(c, _ACCENTED, _BASE), r"[\x{0300}-\x{036F}]")


def normalize(title: Column) -> Column:
    """Title key for matching: lower case, without marks, brackets, platform and edition words or punctuation; Roman
    numerals from ii to xiii as digits. Null stays null; a title of noise alone gives ''."""
    s = replace(F.lower(title), "[®™©]", " ")
    s = replace(replace(s, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    s = replace(s, rf"{B}ps4{WS}*[&＆]{WS}*ps5{B}", " ")
    s = replace(s, rf"{B}(\d{{4}}){B}(?!{WS}*$)", " $1 ")
    s = replace(s, rf"{B}(?:{NOISE}){B}", " ")
    s = replace(s, r"[:\-–—_'’`.\"!?,+*/\\|]", " ")
    s = squeeze(replace(s, "&", " and "))
    roman = F.create_map(*[F.lit(str(x)) for kv in ROMAN.items() for x in kv])
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.coalesce(F.try_element_at(roman, w), w)), " ")


def sequel_numbers(key: Column) -> Column:
    """Sorted set of the one- and two-digit numbers of a title key."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(key, F.lit(rf"{B}(\d{{1,2}}){B}"), 1)))


def flat(key: Column) -> Column:
    """Key with accents folded and everything but a-z, 0-9 and blanks dropped."""
    return replace(unaccent(key), "[^a-z0-9 ]")


def identity_key(name: Column) -> Column:
    """Key under which a name is cached: letters and digits only, without accents."""
    return replace(replace(replace(F.lower(unaccent(name)), "[®™©]"), "&", "and"), "[^a-z0-9]")


def history_key(name: Column) -> Column:
    """Key of the play history: lower case, with runs of anything but letters, digits and Chinese as one blank."""
    return F.trim(replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9一-鿿]+", " "))


def edition_stripped(title: Column) -> Column:
    """Title up to an edition word (lower-case spelling only) and the blanks before it."""
    return replace(title, rf"{WS}*(?:{EDITION_TAIL}){B}.*$")


def dash_variant(title: Column) -> Column:
    """What stands before a dash between blanks."""
    return F.split(title, rf"{WS}+[-–—]{WS}+")[0]


def colon_variant(title: Column) -> Column:
    """What stands before a colon."""
    return F.split(title, ":")[0]


def variants(title: Column) -> Column:
    """array<struct<query, weight>>: the title's key at weight 1, then its dash and colon variants at 0.97 if new."""
    return let(normalize(title), lambda key: _variants(title, key))


def _variants(title: Column, key: Column) -> Column:
    others = F.filter(F.array_distinct(F.array(normalize(dash_variant(title)), normalize(colon_variant(title)))), lambda v: (v != "") & (v != key))
    one = F.filter(F.array(F.struct(key.alias("query"), F.lit(1.0).alias("weight"))), lambda v: v["query"] != "")
    return F.concat(one, F.transform(others, lambda v: F.struct(v.alias("query"), F.lit(0.97).alias("weight"))))


def query_blocks(key: Column) -> Column:
    """Blocking keys under which a title key asks: its first word, and its first two characters without blanks."""
    return let(flat(key), lambda f: F.array(F.concat(F.lit("w:"), F.split(f, " ")[0]), _start(f)))


def item_blocks(key: Column) -> Column:
    """Blocking keys under which a title key is found: every word, and its first two characters without blanks.

    A key asks an entry exactly if its first word is a word of the entry, or both begin with the same two characters.
    """
    return let(flat(key), lambda f: F.array_distinct(F.concat(F.transform(F.split(f, " "), lambda w: F.concat(F.lit("w:"), w)), F.array(_start(f)))))


def _start(f: Column) -> Column:
    return F.concat(F.lit("p:"), F.substring(F.replace(f, F.lit(" "), F.lit("")), 1, 2))


def console_title(title: Column) -> Column:
    """Title without the suffix for two console generations and without the hits label."""
    return trim(replace(replace(title, CONSOLE_PAIR), CONSOLE_HITS))


def handheld_title(title: Column) -> Column:
    """Title without marks and without the second console's edition suffix and what follows it."""
    s = replace(title, "[™®©]")
    return squeeze(replace(s, rf"(?i){HANDHELD_EDITION}{B}.*$"))


def is_extra(title: Column) -> Column:
    """Whether a title is a soundtrack, an art book or a wallpaper."""
    return replace(title, "[™®©]").rlike(rf"(?i){B}(?:{EXTRAS}){B}")


def cover_url(url: Column, form: str = COVER_FORM) -> Column:
    """Image address with its transformation steps replaced."""
    return replace(url, COVER_STEPS, f"/image/$1/{form}/")


def has_cjk(name: Column) -> Column:
    return F.coalesce(name.rlike(CJK), F.lit(False))


def is_mixed(name: Column) -> Column:
    """Whether a name keeps a Latin word of three or more letters that isn't a numeral or a word in common use."""
    words = F.regexp_extract_all(name, F.lit(f"({LATIN_WORD})"), 1)
    return F.exists(words, lambda w: ~replace(w, "['’.]").rlike(KEPT_LATIN))


def tidied(name: Column, simplified: tuple[str, str] = ("", "")) -> Column:
    """Localized name without marks and platform noise, full-width letters and digits made half-width.

    ``simplified`` maps characters of one Chinese orthography to the other; no map is shipped.
    """
    wide = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
    s = F.translate(name, *simplified) if simplified[0] else name
    s = trim(F.translate(replace(s, "[®™©]"), wide, "".join(chr(ord(c) - 0xFEE0) for c in wide)))
    for _ in range(2):
        for pattern in NAME_NOISE:
            s = trim(replace(s, pattern))
    return s


def unquoted(s: Column) -> Column:
    """A name without its first pair of title quotes, blanks made one, none before a closing sign."""
    # the first pair only: what stands before it holds no complete pair
    s = F.regexp_replace(s, rf"^((?:(?!《[^《》]+》).)*)《([^《》]+)》{WS}*", "$1$2 ")
    return trim(replace(replace(s, f"{WS}+", " "), rf"{WS}+([：:）)])", "$1"))


def tidy(name: Column, simplified: tuple[str, str] = ("", "")) -> Column:
    return unquoted(tidied(name, simplified))


def is_traditional(name: Column, simplified: tuple[str, str]) -> Column:
    """Whether a name changes under a map to the other Chinese orthography."""
    return F.coalesce(F.translate(name, *simplified) != name, F.lit(False))


def bracketed_chinese(name: Column) -> Column:
    """struct<bracket, inside, whole>: a bracket with Chinese in it, its content, and whether there is one."""
    bracket = F.regexp_extract(name, BRACKET, 0)
    return F.struct(bracket.alias("bracket"), F.regexp_extract(name, BRACKET, 1).alias("inside"), F.coalesce(bracket != "", F.lit(False)).alias("whole"))


def chinese_only(name: Column) -> Column:
    """A bracket's content if it holds all the Chinese of a name, else the name."""
    bracket = F.regexp_extract(name, BRACKET, 0)
    rest = F.replace(name, bracket, F.lit(""))
    return F.when((bracket != "") & ~has_cjk(rest), trim(F.regexp_extract(name, BRACKET, 1))).otherwise(name)


def marks_stripped(title: Column) -> Column:
    return trim(replace(F.coalesce(title, F.lit("")), "[®™©]"))


def cut_title(name: Column, plain: Column, at: Column) -> Column:
    """A name without a title that begins at a place, and without separators at its ends."""
    cut = F.concat(F.substr(name, F.lit(1), at - 1), F.lit(" "), F.substr(name, at + F.length(plain)))
    return squeeze(replace(cut, rf"^{EDGE}|{EDGE}$"))


def kept_rest(name: Column, plain: Column, at: Column, rest: Column) -> Column:
    """The rest of a name without a title, if it is a name and not only words for editions; else the name."""
    chinese = replace(rest, "[^一-鿿]")
    good = (F.length(plain) >= 2) & (at > 0) & (chinese != "") & ~chinese.rlike(f"^(?:{EDITION_NAMES})+$")
    return F.when(good, rest).otherwise(name)


def without_title(name: Column, title: Column) -> Column:
    """Name with the title's first occurrence cut, if what is left is a name and not only words for editions."""
    at = F.instr(F.lower(name), F.lower(marks_stripped(title)))
    return kept_rest(name, marks_stripped(title), at, cut_title(name, marks_stripped(title), at))


def chinese_part(name: Column, english: Column) -> Column:
    """First part with Chinese of a name in two languages, cut before the English title's last occurrence."""
    parts = F.filter(F.split(name, PART_SEPARATOR), has_cjk)
    s = trim(F.coalesce(F.try_element_at(parts, F.lit(1)), name))
    behind = F.instr(F.reverse(F.lower(s)), F.reverse(F.lower(english)))
    at = F.when(behind > 0, F.length(s) - behind - F.length(english) + 1).otherwise(-1)
    head = trim(F.substr(s, F.lit(1), at))
    s = F.when((at > 0) & has_cjk(F.substr(s, F.lit(1), at)), head).otherwise(s)
    return F.when(has_cjk(s), s)


def clean_name(name: Column, titles: list[Column]) -> Column:
    """Localized name made tidy, without the English titles, and reduced to its Chinese."""
    s = tidy(name)
    for t in titles:
        s = without_title(s, t)
    return tidy(chinese_only(s))


def article_title(html: Column) -> Column:
    """Title of an encyclopedia article as shown: no tags, no disambiguation in brackets at the end; null without Chinese."""
    s = trim(replace(strip_tags(html), DISAMBIGUATION))
    return F.when(has_cjk(s), s)


def strip_tags(html: Column) -> Column:
    return replace(html, "<[^>]+>")


def padded(c: Column, width: int, left: bool = False) -> Column:
    """Text filled up to a width and never cut."""
    n = F.greatest(F.length(c), F.lit(width))
    return F.lpad(c, n, F.lit(" ")) if left else F.rpad(c, n, F.lit(" "))


def year_of(date: Column) -> Column:
    """Year a date text starts with; null for none or 0."""
    return F.nullif(F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def fixed3(x: Column) -> Column:
    """x to three decimals."""
    return F.regexp_replace(F.format_number(x, 3), ",", "").cast("double")
