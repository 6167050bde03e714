"""What a listing's title says: the name, its number in a series, and what kind of item it is.

Words about platforms, editions, makers and advertising are set aside; amounts and durations are read whatever way they
are written (1.5K, 1,500, 1500x; 2 years, 24 mo.); a series number may be a digit, a Roman numeral or a word.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from caddis.llm.scripts import consistent_form

# Words that sellers add to a title. Adverts are listed for single titles only (matching entities); the
# grouping of listings learns them from the corpus.
PLATFORMS = (
    r"(?:for )?xbox series x ?[|/] ?s(?: (?:and|&) pc)?",
    r"(?:for )?xbox (?:one|360|series)",
    r"(?:for )?windows(?: \d+)?",
    r"(?:for )?(?:nintendo )?switch(?: 2)?(?: edition| version)?",
    r"(?:for )?(?:ps4|ps5|playstation ?[45])(?: ?(?:and|&|/) ?(?:ps4|ps5|playstation ?[45]))?(?: version)?",
    r"(?:for )?pc(?: version)?",
)
EDITIONS = (
    r"(?:digital )?deluxe(?: edition)?",
    r"(?:the )?game of the year(?: edition)?",
    r"goty(?: edition)?",
    r"(?:standard|ultimate|complete|definitive|gold|anniversary|enhanced|premium|digital|collectors|limited|special)(?: edition)",
    r"remastered|full game|game preview",
)
ADVERTS = (
    r"limited time offer",
    r"save \d+ ?%",
    r"\+ ?bonus content",
    r"(?:the )?award-winning",
    r"top[- ]rated ?:?",
    r"best-selling",
    r"new ?!",
    r"play it today ?!?",
    r"now in 4k",
    r"pre-?order bonus",
    r"(?:buy|play) now ?!?",
)
#: Last words of makers' names, for titles without a table of makers; the grouping of listings learns its own.
MAKERS = ("collective", "interactive", "digital", "entertainment", "games", "studio", "studios", "works", "forge", "lab", "team", "arts")
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13}

_NOISE = re.compile(r"(?<![a-z0-9])(?:" + "|".join([*PLATFORMS, *EDITIONS]) + r")(?![a-z0-9])")
_ADS = re.compile(r"(?<![a-z0-9])(?:" + "|".join(a for a in ADVERTS if not a.startswith(r"\+")) + r")(?![a-z0-9])|\+ ?bonus content")
_CALL = re.compile(r"(?<![a-z0-9])(?:new|now) ?!")  # a cry is no part of a name
_TRACK = re.compile(r"(?<![a-z])(?:(?:the )?original soundtrack|soundtrack|o\.?s\.?t\.?)(?![a-z])")
_MEMBER = re.compile(r"(?<![a-z])(?:season )?(?:membership|pass)(?![a-z])")
_SPAN = re.compile(r"(?<![a-z0-9.])(\d+|one|two|three|four|five|six)[ -]*(months?|mos?|years?|yrs?)(?![a-z])\.?")
_AMOUNT = re.compile(r"(?<![a-z0-9.,])(?:pack of )?(\d[\d,.]*?)( ?k)?(?: ?x)? (credits?|coins?|gems?|shards?|tokens?|points?|crystals?)(?![a-z])(?: (?:bundle|pack))?")
_SERIES = re.compile(r"(?<![a-z0-9])(?:(?:part|vol\.?|volume|chapter|episode|no\.?|#) |(?:vol\.?|part|#)(?=\d))?#?(\d{1,2}|" + "|".join(sorted([*NUMBER_WORDS, *ROMAN], key=len, reverse=True)) + r")(?![a-z0-9'])")
_CUT = re.compile(r"[:|()\[\]{}–—;~★☆]+|(?<=\s)-+(?=\s)|\s-+\s|^-+\s|\s-+$|[!?]+(?=\s|$)|\+")
_FIRST = re.compile(r"^([a-z]{2,4})\s+(?=\S)")
_GLUED = re.compile(r"^the(?=[a-z]{4,12}of[a-z]{4})")
_LOCAL_EDITION = re.compile(r"\s*[(（][^()（）]*版[)）]|\s+[^\s《》]*(?: one)?\s*版(?=\W*$)")
_QUOTES = str.maketrans({"’": "'", "‘": "'", "`": "'", "´": "'"})
# Words that noise leaves behind when a slip hides it, used to tell such remains.
_EDITION_WORDS = ("edition", "deluxe", "standard", "ultimate", "complete", "definitive", "anniversary", "digital", "version", "membership", "soundtrack", "original", "nintendo", "playstation", "windows", "switch", "preview", "season", "bonus", "content", "presents", "limited", "credits", "shards")


def fold(text: str) -> str:
    """Lower case in one consistent form, without accents, marks of ownership and decoration."""
    s = consistent_form(text).translate(_QUOTES)
    s = re.sub("[®™©★☆]", " ", s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", s.replace("&", " and ")).strip()


@dataclass(frozen=True)
class Title:
    """Segments of the name (letters and digits only, without a leading article), number and kind of item."""

    segments: tuple[str, ...]
    words: str
    number: int
    kind: str
    amount: int
    subtitle: str = ""  # of a numbered game; sellers may leave it out

    @property
    def core(self) -> str:
        return " ".join(self.segments)

    @property
    def numeric(self) -> str:
        """What must agree between two listings of one item: kind, amount, number, and numbers inside the name."""
        inside = re.findall(r"\d+", " ".join(self.segments))
        return "|".join(map(str, [self.kind, self.amount, self.number, *inside]))


def slipped(a: str, b: str) -> bool:
    """Whether a becomes b by one letter put in, left out, replaced or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@lru_cache(maxsize=200_000)
def _mended(word: str) -> str:
    """A seller's word with one slip in it, put right; any other word unchanged."""
    if len(word) >= 5 and word not in _EDITION_WORDS:
        for known in _EDITION_WORDS:
            if slipped(word, known):
                return known
    return word


def _plain(part: str) -> str:
    """A part of a title without a leading article, also one with a letter left out, doubled or swapped."""
    m = _FIRST.match(part)
    if m and (m[1] == "for" or (slipped(m[1], "the") and (len(m[1]) != 3 or sorted(m[1]) == sorted("the")) and (len(m[1]) < 4 or set(m[1]) == set("the")))):
        return part[m.end() :]
    return part


@lru_cache(maxsize=16)
def _maker(words: tuple[str, ...]) -> re.Pattern:
    """A maker's name where a title sets it apart: before "presents" or a colon, after "by", in brackets."""
    name = rf"[a-z]+ (?:{'|'.join(map(re.escape, words))})" if words else r"(?!)"
    return re.compile(rf"^\W*{name} presents\b|\bby {name}(?=\W*$)|^\W*{name} ?:|[(\[]{name}[)\]]")


_WORD = re.compile(r"[^\W_]+")
#: Words of the longest phrase that sellers add, and of the shortest that is learned: single words can be names.
PHRASE_WORDS = (5, 2)


def _without_noise(text: str) -> list[str]:
    return [p for p in _CUT.split(_NOISE.sub(" | ", fold(text))) if _WORD.search(p)]


def spans(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(all words run together, [(phrase, the other words run together)]): phrases of up to PHRASE_WORDS words that begin or
    end a part of the title, platform and edition words aside. What a title would be without each of them."""
    parts = [_WORD.findall(p) for p in _without_noise(text)]
    out = {}
    for i, words in enumerate(parts):
        for n in range(PHRASE_WORDS[1], min(PHRASE_WORDS[0], len(words)) + 1):
            for a in {0, len(words) - n}:
                rest = "".join(w for j, p in enumerate(parts) for w in (p if j != i else p[:a] + p[a + n :]))
                if rest:
                    out[" ".join(words[a : a + n]), rest] = None
    return "".join(w for p in parts for w in p), list(out)


def _trimmed(part: str, learned: frozenset[str]) -> str:
    """A part without the learned phrases it begins or ends with."""
    again = True
    while again:
        again = False
        words = list(_WORD.finditer(part))
        for n in range(min(PHRASE_WORDS[0], len(words)), PHRASE_WORDS[1] - 1, -1):
            if " ".join(w.group() for w in words[:n]) in learned:
                part, again = part[words[n - 1].end() :], True
                break
            if " ".join(w.group() for w in words[-n:]) in learned:
                part, again = part[: words[-n].start()], True
                break
    return part


def _number(text: str) -> int | None:
    return int(text) if text.isdigit() else NUMBER_WORDS.get(text) or ROMAN.get(text)


@lru_cache(maxsize=100_000)
def parse_title(text: str, learned: frozenset[str] = frozenset(), adverts: bool = True, makers: tuple[str, ...] = MAKERS) -> Title:
    """The parts of a title. A title made of nothing but seller's words keeps them as its name.

    ``learned`` are seller's phrases found in the corpus; ``adverts`` says whether the listed ones are set aside, too;
    ``makers`` are the last words of makers' names.
    """
    s = re.sub(r"[a-z]+", lambda m: _mended(m.group()), fold(text))
    whole = s
    maker = _maker(makers)
    s = maker.sub(" ", (_ADS if adverts else _CALL).sub(" ", s))
    kind, amount = "game", 0
    if m := _AMOUNT.search(s):
        digits = m.group(1).rstrip(".,")
        value = float(digits.replace(",", "")) * 1000 if m.group(2) else float(re.sub(r"[.,](?=\d{3}(?!\d))", "", digits).replace(",", ".") or 0)
        kind, amount = m.group(3).rstrip("s"), round(value)
        s = s[: m.start()] + " | " + re.sub(r"^ ?for\b", " ", s[m.end() :])
    elif m := _MEMBER.search(s):
        kind = "member"
        s = s[: m.start()] + " | " + re.sub(r"^ ?for\b", " ", s[m.end() :])
        if m := _SPAN.search(s):
            amount = (_number(m.group(1)) or 0) * (12 if m.group(2)[0] == "y" else 1)
            s = s[: m.start()] + " | " + s[m.end() :]
    elif _TRACK.search(s):
        kind = "music"
        s = _TRACK.sub(" | ", s)
    s = maker.sub(" ", _NOISE.sub(" | ", s))
    number, base = 1, None
    parts = _CUT.split(s)
    if learned:
        parts = [_trimmed(p, learned) for p in parts]
    parts = [p.strip(" -,.!'\"") for p in parts]
    parts = [p for p in parts if re.search(r"[^\W_]", p) and p not in ("edition", "version", "pack", "bundle", "for", "the", "and")]
    for i, p in enumerate(parts):
        found = [m for m in _SERIES.finditer(p) if m.start() > 0 and _number(m.group(1))]
        if found:
            m = found[-1]
            number, base = _number(m.group(1)), p[: m.start()]
            parts[i] = f"{base} {p[m.end():]}".strip()
            break
        if len(parts) > 1 and (m := _SERIES.fullmatch(p)) and i:
            number, base = _number(m.group(1)), parts[i - 1]
            parts = parts[:i] + parts[i + 1 :]
            break
    joined = lambda p: _GLUED.sub("", re.sub(r"[\W_]+", "", _plain(p.strip())))
    subtitle = ""
    if number > 1 and base and re.search(r"[^\W_]", base):
        # the number names the game of its series; a subtitle behind it may be left out
        base = base.strip()
        at = next(i for i, p in enumerate(parts) if p.startswith(base))
        rest = [parts[at][len(base) :], *parts[:at], *parts[at + 1 :]]
        subtitle = "".join(joined(p) for p in rest)
        parts = [base]
    segments = tuple(n for n in map(joined, parts) if n) or (re.sub(r"[\W_]+", "", whole),)
    return Title(segments, " ".join(re.findall(r"[^\W_]+", " ".join(parts))), number, kind, amount, subtitle)


@lru_cache(maxsize=100_000)
def localized_name(text: str | None) -> str | None:
    """A localized title's name and number in one consistent form, without quotes, platform and edition (… 版)."""
    read = parse_title(_LOCAL_EDITION.sub("", fold(text))) if text and text.strip() else None
    return f"{read.core}|{read.numeric}" if read and read.core else None
