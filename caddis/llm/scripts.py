"""Visually identical text in one consistent form.

Blank and invisible characters, compatibility forms and composition are made one. Then each token's resolved script set
is taken: the intersection, over its letters, of the scripts that have a letter of that look. A token that resolves is
spelled in the first of its scripts in a fixed order (a mixed token as well as a whole-script confusable); a token that
doesn't is split at Han and kana, or spelled letter by letter. Katakana and the Han characters that look like them are
told apart by the other signs of their run. Every choice depends only on how letters look, so texts that look the same come
out the same. Case, accents and signs are kept.

Which letters look alike is the public confusables data of Unicode as the ICU library in Spark's JVM has it (``icu``);
without a JVM, a short list of common look-alikes.
"""

from __future__ import annotations

import unicodedata
from functools import cache, lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caddis.session import cut

# Common letters of other scripts that look like a Latin letter, by script.
COMMON = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝгпҽ", "ABESIJKMHOPCTYXYQWaesijopcyxhdqwrne"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳανρυι", "ABEZHIKMNOPTYXocjavpui"),
    "Armenian": ("ՍՏՕօոսհց", "USOonuhg"),
    "Cherokee": ("ᎪᎡᎢᎬᎳᎷᎻᏀᏃᏏᏔᏞᏟᏢᏦᎠᏴᏙ", "ARTEWMHGZbWLCPKDBV"),
}
# Katakana that look like a Han character.
KANA_HAN = ("エタハロカニトオチムー", "工夕八口力二卜才千厶一")
#: Scripts whose letters are respelled, in order of preference.
ALPHABETS = ("Latin", "Cyrillic", "Greek", "Coptic", "Armenian", "Cherokee", "Lisu")

_TO_HAN, _TO_KANA = dict(zip(*KANA_HAN)), dict(zip(*reversed(KANA_HAN)))
_SCRIPTS = (*ALPHABETS, "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Hebrew", "Arabic", "Thai", "Devanagari")
_SCRIPT_OF = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in _SCRIPTS]
_EITHER = f"[{''.join(KANA_HAN)}]"
# Katakana and the Han characters that look like one; katakana with no Han look-alike (those with a voicing mark, too).
_RUN = regex.compile(rf"(?:{_EITHER}|\p{{Script=Katakana}})+")
_KATAKANA = regex.compile(rf"(?!{_EITHER})\p{{Script=Katakana}}")
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
_BLANK = regex.compile(r"[\s\p{Z}\p{Cc}⠀]+")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
# Blocks whose compatibility forms look like what they stand for: ligatures, full and half width, numerals, radicals,
# compatibility ideographs, mathematical letters. Superscripts, trade marks and the like look different and stay.
_FOLDED = regex.compile("[ﬀ-ﬆ！-￯Ⅰ-ⅿ⼀-⿟⺀-⻿豈-﫿\U0002f800-\U0002fa1f\U0001d400-\U0001d7ff․-…‐‑℀-ℓĲĳŁǄ-ǌǱ-ǳ]")
_KEPT = frozenset("℀℁℅℆℉℃")
# Signs that look the same: the minus sign and the hyphen, the modifier apostrophe and the closing quote. Dashes of other
# lengths, straight quotes and primes look different and stay.
_SIGNS = str.maketrans("−ʼ", "-’")
ALL = frozenset({"*"})
_JAPANESE, _HANB, _KOREAN = "Jpan", "Hanb", "Kore"


def _fold(m) -> str:
    c = m.group()
    if c in "‐‑":
        return "-"
    return c if c in _KEPT else unicodedata.normalize("NFKC", c)


@cache
def script_set(ch: str) -> frozenset[str]:
    """Augmented script set of a character; ALL for common and inherited ones."""
    own = next((s for s, p in _SCRIPT_OF if p.match(ch)), None)
    if own is None:
        return ALL if unicodedata.category(ch)[0] != "L" or ch == "ー" else frozenset({f"other:{ord(ch) >> 7}"})
    extra = {"Han": {_JAPANESE, _HANB, _KOREAN}, "Hiragana": {_JAPANESE}, "Katakana": {_JAPANESE}, "Hangul": {_KOREAN}, "Bopomofo": {_HANB}}
    return frozenset({own} | extra.get(own, set()))


def _case(ch: str) -> str:
    return "l" if unicodedata.category(ch) == "Ll" else "u"


class Lookalikes:
    """Letters by their look: ``skeletons`` maps a letter to a text that it shares with all letters of its look."""

    def __init__(self, skeletons: dict[str, str]):
        self.look: dict[str, tuple[str, str]] = {}
        self.letter: dict[str, dict[tuple[str, str], str]] = {s: {} for s in ALPHABETS}
        for ch in sorted(skeletons, key=lambda c: (not c.isascii(), c)):  # ASCII letters stand for their look
            script = next(iter(script_set(ch) & set(ALPHABETS)), None)
            if script and len(skeletons[ch]) == 1:
                look = self.look[ch] = (skeletons[ch], _case(ch))
                if script != "Latin" or ch.isascii():  # no word is respelled in small capitals and the like
                    self.letter[script].setdefault(look, ch)

    def scripts(self, ch: str) -> frozenset[str]:
        """Scripts that have a letter of this look; ALL for common and inherited characters."""
        own = script_set(ch)
        if own is ALL or ch not in self.look:
            return own
        return own | {s for s in ALPHABETS if self.look[ch] in self.letter[s]}

    def resolved(self, token: str) -> frozenset[str]:
        """Intersection of the scripts of a token's characters: empty for a mixed-script token, ALL for a common one."""
        out = ALL
        for ch in token:
            own = self.scripts(ch)
            if own is not ALL:
                out = own if out is ALL else out & own
        return out

    def _in(self, script: str, ch: str) -> str:
        return self.letter[script].get(self.look.get(ch), ch)

    def spell(self, token: str) -> str:
        """A token (decomposed) in a consistent script."""
        resolved = self.resolved(token)
        if resolved is ALL:
            return token
        target = next((s for s in ALPHABETS if s in resolved), None)
        if target:
            return "".join(self._in(target, c) for c in token)
        if resolved:
            return token
        parts = regex.findall(r"[\p{Script=Han}\p{Script=Katakana}\p{Script=Hiragana}ー]+|[^\p{Script=Han}\p{Script=Katakana}\p{Script=Hiragana}ー]+", token)
        if len(parts) > 1:  # letters beside Han characters or kana, which need no blank between them
            return "".join(map(self.spell, parts))
        return "".join(self._in(next((s for s in ALPHABETS if s in self.scripts(c)), "Latin"), c) for c in token)


def _common() -> Lookalikes:
    latin = {chr(c): chr(c) for c in [*range(65, 91), *range(97, 123)]}
    return Lookalikes(latin | {a: b for other, own in COMMON.values() for a, b in zip(other, own)})


def icu(spark: SparkSession) -> Lookalikes:
    """The look-alikes of Unicode's confusables data, asked of the JVM's ICU library in one call,
    and the common ones.

    Letters whose look is more than one character, and pairs that a reader can tell apart by their case, are left out.
    """
    checker = getattr(spark._jvm.com.ibm.icu.text.SpoofChecker, "Builder")().build()
    alphabets = regex.compile("[" + "".join(rf"\p{{Script={s}}}" for s in ALPHABETS) + "]")
    # letters that are composed or stand for others are taken apart before letters are compared
    letters = [c for c in map(chr, range(0x41, 0x10000)) if alphabets.match(c) and unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c)]
    skeletons = dict(zip(letters, checker.getSkeleton(0, "\n".join(letters)).split("\n")))
    return Lookalikes(skeletons | {a: skeletons[b] for other, latin in COMMON.values() for a, b in zip(other, latin)})


COMMON_LOOKS = _common()


def _kana_or_han(m) -> str:
    """A run of katakana and their look-alikes: katakana if any of it can be nothing else, else Han."""
    to = _TO_KANA if _KATAKANA.search(m.group()) else _TO_HAN
    return "".join(to.get(c, c) for c in m.group())


@lru_cache(maxsize=50_000)
def consistent_form(text: str, looks: Lookalikes = COMMON_LOOKS) -> str:
    """The consistent form of a text; two texts that look the same have equal forms. Blank texts give ''."""
    s = _INVISIBLE.sub("", text)
    s = unicodedata.normalize("NFC", _FOLDED.sub(_fold, s)).translate(_SIGNS)
    s = _BLANK.sub(" ", s).strip(" ")
    if s.isascii():
        return s
    s = _RUN.sub(_kana_or_han, s)
    s = _TOKEN.sub(lambda m: looks.spell(m.group()), unicodedata.normalize("NFD", s))
    return unicodedata.normalize("NFC", s)


def with_consistent_form(df: DataFrame, column: str, name: str = "consistent") -> DataFrame:
    """df with the consistent form of a text column; null for null, '' for a text of blanks and invisible characters.

    Plain texts (printable ASCII, single blanks) are their own form and never leave the JVM; the rest goes through one
    Arrow-batched function. Texts of any length are processed whole.
    """

    looks = icu(df.sparkSession)

    @F.pandas_udf("string")
    def form(texts):
        return texts.map(lambda t: consistent_form(t, looks), na_action="ignore")

    plain = F.col(column).rlike(r"\A[!-~]+( [!-~]+)*\z")
    return df.withColumn(name, F.coalesce(form(F.when(~plain, F.col(column))), F.col(column)))


def lookalike_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b by code point: keys whose texts look the same but are not equal as strings.

    Repeated rows count once; null and blank texts and null keys are in no pair. Texts with one spelling drop out before
    the join, so copies of one text, however many, meet only other spellings. A key with several texts is paired if
    any of them qualifies. An empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("string").alias("_id"), F.col(column).alias("_t")).where("_id IS NOT NULL AND _t IS NOT NULL").distinct()
    rows = cut(rows)
    texts = cut(with_consistent_form(rows.select("_t").distinct(), "_t", "_c").where("_c <> ''"))
    several = texts.groupBy("_c").agg(F.count("*").alias("_n")).where("_n > 1").select("_c")
    spelled = texts.join(several, "_c")
    meet = spelled.alias("a").join(spelled.alias("b"), "_c").where("a._t <> b._t").select(F.col("a._t").alias("_t"), F.col("b._t").alias("_u"))
    left = rows.join(meet, "_t").select(F.col("_id").alias("id_a"), F.col("_u").alias("_t"))
    return left.join(rows, "_t").where("id_a < _id").select("id_a", F.col("_id").alias("id_b")).distinct()
