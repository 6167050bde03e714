"""Repetition inside a single document, by sequence labelling.

A document is a sequence of lines: clauses, sentences, or at most ``LINE_UNITS`` units of a text without punctuation. A
linear-chain conditional random field labels each line as content or as boilerplate, that is repetition of what the
document said before (Viterbi decoding), from how many of its single units, pairs, triples and longer runs stood before,
its length, case, digits, closing sign and place, and its neighbours. The share of a document's units in lines labelled
content decides whether it is kept; nothing else does.

The field is fitted to a bounded sample of the documents themselves. Half of them get repetition planted in them
(sentences, blocks, phrases in a loop, near-repeats with a word changed), whose labels are known; the lines of the
other half are labelled by whether most of their units lie in a passage of WORDS words or CHARACTERS characters that
stood before. Such passages are no feature, so what the field learns holds for near-repeats as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caddis.session import filled

#: Units of the shortest passage that labels a sampled line as standing earlier: words, and characters of scripts
#: without blanks; units after which a line without punctuation ends.
WORDS, CHARACTERS, LINE_UNITS = 5, 9, 12
#: Characters of text handled at once; texts are never cut.
BATCH_CHARS = 4_000_000
#: Documents of the sample that fits the field, the longest of them in characters, and the seed of what is planted.
SAMPLE, SAMPLE_CHARS, SEED = 400, 6_000, 20240501
#: Lines of a sampled document that the fit sees as one sequence.
PIECE = 64
#: Lengths of runs looked for among the earlier units, and steps of the share of a line inside such runs.
RUNS, STEPS = (1, 2, 3, 4, 6), (0.001, 0.3, 0.6, 0.85, 0.999)

_CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ\U00020000-\U0003ffff"
# A line number or bullet that opens a line, the end of a line, or a unit.
_PARTS = rf"(?:^|(?<=[\r\n]))[^\S\r\n]*(?:[(\[]?\d{{1,4}}[.):\]、]|[-*•#>+]+)(?=\s)|[.!?。！？…;；,，、:：\r\n]+|[{_CJK}]|[^\W_{_CJK}]+"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return (x ^ (x >> np.uint64(29))) * _M1


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each hash stood earlier in the array. Hashes and places are sorted as one number, which is fast."""
    bits = np.uint64(max(1, len(keys)).bit_length())
    packed = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


class _Tokens(dict):
    """Token -> its number; the number of what it folds to, and its traits, are found once per distinct token."""

    MARK, END, BREAK, CJK, WORD = range(5)

    def __init__(self):
        super().__init__()
        import regex

        self.cjk = regex.compile(f"[{_CJK}]")
        self.kind, self.unit, self.digit, self.upper, self.folded = [], [], [], [], {}

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self.kind)
        if self.cjk.match(token):
            kind = self.CJK
        elif token[0].isalnum() and token[-1].isalnum():
            kind = self.WORD
        elif token[0] in ".!?。！？…;；,，、:：\r\n":
            kind = self.BREAK if "\n" in token or "\r" in token else self.END
        elif any(c.isdigit() for c in token) or not any(c.isalnum() for c in token):
            kind = self.MARK
        else:
            kind = self.WORD
        self.kind.append(kind)
        self.unit.append(self.folded.setdefault(token.casefold(), len(self.folded)))
        self.digit.append(token.isdigit())
        self.upper.append(token.isupper())
        return number


@dataclass
class Lines:
    """Lines of a batch of documents, in order."""

    doc: np.ndarray  # of each line
    units: np.ndarray  # in each line
    features: np.ndarray  # line x feature
    covered: np.ndarray  # units of each line inside passages that stood earlier; labels the sample, is no feature


def _inside(code: np.ndarray, of: np.ndarray, salt: np.ndarray, length: int, allowed=None) -> np.ndarray:
    """Whether each unit lies in a run of so many units of its document that stood earlier there."""
    n, m = len(code), len(code) - length + 1
    if m <= 0:
        return np.zeros(n, bool)
    key = np.zeros(m, np.uint64)
    for k in range(length):
        key = key * _M1 + code[k : k + m]
    starts = np.flatnonzero(of[:m] == of[length - 1 :])
    if allowed is not None:
        starts = starts[allowed(starts)]
    starts = starts[_again((_mix(key) ^ salt[:m])[starts])]
    hits = np.zeros(n + length + 1, np.int64)
    hits[starts] += 1  # starts are distinct
    hits[starts + length] -= 1
    return np.cumsum(hits[:n]) > 0


def lines(texts: list[str]) -> Lines:
    """Lines of texts. Case, punctuation, blanks, and numbers or bullets that open a line are no part of them."""
    import regex

    find, tokens = regex.compile(_PARTS).findall, _Tokens()
    number, counts = [], []
    for text in texts:
        found = find(text)
        counts.append(len(found))
        number.extend(map(tokens.__getitem__, found))
    number = np.array(number, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    kind = np.array(tokens.kind, np.int64)[number] if len(number) else number
    is_unit = kind >= tokens.CJK
    n = int(is_unit.sum())
    width = 2 * len(RUNS) * (len(STEPS) + 1) + 10
    if not n:
        return Lines(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width)), np.zeros(0))
    # breaks between a unit and the one before it: another document, or an end between them
    ends = np.cumsum((kind == tokens.END) | (kind == tokens.BREAK))[is_unit]
    breaks = np.cumsum(kind == tokens.BREAK)[is_unit]
    number, of = number[is_unit], doc[is_unit]
    fresh = np.concatenate(([True], (of[1:] != of[:-1]) | (ends[1:] != ends[:-1])))
    first = np.flatnonzero(fresh)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    fresh |= place % LINE_UNITS == 0
    first = np.flatnonzero(fresh)
    units = np.diff(np.append(first, n))
    code = _mix(np.array(tokens.unit, np.uint64)[number] + np.uint64(1))
    salt = _mix(of.astype(np.uint64) + np.uint64(77))
    wide = np.array(tokens.kind)[number] == tokens.CJK
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), first)
    shares = {length: total(_inside(code, of, salt, length)) / units for length in RUNS}
    cjk = np.concatenate(([0], np.cumsum(wide)))
    few = lambda s: (cjk[s + WORDS] - cjk[s]) <= 1  # noqa: E731  a short passage counts only where it is made of words
    covered = total(_inside(code, of, salt, WORDS, few) | _inside(code, of, salt, CHARACTERS))
    line_doc = of[first]
    start = np.concatenate(([True], line_doc[1:] != line_doc[:-1]))
    last = np.append(first[1:], n) - 1
    closes = np.append(breaks[1:] != breaks[:-1], True)[last]
    at = np.arange(len(first)) - np.repeat(np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), len(first))))
    chinese = total(wide) * 2 > units
    traits = [np.ones(len(first), bool), units <= 2, (units > 2) & (units <= 4), units >= LINE_UNITS, closes, total(np.array(tokens.digit)[number]) > 0, total(np.array(tokens.upper)[number]) * 2 > units, start, at < 3, chinese]
    for length in RUNS:
        step = np.digitize(shares[length], STEPS)
        for script in (~chinese, chinese):
            traits += [(step == k) & script for k in range(len(STEPS) + 1)]
    return Lines(line_doc, units, np.column_stack(traits).astype(np.float32), covered)


@dataclass(frozen=True)
class Labeller:
    """A linear-chain conditional random field with the labels 0, content, and 1, repetition."""

    weights: np.ndarray  # feature x label
    transitions: np.ndarray  # label x label

    def decode(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Most probable labels of sequences laid one after another; ``starts`` marks where each begins."""
        scores = (features @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.transitions.tolist()
        back, a, b = [], 0.0, 0.0
        begins = starts.tolist()
        for (s0, s1), begin in zip(scores, begins):
            if begin:
                back.append((a >= b, a >= b, True))
                a, b = s0, s1
                continue
            f0, f1 = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((f0, f1, False))
            a, b = (a + t00 if f0 else b + t10) + s0, (a + t01 if f1 else b + t11) + s1
        out = np.zeros(len(scores), bool)
        label = not a >= b
        for i in range(len(scores) - 1, -1, -1):
            out[i] = label
            f0, f1, _ = back[i]
            label = not (f1 if label else f0)
        return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], penalty: float = 0.5, steps: int = 80, rate: float = 0.6) -> Labeller:
    """Labeller with the greatest penalised likelihood of (features, labels) sequences, by accelerated gradient ascent.

    Sequences are cut into pieces of at most PIECE lines and laid side by side, padded to the longest, so that each step
    of the forward and backward sums is one array operation.
    """
    pieces = [(f[i : i + PIECE], y[i : i + PIECE]) for f, y in sequences for i in range(0, len(y), PIECE)]
    longest, n = max(len(y) for _, y in pieces), len(pieces)
    y, on = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (_, label) in enumerate(pieces):
        y[i, : len(label)], on[i, : len(label)] = label, True
    x = np.concatenate([f for f, _ in pieces])  # in the order of on's places
    total = on.sum()
    w, t = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    vw, vt = np.zeros_like(w), np.zeros_like(t)
    truth = np.eye(2)[y] * on[..., None]
    pair = on[:, 1:] & on[:, :-1]
    seen_t = np.einsum("nla,nlb->ab", truth[:, :-1] * pair[..., None], truth[:, 1:])
    for _ in range(steps):
        lw, lt = w + 0.9 * vw, t + 0.9 * vt
        s = np.zeros((n, longest, 2))
        s[on] = x @ lw
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for i in range(1, longest):
            step = np.logaddexp(forward[:, i - 1, :1] + lt[0], forward[:, i - 1, 1:] + lt[1]) + s[:, i]
            forward[:, i] = np.where(on[:, i, None], step, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            ahead = s[:, i + 1] + backward[:, i + 1]
            step = np.logaddexp(lt[:, 0] + ahead[:, :1], lt[:, 1] + ahead[:, 1:])
            backward[:, i] = np.where(on[:, i + 1, None], step, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None, None]
        expected = np.exp(forward + backward - z)
        joint = np.exp(forward[:, :-1, :, None] + lt + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - z[..., None]) * pair[..., None, None]
        vw = 0.9 * vw + rate * (x.T @ (truth - expected)[on] - penalty * lw) / total * 8
        vt = 0.9 * vt + rate * ((seen_t - joint.sum((0, 1))) - penalty * lt) / total * 8
        w, t = w + vw, t + vt
    return Labeller(w, t)


_SENTENCE_END = r"(?<=[.!?。！？…;；\n])\s*"


def _said_again(text: str, rng: np.random.Generator) -> list[tuple[str, int]]:
    """A document as (sentence, label) with repetition planted in it: label 1 where a sentence was said before."""
    import regex

    said = [(s, 0) for s in regex.split(_SENTENCE_END, text) if s.strip()]
    if not said:
        return []
    own = [s for s, _ in said]
    kind = int(rng.integers(0, 5))
    if kind == 0:  # a block again, once or more
        n = int(rng.integers(1, len(own) + 1))
        said += [(s, 1) for _ in range(int(rng.integers(1, 4))) for s in own[:n]]
    elif kind == 1:  # a sentence again and again between the others, in other case
        line = own[int(rng.integers(len(own)))]
        for i in range(int(rng.integers(1, 8))):
            said.append((line.upper() if i % 2 else line, 1))
    elif kind == 2:  # a phrase in a loop
        words = own[0].split() if " " in own[0] else list(own[0])
        a = int(rng.integers(0, max(1, len(words) - 2)))
        phrase = words[a : a + int(rng.integers(1, 5))]
        glue = " " if " " in own[0] else ""
        said.append((glue.join(phrase * int(rng.integers(12, 40))), 1))
    elif kind == 3:  # near-repeats: sentences with one word changed
        for s in own:
            words = s.split()
            if len(words) > 6:
                words[int(rng.integers(len(words)))] = f"w{rng.integers(1000)}"
                said.append((" ".join(words), 1))
    return said


def _examples(texts: list[str], seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of documents: every other one with repetition planted, the rest labelled by their passages."""
    rng = np.random.default_rng(seed)
    out = []
    plain = lines(texts[::2])
    marks = (plain.covered * 2 > plain.units).astype(int)
    cuts = np.searchsorted(plain.doc, np.arange(len(texts[::2]) + 1))
    out += [(plain.features[a:b], marks[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
    said = [s for s in (_said_again(t, rng) for t in texts[1::2]) if s]
    whole = lines(["\n".join(s for s, _ in doc) for doc in said])
    # the same lines, each sentence by itself, tell which sentence a line is of
    sentences = [s for doc in said for s, _ in doc]
    own = np.bincount(lines(sentences).doc, minlength=len(sentences))
    cuts, at = np.searchsorted(whole.doc, np.arange(len(said) + 1)), 0
    for doc, a, b in zip(said, cuts, cuts[1:]):
        labels = np.repeat([y for _, y in doc], own[at : at + len(doc)])
        at += len(doc)
        if len(labels) == b - a > 0:
            # what the document itself said again before anything was planted is repetition, too
            out.append((whole.features[a:b], np.maximum(labels, (whole.covered[a:b] * 2 > whole.units[a:b]).astype(int))))
    return out


def _invented(documents: int = 120, seed: int = SEED) -> list[str]:
    """Texts of invented words, which fit the field where a table has too few documents of its own."""
    rng = np.random.default_rng(seed)
    syllables = ["ba", "do", "ki", "mur", "len", "sa", "tov", "ri", "pel", "ghu", "nes", "fi"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(900)]
    signs = [chr(c) for c in rng.integers(0x4E00, 0x9000, 700)]
    sentence = lambda i: "".join(rng.choice(signs, rng.integers(6, 24))) + "。" if i % 4 == 3 else " ".join(rng.choice(words, rng.integers(4, 16))) + ". "
    return ["".join(sentence(i) for _ in range(rng.integers(2, 14))) for i in range(documents)]


def fitted(texts: list[str], seed: int = SEED) -> Labeller:
    """The field fitted to a sample of documents and to invented ones."""
    return fit(_examples(sorted(texts), seed) + _examples(_invented(), seed + 1))


def sample_labeller(df: DataFrame, key: str = "doc_id", text: str = "text", documents: int = SAMPLE) -> Labeller:
    """The field fitted to the ``documents`` of the table, of at most SAMPLE_CHARS characters, with the least hashes."""
    some = df.select(F.col(key).cast("string").alias("_k"), F.col(text).cast("string").alias("_t")).where((F.length("_t") > 0) & (F.length("_t") <= SAMPLE_CHARS))
    rows = some.orderBy(F.xxhash64("_k", F.length("_t")), "_k", "_t").limit(documents).select("_t").collect()
    return fitted([r[0] for r in rows])


def repetition(texts: list[str], labeller: Labeller) -> tuple[np.ndarray, np.ndarray]:
    """(units, units in lines labelled repetition) of each text."""
    found, n = lines(texts), len(texts)
    if not len(found.doc):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    label = labeller.decode(found.features, np.concatenate(([True], found.doc[1:] != found.doc[:-1])))
    return np.bincount(found.doc, found.units, n).astype(np.int64), np.bincount(found.doc, found.units * label, n).astype(np.int64)


def repeated_share(df: DataFrame, key: str = "doc_id", text: str = "text", labeller: Labeller | None = None) -> DataFrame:
    """(key, units, repeated, share): words of each text (characters in scripts without blanks), and those in lines that
    are labelled repetition; 1 - share is the content share.

    A null text has null counts and share; a text without words has 0 units and a share of 0. Each row gives one row;
    keys may repeat; other columns are ignored; an empty table gives no rows. Whole texts are read, whatever their
    length. Documents are labelled where they are read, without a
    shuffle unless there are fewer partitions than cores. Without a ``labeller`` one is fitted to a
    sample of the table first, which reads it once more.
    """
    shared = df.sparkSession.sparkContext.broadcast(labeller or sample_labeller(df, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                base = lengths[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(lengths, base + BATCH_CHARS, side="right")))
                part = batch.slice(at, to - at)
                at = to
                texts = part.column(1).to_pylist()
                units, repeated = repetition([t or "" for t in texts], shared.value)
                none = np.array([t is None for t in texts], bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(units, mask=none), pa.array(repeated, mask=none)], ["id", "units", "repeated"])

    kind = df.schema[key].dataType.simpleString()
    out = filled(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"id {kind}, units bigint, repeated bigint")
    share = F.when(F.col("units") > 0, F.col("repeated") / F.col("units")).when(F.col("units") == 0, F.lit(0.0))
    return out.select(F.col("id").alias(key), "units", "repeated", share.alias("share"))


def repetitive(df: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 1 / 3) -> DataFrame:
    """(key): the documents that retention should refuse, as more than ``limit`` of their units are labelled repetition."""
    return repeated_share(df, key, text).where(F.col("share") > F.lit(limit)).select(key)
