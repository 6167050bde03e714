"""Matching entities across sources without keys.

Candidate pairs share a title up to one slip. Their similarity vectors (title, time, genres, numbers and kind) are
separated without labels by a two-component Gaussian mixture with regularised covariances. The E-step enforces
transitivity: two different entries are two different things, so a record can match at most one of them, and its match
probabilities, together with that of no match, sum to one. The posteriors are the confidences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caddis.llm.titles import Title, parse_title
from caddis.session import cut

#: Ridge added to the variances, and rounds of expectation maximisation.
RIDGE, ROUNDS = 0.03, 12
FEATURES = ("f_title", "f_time", "f_genre", "f_number")


def spellings(title: Title) -> list[str]:
    """The name run together, starting from each of its segments."""
    s = title.segments
    return list(dict.fromkeys("".join(s[i:] + s[:i]) for i in range(len(s))))


def slip_keys(name: str) -> list[int]:
    """Hashes of the name, whole and without any one of its letters: names one slip apart share a key."""
    import xxhash

    parts = {name} | {name[:i] + name[i + 1 :] for i in range(len(name))} - {""}
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in sorted(parts)]


def _bigrams(s: str) -> Counter:
    return Counter(s[i : i + 2] for i in range(len(s) - 1)) or Counter([s])


def name_similarity(a: list[str], b: list[str]) -> float:
    """Greatest Dice coefficient of letter pairs over the spellings of two names; 1 for equal names."""
    if set(a) & set(b):
        return 1.0
    best = 0.0
    for x in map(_bigrams, a):
        for y in map(_bigrams, b):
            best = max(best, 2 * sum((x & y).values()) / (x.total() + y.total()))
    return best


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def date_span(text: str | None) -> tuple[int, int] | None:
    """First and last day (since the year 1) a date may mean: a day, a month or a year, in several spellings."""
    if not text:
        return None
    s = text.strip().lower()
    if m := re.match(r"(\d{4})-(\d{1,2})-(\d{1,2})", s):
        parts = int(m[1]), int(m[2]), int(m[3])
    elif (m := re.match(r"([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$", s)) and m[1] in _MONTHS:
        parts = int(m[3]), _MONTHS.index(m[1]) + 1, int(m[2])
    elif (m := re.match(r"(\d{1,2})\.? ([a-z]{3})[a-z]*\.? (\d{4})$", s)) and m[2] in _MONTHS:
        parts = int(m[3]), _MONTHS.index(m[2]) + 1, int(m[1])
    elif m := re.match(r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})$", s):
        return (datetime(int(m[3]), 1, 1).toordinal(), datetime(int(m[3]), 12, 31).toordinal()) if int(m[3]) else None
    elif m := re.match(r"(\d{4})$", s):
        return (datetime(int(m[1]), 1, 1).toordinal(), datetime(int(m[1]), 12, 31).toordinal()) if int(m[1]) else None
    else:
        return None
    try:
        day = datetime(*parts).toordinal()
    except ValueError:
        return None
    return day, day


_READ = "spellings array<string>, number int, kind string, amount int, keys array<bigint>"


def read_titles(df: DataFrame, column: str) -> DataFrame:
    """df with the parts of a title as ``_r`` and its slip keys; each partition reads an equal title once."""

    @F.pandas_udf(_READ)
    def read(titles):
        import pandas as pd

        rows = []
        for t in titles:
            if t is None or not t.strip():
                rows.append((None, None, None, None, None))
                continue
            p = parse_title(t)
            names = spellings(p)
            rows.append((names, p.number, p.kind, p.amount, sorted({k for n in names for k in slip_keys(n)})))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])

    return df.withColumn("_r", read(column))


def _span(column: str) -> Column:
    @F.pandas_udf("struct<low:int,high:int>")
    def span(dates):
        import pandas as pd

        return pd.DataFrame([date_span(d) or (None, None) for d in dates], columns=["low", "high"]).astype("Int32")

    return span(column)


def _name(left: str, right: str) -> Column:
    @F.pandas_udf("double")
    def similarity(a, b):
        import pandas as pd

        return pd.Series([name_similarity(list(x), list(y)) for x, y in zip(a, b)], dtype=float)

    return similarity(left, right)


def signatures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that differ in anything compared, with how many there are; signature of each record).

    df: _id, _title, _date, _genres (array), _dlc (boolean). Records alike in all that is compared are one point for the
    matching: a title that a third of all records share costs as much as the different dates and genres it comes with.
    """
    parsed = read_titles(df, "_title").where("_r.spellings IS NOT NULL")
    kind = F.when(F.coalesce("_dlc", F.lit(False)), "dlc").otherwise(F.col("_r.kind")).alias("kind")
    genres = F.array_sort(F.array_distinct(F.filter(F.coalesce("_genres", F.array().cast("array<string>")), lambda g: g.isNotNull()))).alias("genres")
    compared = F.struct(F.col("_r.spellings").alias("names"), "_r.number", kind, "_r.amount", _span("_date").alias("span"), genres)
    rows = cut(parsed.select("_id", compared.alias("of"), F.col("_r.keys").alias("keys")).withColumn("sig", F.md5(F.to_json("of", {"ignoreNullFields": "false"}))))
    points = rows.groupBy("sig").agg(F.count("*").alias("many"), F.min("_id").alias("one"), F.first("of").alias("of"), F.first("keys").alias("keys"))
    return points.withColumn("name", F.xxhash64("of.names")), rows.select("sig", "_id")


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of signatures whose names agree up to one slip, with their similarity vectors and how many they stand for.

    Similarities are rounded to hundredths, so that there is a bounded number of different vectors.

    Names meet on hashes of their one-letter deletions, an equi-join in which each distinct name has one row per letter.
    """
    a = left.select(F.col("sig").alias("l_sig"), F.col("many").alias("l_many"), F.col("of").alias("l"), F.col("name").alias("_a"), "keys")
    b = right.select(F.col("sig").alias("r_sig"), F.col("many").alias("r_many"), F.col("one").alias("r_id"), F.col("of").alias("r"), F.col("name").alias("_b"), "keys")
    names = lambda df, n: df.select(n, "keys").dropDuplicates([n]).select(n, F.explode("keys").alias("key"))
    met = names(a, "_a").join(names(b, "_b"), "key").select("_a", "_b").distinct()
    pairs = met.join(a.drop("keys"), "_a").join(b.drop("keys"), "_b")
    gap = F.greatest(F.lit(0), F.col("l.span.low") - F.col("r.span.high"), F.col("r.span.low") - F.col("l.span.high")) / F.lit(365.25)
    gap = F.when(F.col("l.span.low").isNotNull() & F.col("r.span.low").isNotNull(), gap)
    both = (F.size("l.genres") > 0) & (F.size("r.genres") > 0)
    shared = F.size(F.array_intersect("l.genres", "r.genres")) / F.least(F.size("l.genres"), F.size("r.genres"))
    agree = (F.col("l.number") == F.col("r.number")) & (F.col("l.kind") == F.col("r.kind")) & (F.col("l.amount") == F.col("r.amount"))
    return pairs.select(
        "l_sig",
        "r_sig",
        "r_id",
        "l_many",
        "r_many",
        F.round(_name("l.names", "r.names"), 2).alias("f_title"),
        F.round(F.exp(-gap / 2), 2).alias("f_time"),
        F.round(F.when(both, (shared + 1) / 2), 2).alias("f_genre"),
        agree.cast("double").alias("f_number"),
    )


def _density(x: list[Column], mean: np.ndarray, covariance: np.ndarray) -> Column:
    """Log density of a Gaussian as a column expression."""
    inverse = np.linalg.inv(covariance)
    centred = [c - F.lit(float(m)) for c, m in zip(x, mean)]
    form = sum((F.lit(float(inverse[i, j])) * centred[i] * centred[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    return F.lit(float(-0.5 * np.linalg.slogdet(covariance)[1])) - form * 0.5


def _statistics(parameters: list):
    """What a round adds up over rows (candidates, many): mass of matches, mass of all, and both components' moments.

    parameters: (weight, mean, covariance) of matches and of the rest; empty before the first round, which starts from
    a guess: alike in all features or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(FEATURES)
        sums = np.zeros(2 + 2 * (d + d * (d + 1) // 2))
        for batch in batches:
            lists = batch.column("candidates")
            lengths = np.asarray(pa.compute.list_value_length(lists), np.int64)
            if not len(lengths):
                continue
            flat = lists.flatten()
            x = np.column_stack([np.asarray(flat.field(f"_{f}"), float) for f in FEATURES])
            n, row = np.asarray(flat.field("n"), float), np.repeat(np.arange(len(lengths)), lengths)
            if parameters:
                logs = []
                for weight, mean, covariance in parameters:
                    centred = x - mean
                    form = np.einsum("ni,ij,nj->n", centred, np.linalg.inv(covariance), centred)
                    logs.append(np.log(weight) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * form)
                odds = logs[0] - logs[1]
            else:
                odds = np.where(x.mean(1) > 0.8, 2.0, -2.0)
            top = np.maximum(0.0, np.maximum.reduceat(odds, np.concatenate(([0], np.cumsum(lengths)[:-1]))))
            e = np.exp(odds - top[row])
            p = e / (np.exp(-top) + np.bincount(row, e * n, len(lengths)))[row]
            mass = n * np.asarray(batch.column("many"), float)[row]
            at = 2
            sums[0] += (p * mass).sum()
            sums[1] += mass.sum()
            for weight in (p * mass, (1 - p) * mass):
                sums[at : at + d] += weight @ x
                second = (x * weight[:, None]).T @ x
                sums[at + d : at + d + d * (d + 1) // 2] += second[np.tril_indices(d)]
                at += d + d * (d + 1) // 2
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    return run


def _normaliser(odds) -> tuple[Column, Column]:
    """(greatest log odds, for a column ``_top``; log of the sum of the odds of a record's candidates and of no match (1), by its array ``candidates``).

    Entries alike in all that is compared share theirs, so none of them passes one half.
    """
    top = F.aggregate("candidates", F.lit(0.0), lambda a, c: F.greatest(a, odds(c)))
    total = F.aggregate("candidates", F.exp(-F.col("_top")), lambda a, c: a + c["n"] * F.exp(odds(c) - F.col("_top")))
    return top, F.log(total) + F.col("_top")


def fit_posteriors(pairs: DataFrame, rounds: int = ROUNDS, ridge: float = RIDGE) -> DataFrame:
    """pairs with ``posterior``: the probability that the two records are the same thing.

    Each pair counts as often as the records that it stands for. A missing feature takes the mean of the pairs that have
    it, and so tells nothing. Only what a record's candidates look like matters to the fit: the similarity vectors that
    occur among them and how often. Records with the same such candidates are one row, written once; a round of the
    expectation maximisation reads these rows, makes each one's probabilities exclusive inside its array, and adds up.
    No round shuffles; weights, means and covariances, a few numbers, are what reaches the driver. An array holds
    different vectors only, so its length is bounded by the number of these, however many candidates a record has.
    """
    many = F.col("l_many") * F.col("r_many")
    weighted = lambda c: F.sum(F.when(F.col(c).isNotNull(), many) * F.col(c)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), many)), F.lit(0))
    means = pairs.agg(*[weighted(c).alias(c) for c in FEATURES]).head()
    filled = pairs.select("*", *[F.coalesce(F.col(c), F.lit(means[c] if means[c] is not None else 0.0)).alias(f"_{c}") for c in FEATURES])
    x = [f"_{c}" for c in FEATURES]
    d = len(x)
    vectors = filled.groupBy("l_sig", *x).agg(F.first("l_many").alias("l_many"), F.sum("r_many").alias("n"))
    records = cut(vectors.groupBy("l_sig").agg(F.first("l_many").alias("many"), F.sort_array(F.collect_list(F.struct(*x, "n"))).alias("candidates")))
    shapes = cut(records.groupBy("candidates").agg(F.sum("many").alias("many")))
    total = shapes.agg(F.sum("many")).head()[0]
    if not total:
        return pairs.withColumn("posterior", F.lit(0.0))
    parameters: list = []
    last = None
    for _ in range(rounds):
        parts = shapes.mapInArrow(_statistics(parameters), "sums array<double>").collect()  # one row a partition
        row = np.sum([r[0] for r in parts], axis=0)
        parameters, at = [], 2
        for mass in (max(row[0], 1e-6), max(row[1] - row[0], 1e-6)):
            mean = np.array(row[at : at + d], float) / mass
            at += d
            covariance = np.zeros((d, d))
            for i in range(d):
                for j in range(i + 1):
                    covariance[i, j] = covariance[j, i] = row[at] / mass - mean[i] * mean[j]
                    at += 1
            parameters.append((mass / max(row[1], 1), mean, 0.8 * covariance + 0.2 * np.diag(np.diag(covariance)) + ridge * np.eye(d)))
        (wm, mm, cm), (wu, mu, cu) = parameters
        now = np.concatenate([mm, mu])
        if last is not None and np.abs(now - last).max() < 1e-3:
            break
        last = now
    log_odds = lambda c: F.lit(float(np.log(wm) - np.log(wu))) + _density([c[f] for f in x], mm, cm) - _density([c[f] for f in x], mu, cu)
    top, log_total = _normaliser(log_odds)
    logs = records.withColumn("_top", top).select("l_sig", log_total.alias("_log"))
    own = log_odds(F.struct(*x))
    return filled.withColumn("_odds", own).join(logs, "l_sig").withColumn("posterior", F.exp(F.col("_odds") - F.col("_log"))).drop(*x, "_odds", "_log")


def match_records(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(l_id, r_id, confidence): each left record's match among the right ones, if one is more probable than not.

    left and right have _id, _title, _date (text), _genres (array of strings) and _dlc (boolean), one row per id. The
    most probable entry of a record is its match if its posterior is above the threshold. Records without a title match
    nothing; missing dates or genres tell nothing either way; equally probable entries share the probability, so
    neither passes. Empty inputs give no rows.
    """
    points, members = signatures(left)
    entries, _ = signatures(right)
    scored = fit_posteriors(cut(candidate_pairs(points, entries)))
    best = scored.groupBy("l_sig").agg(F.min_by(F.struct("r_id", "posterior"), F.struct((-F.col("posterior")).alias("p"), F.col("r_id"))).alias("b"))
    chosen = best.where(F.col("b.posterior") > threshold).select(F.col("l_sig").alias("sig"), "b.r_id", F.col("b.posterior").alias("confidence"))
    return members.join(chosen, "sig").select(F.col("_id").alias("l_id"), "r_id", "confidence")
