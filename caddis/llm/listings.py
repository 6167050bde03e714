"""Product listings that describe the same item.

Titles are reduced to their names; each distinct name is a vector of a subword encoder, trained contrastively on names
and spoilt copies of them. An inverted file of the vectors finds each name's neighbours; how many lists are probed is
tuned until the neighbours agree with exact ones. Pairs that are neighbours of each other join their names if their
cosine is high enough for the way in which they differ, and a spelling check can only refuse them; listings of joined
names are one item unless number, amount, kind or subtitle differ (the numeric-variant veto).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caddis.llm.entities import slip_keys
from caddis.llm.titles import fold, parse_title, spans
from caddis.session import cut, drop_cut, freed_shuffles

#: Subword buckets and dimensions of the encoder; names that train it, steps and batch of training.
BUCKETS, DIMENSIONS = 16_384, 32
TRAINING_NAMES, STEPS, BATCH, TEMPERATURE, SEED = 4_000, 150, 256, 0.07, 11
#: Greatest number of lists, names that fit their centres, names of one group of lists and of a query block.
LISTS, CENTRE_NAMES, GROUP_NAMES, QUERY_BLOCK = 2_048, 20_000, 40_000, 4_000
#: Names that must agree in a fact with and without a phrase for it to be a seller's, their least share, and the most phrases.
AGREED, AGREED_SHARE, PHRASES = 3, 0.35, 2_000
#: Names of makers that must end with a word for it to mark a maker.
MAKER_NAMES = 3
#: Neighbours of a name, beside which all names nearer than NEAR are kept; names that tune the probes, and the recall wanted.
NEIGHBOURS, NEAR, TUNING_NAMES, RECALL = 16, 0.85, 200, 0.95
#: Greatest length of a name, blanks included, that meets others on its one-letter deletions, too.
KEY_LETTERS = 255
#: Least cosine of two spellings of a name: if other facts of the listings agree (FLOOR); if letters are only left out,
#: doubled or swapped (SAME_LETTERS); if one is replaced by another (OTHER_LETTER); if that is one of two slips
#: (OTHER_LETTERS). The shorter a name, the more of its
#: subwords a slip changes, so a short name needs its facts where a long one speaks for itself.
FLOOR, SAME_LETTERS, OTHER_LETTER, OTHER_LETTERS = 0.3, 0.45, 0.75, 0.8


def subwords(name: str) -> list[int]:
    """Buckets of a name's letter pairs, pairs with one letter left out between, and trigrams, segment by segment."""
    grams = []
    for segment in name.split(" "):
        s = f"^{segment}$"
        grams += [s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)] + [f"{a}_{b}" for a, b in zip(s, s[2:])]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def embed(names: list[str], table: np.ndarray) -> np.ndarray:
    """Unit vectors of names: the sum of their subwords' vectors, scaled."""
    if not names:
        return np.zeros((0, table.shape[1]), np.float32)
    grams = [subwords(n) for n in names]
    counts = np.array([len(g) for g in grams])
    flat = table[np.concatenate([np.array(g, np.int64) for g in grams])]
    sums = np.add.reduceat(flat, np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def spoil(name: str, rng: np.random.Generator) -> str:
    """Another seller's spelling of a name: segments turned round or run together, and up to two slips."""
    segments = name.split(" ")
    if len(segments) > 1 and rng.random() < 0.5:
        segments = segments[1:] + segments[:1]
    letters = list(("" if rng.random() < 0.3 else " ").join(segments))
    for _ in range(rng.integers(0, 3)):
        i = int(rng.integers(0, max(1, len(letters) - 1)))
        match rng.integers(0, 4):
            case 0:
                letters[i : i + 1] = []
            case 1:
                letters[i:i] = letters[i : i + 1]
            case 2:
                letters[i : i + 2] = letters[i : i + 2][::-1]
            case _:
                letters[i : i + 1] = [chr(97 + int(rng.integers(26)))]
    return "".join(letters) or name


def train_encoder(names: list[str], steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """Subword vectors fitted by a contrastive loss: a name's spoilt copy is nearer to it than the rest of its batch.

    Batches are runs of the sorted names, so that a name meets its series' other names as negatives.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    if len(names) < 2:
        return table
    names = sorted(names)
    mean, square = np.zeros_like(table), np.zeros_like(table)
    size = min(BATCH, len(names))
    for step in range(1, steps + 1):
        start = int(rng.integers(0, len(names) - size + 1))
        batch = names[start : start + size] if step % 2 else [names[i] for i in rng.choice(len(names), size, replace=False)]
        sides, touched = [], []
        for texts in (batch, [spoil(n, rng) for n in batch]):
            grams = [subwords(n) for n in texts]
            flat = np.concatenate([np.array(g, np.int64) for g in grams])
            counts = np.array([len(g) for g in grams])
            row = np.repeat(np.arange(len(texts)), counts)
            sums = np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)
            norm = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            sides.append((flat, row, sums / norm, norm))
        a, b = sides[0][2], sides[1][2]
        logits = a @ b.T / TEMPERATURE
        forward = np.exp(logits - logits.max(1, keepdims=True))
        backward = np.exp(logits - logits.max(0, keepdims=True))
        g = (forward / forward.sum(1, keepdims=True) + backward / backward.sum(0, keepdims=True)) / 2 - np.eye(size)
        g /= size * TEMPERATURE
        for (flat, row, z, norm), gz in ((sides[0], g @ b), (sides[1], g.T @ a)):
            inner = (gz - z * (gz * z).sum(1, keepdims=True)) / norm
            touched.append((flat, inner[row]))
        at, step_grads = np.concatenate([f for f, _ in touched]), np.concatenate([x for _, x in touched])
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        grads = np.zeros_like(table)
        grads[own] = np.add.reduceat(step_grads[order], first, axis=0)
        mean = 0.9 * mean + 0.1 * grads
        square = 0.99 * square + 0.01 * grads * grads
        table -= (0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return table


def centres(vectors: np.ndarray, lists: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Centres of the lists: spherical k-means."""
    rng = np.random.default_rng(seed)
    c = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        own = (vectors @ c.T).argmax(1)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        sums = np.zeros_like(c)
        sums[held] = np.add.reduceat(vectors[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-9), c)
    return c


def within_slips(a: str, b: str, slips: int, replaced: int = 1) -> bool:
    """Whether a becomes b by at most so many letters put in, left out, replaced or swapped with their neighbour.

    A replaced letter counts as ``replaced`` slips.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > slips:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [slips + 1] * len(b)
        for j in range(max(1, i - slips), min(len(b), i + slips) + 1):
            y = b[j - 1]
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (replaced if x != y else 0))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now[j] = v
        if min(now[max(0, i - slips) : i + slips + 1], default=slips + 1) > slips:
            return False
        before, last = last, now
    return last[len(b)] <= slips


#: What is known of two names: other names; one name if other facts agree; one name.
OTHER, PERHAPS, SAME = 0, 1, 2


def judged(a: str, b: str, cosine: float) -> int:
    """OTHER, PERHAPS or SAME for two names of a given cosine.

    The spelling refuses names more than two slips apart in every order of their segments, blanks aside. Among the rest
    the cosine decides: sellers' slips leave letters out, double or swap them, while names that differ in replaced
    letters (Larogofa, Lorogofo; Fez, Rez) are often two series, so these must be nearer.
    """
    x, y = a.split(" "), b.split(" ")
    rights = {"".join(y[i:] + y[:i]) for i in range(len(y))}
    lefts = {"".join(x[i:] + x[:i]) for i in range(len(x))}
    meet = lambda slips, replaced=1: any(within_slips(p, q, slips, replaced) for p in lefts for q in rights)
    if lefts & rights:
        return SAME
    if cosine < FLOOR or not meet(2):
        return OTHER
    if meet(1, 3):  # a letter left out and another put in its place is a replaced one, though two steps make it, too
        return SAME if cosine >= SAME_LETTERS else PERHAPS
    least = OTHER_LETTER if meet(1) else SAME_LETTERS if meet(2, 3) else OTHER_LETTERS
    return SAME if cosine >= least else PERHAPS


def seller_phrases(df: DataFrame, title: str, facts: list[str]) -> frozenset[str]:
    """Phrases that sellers add to titles, learned from all listings.

    A phrase is tried wherever it begins or ends a part of a title and another listing is called what is left without
    it. If the two share a fact (a release date, a localized name) for many different names, it says nothing about the
    item; a subtitle, a number or a kind of item goes with other facts. A phrase is a seller's if AGREED names or more
    agree, and at least AGREED_SHARE of the names whose facts can be compared. Names and facts count once, however many
    listings have them; at most PHRASES phrases, those with the most names, reach the driver.
    """

    @F.pandas_udf("struct<whole:string,phrases:array<struct<phrase:string,rest:string>>>")
    def tried(titles):
        import pandas as pd

        found = [spans(t) for t in titles]
        return pd.DataFrame({"whole": [w for w, _ in found], "phrases": [[{"phrase": p, "rest": r} for p, r in ps] for _, ps in found]})

    known = F.filter(F.array(*[F.struct(F.lit(i).alias("kind"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for i, c in enumerate(facts)]), lambda f: f["value"].isNotNull())
    facts_of = F.transform(known, lambda f: F.struct(f["kind"].alias("kind"), F.xxhash64(f["value"]).alias("fact")))
    rows = df.select(F.col(title).alias("_t"), facts_of.alias("_f")).where("trim(_t) <> '' AND size(_f) > 0").distinct().withColumn("_s", tried("_t"))
    phrases = F.transform("_s.phrases", lambda p: F.struct(p["phrase"].alias("phrase"), F.xxhash64(p["rest"]).alias("rest")))
    read = cut(rows.select("_f", F.xxhash64("_s.whole").alias("rest"), phrases.alias("phrases")))
    rows = read.select(F.explode("_f").alias("f"), "rest", "phrases").select("f.kind", "f.fact", "rest", "phrases")
    whole = rows.select("rest", "kind", "fact").distinct()
    asked = rows.select("kind", "fact", F.explode("phrases").alias("p")).select("p.phrase", "p.rest", "kind", "fact").distinct()
    there = asked.join(whole.select("rest", "kind").distinct(), ["rest", "kind"])
    agree = there.join(whole.withColumn("_same", F.lit(1)), ["rest", "kind", "fact"], "left")
    names = agree.groupBy("phrase", "rest").agg(F.max("_same").alias("_same"))
    counts = names.groupBy("phrase").agg(F.count("_same").alias("agreed"), F.count("*").alias("names"))
    kept = counts.where((F.col("agreed") >= AGREED) & (F.col("agreed") >= F.lit(AGREED_SHARE) * F.col("names")))
    learned = frozenset(r[0] for r in kept.orderBy(F.col("agreed").desc(), "phrase").limit(PHRASES).collect())
    drop_cut(read)
    return learned


def maker_words(df: DataFrame, columns: list[str]) -> tuple[str, ...]:
    """Last words of the makers' names in some columns that MAKER_NAMES different names of two words or more end with; at
    most PHRASES of them, those of the most names."""
    if not columns:
        return ()
    names = df.select(F.explode(F.array(*[F.lower(F.trim(F.col(c).cast("string"))) for c in columns])).alias("n")).where("n LIKE '% %'").distinct()
    counts = names.groupBy(F.regexp_extract("n", r"(\S+)$", 1).alias("word")).agg(F.count("*").alias("names")).where(F.col("names") >= MAKER_NAMES)
    return tuple(sorted({fold(r[0]) for r in counts.orderBy(F.col("names").desc(), "word").limit(PHRASES).collect()} - {""}))


def named(df: DataFrame, key: str, title: str, facts: list[str], learned: frozenset[str] = frozenset(), adverts: bool = True, makers: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, numeric, subtitle, facts) of each listing: its name's segments in order; number, kind and amount; the
    subtitle behind a number, null for none; other facts."""

    @F.pandas_udf("struct<name:string,numeric:string,subtitle:string>")
    def parts(titles):
        import pandas as pd

        read = [parse_title(t, learned, adverts, makers) for t in titles]
        return pd.DataFrame({"name": [p.core for p in read], "numeric": [p.numeric for p in read], "subtitle": [p.subtitle or None for p in read]})

    known = F.filter(F.array(*[F.concat(F.lit(f"{i}:"), F.nullif(F.col(c).cast("string"), F.lit(""))) for i, c in enumerate(facts)]).cast("array<string>"), lambda f: f.isNotNull())
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(title).alias("_t"), known.alias("facts")).where("id IS NOT NULL AND trim(_t) <> ''")
    return rows.withColumn("_p", parts("_t")).select("id", "_p.name", "_p.numeric", "_p.subtitle", "facts")


def _unit(column) -> np.ndarray:
    """Vectors of a column of bytes."""
    return np.frombuffer(b"".join(column), np.float16).reshape(len(column), -1).astype(np.float32)


def _vectors(names: DataFrame, table: np.ndarray, c: np.ndarray) -> DataFrame:
    """(n, name, vector, list): each name's vector as bytes (half precision), and the list it lies in."""
    shared = names.sparkSession.sparkContext.broadcast((table, c))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        t, centre = shared.value
        for pdf in batches:
            v = embed(pdf["name"].tolist(), t)
            yield pd.DataFrame({"n": pdf["n"], "name": pdf["name"], "vector": [r.tobytes() for r in v.astype(np.float16)], "list": (v @ centre.T).argmax(1) if len(v) else []})

    return names.select("n", "name").mapInPandas(run, "n bigint, name string, vector binary, list int")


def _grouped_lists(index: DataFrame, c: np.ndarray) -> np.ndarray:
    """Group of each list: lists with near centres stand together, in groups of about GROUP_NAMES names; a list with more
    is a group by itself. At most LISTS counts reach the driver."""
    sizes = np.zeros(len(c), np.int64)
    for number, count in index.groupBy("list").count().collect():
        sizes[number] = count
    group, g, filled = np.zeros(len(c), np.int64), 0, 0
    rest = set(range(len(c)))
    at = 0
    while rest:  # a walk from centre to nearest centre not yet placed
        rest.discard(at)
        if filled and filled + sizes[at] > GROUP_NAMES:
            g, filled = g + 1, 0
        group[at], filled = g, filled + sizes[at]
        if rest:
            left = np.fromiter(rest, np.int64)
            at = int(left[(c[left] @ c[at]).argmax()])
    return group


def _probed(vectors: DataFrame, c: np.ndarray, group: np.ndarray, probes: int) -> DataFrame:
    """Queries: a row for each group that holds lists nearest to a name, with those lists."""
    shared = vectors.sparkSession.sparkContext.broadcast((c, group))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        centre, of = shared.value
        k = min(probes, len(centre))
        for pdf in batches:
            if not len(pdf):
                continue
            near = np.argpartition(-(_unit(pdf["vector"]) @ centre.T), k - 1, axis=1)[:, :k].astype(np.int16)
            qs, vs, gs, ls = [], [], [], []
            for q, v, row in zip(pdf["n"], pdf["vector"], near):
                groups = of[row]
                for g in np.unique(groups):
                    qs.append(q)
                    vs.append(v)
                    gs.append(int(g))
                    ls.append(row[groups == g].tobytes())
            yield pd.DataFrame({"q": qs, "vector": vs, "group": gs, "lists": ls})

    return vectors.select("n", "vector").mapInPandas(run, "q bigint, vector binary, group int, lists binary")


def search(queries: DataFrame, index: DataFrame, c: np.ndarray, probes: int, k: int = NEIGHBOURS, near: float = NEAR, floor: float = FLOOR) -> DataFrame:
    """(q, n, cosine, rank): each query's k nearest names of the probed lists, and every name there nearer than ``near``.

    Lists near each other are searched in one task, so a query travels once for all its lists there, and only its k
    nearest of them leave the task, none below ``floor``. Group and queries are cut into blocks of bounded size that
    meet once each: a list that holds a third of all names is many small tasks.
    """
    group = _grouped_lists(index, c)
    spark = index.sparkSession
    placed = index.join(F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "list int, group int")), "list")
    probed = _probed(queries, c, group, probes)
    width = lambda df, block: {r[0]: -(-r[1] // block) for r in df.groupBy("group").count().collect()}  # noqa: E731  at most LISTS rows
    across, down = width(placed, 2 * GROUP_NAMES), width(probed, QUERY_BLOCK)
    blocks = F.broadcast(spark.createDataFrame([(i, across[i], down.get(i, 1)) for i in across] or [(-1, 1, 1)], "group int, across int, down int"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = probed.join(blocks, "group").withColumn("y", F.pmod(F.xxhash64("q"), "down").cast("int")).select("group", "q", "vector", "lists", "y", every("across").alias("x"))
    right = placed.join(blocks, "group").withColumn("x", F.pmod(F.xxhash64("n"), "across").cast("int")).select("group", "list", "n", "vector", "x", every("down").alias("y"))

    def meet(a, b):
        import pandas as pd

        none = pd.DataFrame({"q": [], "n": [], "cosine": []}).astype({"q": "int64", "n": "int64", "cosine": "float32"})
        if not len(a) or not len(b):
            return none
        u, v = _unit(a["vector"]), _unit(b["vector"])
        wanted = [np.frombuffer(x, np.int16) for x in a["lists"]]
        row = np.repeat(np.arange(len(a)), [len(w) for w in wanted])
        asked = np.concatenate(wanted)
        order = np.argsort(asked, kind="stable")
        asked, row = asked[order], row[order]
        held = b["list"].to_numpy()
        by = np.argsort(held, kind="stable")
        held = held[by]
        queries, names = a["q"].to_numpy(), b["n"].to_numpy()
        qs, ns, cs = [], [], []
        for number in np.unique(held):
            cols = by[np.searchsorted(held, number) : np.searchsorted(held, number, side="right")]
            rows = row[np.searchsorted(asked, number) : np.searchsorted(asked, number, side="right")]
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                s = u[part] @ v[cols].T
                s[queries[part, None] == names[None, cols]] = -2
                keep = s >= floor
                if len(cols) > k:
                    best = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    keep &= s >= np.minimum(best, near)
                i, j = np.nonzero(keep)
                qs.append(part[i])
                ns.append(cols[j])
                cs.append(s[i, j])
        if not qs:
            return none
        q, n, cosine = np.concatenate(qs), np.concatenate(ns), np.concatenate(cs)
        order = np.lexsort((names[n], -cosine, q))
        q, n, cosine = q[order], n[order], cosine[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = (place < k) | (cosine >= near)
        return pd.DataFrame({"q": queries[q[keep]], "n": names[n[keep]], "cosine": cosine[keep]})

    keys = ["group", "x", "y"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q bigint, n bigint, cosine float")
    w = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "n")
    return found.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) | (F.col("cosine") >= near)).select("q", "n", "cosine", "rank")


def mutual_pairs(found: DataFrame, k: int = NEIGHBOURS, near: float = NEAR) -> DataFrame:
    """(a, b, cosine), a < b: names each of which is as near to the other as the other's k-th neighbour, or nearer than ``near``.

    A pair met from one side only, because the other side's probes missed it, is judged by its cosine just the same.
    """
    reach = found.where(F.col("rank") <= k).groupBy(F.col("q").alias("n")).agg(F.min("cosine").alias("_c"), F.count("*").alias("_m"))
    kept = found.join(reach, "n", "left").where(F.col("_c").isNull() | (F.col("_m") < k) | (F.col("cosine") >= F.least(F.col("_c") - 1e-6, F.lit(near))))
    return kept.groupBy(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).agg(F.max("cosine").alias("cosine"))


def one_slip_pairs(names: DataFrame) -> DataFrame:
    """(a, b), a < b: all names of (n, name) that may be one slip apart in some order of their segments.

    They meet on hashes of their one-letter deletions, whatever crowd of other names is nearer. A key is shared by at
    most the names that one more letter makes of it, so no key's names grow with the table. Names of over KEY_LETTERS
    letters are left to the neighbours.
    """

    @F.pandas_udf("array<bigint>")
    def keys(texts):
        import pandas as pd

        def of(name):
            s = name.split(" ")
            return sorted({k for i in range(len(s)) for k in slip_keys("".join(s[i:] + s[:i]))})

        return pd.Series([of(t) for t in texts])

    keyed = names.where(F.length("name") <= KEY_LETTERS).select("n", F.explode(keys("name")).alias("key"))
    keyed = cut(keyed.withColumn("_m", F.count("*").over(Window.partitionBy("key"))).where("_m > 1").select("n", "key"))  # most keys are of one name
    met = keyed.withColumnRenamed("n", "a").join(keyed.withColumnRenamed("n", "b"), "key").where("a < b")
    pairs = cut(met.select("a", "b").distinct())
    drop_cut(keyed)
    return pairs


def exact_neighbours(queries: list[tuple[int, bytes]], index: DataFrame, k: int = NEIGHBOURS, floor: float = FLOOR) -> DataFrame:
    """(q, n, list): the k nearest of all names, of a cosine of ``floor`` or more, and the lists they lie in, for a bounded
    number of queries, by brute force."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        q = np.array([i for i, _ in shared.value], np.int64)
        u = _unit([v for _, v in shared.value])
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy()
            s = u @ _unit(pdf["vector"]).T
            s[q[:, None] == n[None, :]] = -2
            m = min(k, len(n))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pd.DataFrame({"q": np.repeat(q, m), "n": n[top].ravel(), "list": pdf["list"].to_numpy()[top].ravel(), "cosine": np.take_along_axis(s, top, 1).ravel()})

    w = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "n")
    found = index.select("n", "vector", "list").mapInPandas(run, "q bigint, n bigint, list int, cosine float").where(F.col("cosine") >= floor)
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("q", "n", "list")


def build_index(names: DataFrame) -> tuple[DataFrame, np.ndarray, int, float]:
    """(vectors, centres, probes, recall) of distinct names (n, name).

    Encoder and centres are fitted on the names with the smallest hashes, TRAINING_NAMES and CENTRE_NAMES of them; every
    name is indexed. The probes double until RECALL of the exact neighbours of TUNING_NAMES names, those of a cosine that
    two spellings of a name have (SAME_LETTERS or more), lie in the probed lists.
    """
    order = F.xxhash64(F.lit(SEED), "name")
    sample = [r[0] for r in names.orderBy(order, "name").limit(CENTRE_NAMES).select("name").collect()]
    table = train_encoder(sample[:TRAINING_NAMES])
    count = names.count()
    lists = int(min(LISTS, max(1, count**0.5)))
    c = centres(embed(sample, table), lists) if sample else np.zeros((1, DIMENSIONS), np.float32)
    vectors = cut(_vectors(names, table, c))
    tuning = vectors.orderBy(F.xxhash64(F.lit(SEED + 1), "n"), "n").limit(TUNING_NAMES)
    queries = [(r["n"], bytes(r["vector"])) for r in tuning.select("n", "vector").collect()]
    exact = exact_neighbours(queries, vectors, floor=SAME_LETTERS).select("q", "list").collect() if queries else []
    if not exact:
        return vectors, c, min(8, len(c)), 1.0
    row = {q: i for i, (q, _) in enumerate(queries)}
    nearness = _unit([v for _, v in queries]) @ c.T
    # how many lists are nearer to the query than the one its neighbour lies in
    before = np.array([(nearness[row[q]] > nearness[row[q], number]).sum() for q, number in exact])
    probes = 1
    while (before < probes).mean() < RECALL:
        probes *= 2
    return vectors, c, min(probes, len(c)), float((before < probes).mean())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; edges (a, b) of bigints.

    Large-star and small-star steps in turn: each node's greater, then its lesser neighbours are tied to the least of
    them, until nothing changes; a chain of any length halves in each round. Lineage is cut in each step.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        before = links
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = links = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        tied = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop_cut(before, large)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == mark:
            break
        mark = now
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def joined_names(names: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, label): names (n, name) that are spellings of one, by the label of their component; facts: n, fact."""
    vectors, c, probes, recall = build_index(names)
    near = cut(search(vectors, vectors, c, probes))
    found = cut(mutual_pairs(near))
    drop_cut(near)

    @F.pandas_udf("float")
    def cosine(x, y):
        import pandas as pd

        return pd.Series((_unit(x) * _unit(y)).sum(1) if len(x) else [], dtype="float32")

    @F.pandas_udf("int")
    def judge(x, y, near):
        import pandas as pd

        return pd.Series([judged(a, b, s) for a, b, s in zip(x, y, near)], dtype="int32")

    known = vectors.select("n", "name", "vector")
    pairs = one_slip_pairs(names)
    slips = pairs.join(found, ["a", "b"], "left_anti")
    slips = slips.join(known.toDF("a", "x", "_u"), "a").join(known.toDF("b", "y", "_v"), "b").select("a", "b", "x", "y", cosine("_u", "_v").alias("cosine"))
    spelled = vectors.select("n", "name")
    met = found.join(spelled.toDF("a", "x"), "a").join(spelled.toDF("b", "y"), "b").select("a", "b", "x", "y", "cosine").unionByName(slips)
    checked = cut(met.select("a", "b", judge("x", "y", "cosine").alias("same")).where(F.col("same") > OTHER))
    drop_cut(vectors, found, pairs)
    sure = F.col("same") == SAME
    supported = checked.where(~sure).join(facts.toDF("a", "fact"), "a").join(facts.toDF("b", "fact"), ["b", "fact"]).select("a", "b")
    edges = cut(checked.where(sure).select("a", "b").unionByName(supported).distinct())
    drop_cut(checked)
    return components(edges)


def group_listings(df: DataFrame, key: str = "product_id", title: str = "title", facts: tuple[str, ...] = (), makers: tuple[str, ...] = (), adverts: bool = False) -> DataFrame:
    """(id, name, numeric, group): listings with the group of their item.

    Listings without a title or key are in no group and left out; repeated rows of one listing count once; two titles
    of one key give it two rows. Equal names are one point of the index, so copies cost nothing; names of different
    spelling join through mutual neighbours, and through one-letter deletions where crowds of others are nearer, if
    their cosine allows (``judged``); listings of joined names are one group if number, kind, amount and the numbers
    inside their names agree too: a spelling that stands with another number still joins the others. Names between two
    cosines need a listing each that agree in one of the ``facts`` columns (null and empty ones agree with nothing). A
    numbered game's listings with two different subtitles are two items; one without a subtitle joins those with one if
    they have no other. Sellers' phrases are learned from the listings' facts (``seller_phrases``), makers' words from the
    ``makers`` columns (``maker_words``); ``adverts`` sets a short
    list of common ones aside as well, for tables too small to learn from. The group's id is a hash of the least hash of the joined names and of what must agree. An empty
    table gives no rows.
    """
    with freed_shuffles(df.sparkSession):
        learned = seller_phrases(df, title, list(facts)) if facts else frozenset()
        rows = named(df, key, title, list(facts), learned, adverts, maker_words(df, list(makers))).distinct()
        rows = cut(rows.withColumn("n", F.xxhash64("name")).withColumn("m", F.when(F.col("subtitle").isNotNull(), F.xxhash64("subtitle"))))
        names = rows.select("n", "name").unionByName(rows.where("m IS NOT NULL").select(F.col("m").alias("n"), F.col("subtitle").alias("name"))).dropDuplicates(["n"])
        label = cut(joined_names(names, rows.select("n", F.explode("facts").alias("fact")).distinct()))
        one = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        placed = rows.join(one("n"), "n", "left").join(one("m"), "m", "left").select("id", "name", "numeric", F.coalesce("_n", "n").alias("_g"), F.coalesce("_m", "m").alias("_s"))
        subtitles = placed.where("_s IS NOT NULL").groupBy("_g", "numeric").agg(F.when(F.min("_s") == F.max("_s"), F.min("_s")).alias("_only"))
        whole = placed.join(subtitles, ["_g", "numeric"], "left").withColumn("_s", F.coalesce("_s", "_only"))
        groups = cut(whole.select("id", "name", "numeric", F.xxhash64("_g", "numeric", "_s").alias("group")))
        drop_cut(rows, label)
        return groups


def same_item_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: listings of one group. Its rows are as many as the result is defined to have."""
    members = groups.select("id", "group").distinct()
    sizes = members.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1").select("group")
    members = members.join(sizes, "group")
    return members.select(F.col("id").alias("id_a"), "group").join(members.select(F.col("id").alias("id_b"), "group"), "group").where("id_a < id_b").select("id_a", "id_b").distinct()
