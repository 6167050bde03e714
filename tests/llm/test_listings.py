import numpy as np
import pytest
from pyspark.sql import functions as F

from caddis.llm import listings as L
from caddis.llm.titles import localized_name, parse_title

SCHEMA = "product_id string, title string, n int, name string"

SAME = [
    ("Velvet Harbor 2 (PS5)", "VELVET HARBOR™ II - Deluxe Edition"), ("Amo Gate: Distant Oath", "Distant Oath (Amo Gate) [PC]"), ("Amo Gate - 1,500 Coins", "1.5K Coins for Amo Gate Xbox One"),
    ("Amo Gate (24-Month Season Membership)", "Season Membership Amo Gate - 2 Years"), ("The Road of Ren", "Road of Ren – Save 40%"), ("AmoGate", "Amo Gate by Kilre Studio"), ("Amo Gate OST", "Amo Gate (Original Soundtrack)"), ("Amo Gate #3: Long Night", "Amo Gate III"),
]
OTHER = [("Amo Gate 2077", "Amo Gate 2078"), ("Amo Gate 1404", "Amo Gate 1503"), ("Civil War Lab", "Civil"), ("Velvet Harbor 2", "Velvet Harbor 3"), ("Amo Gate", "Amo Gate: Distant Oath"), ("Amo Gate 500 Coins", "Amo Gate 5000 Coins"), ("Amo Gate", "Amo Gate Soundtrack"), ("Amo Gate 500 Coins", "Amo Gate 500 Gems")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_item(a, b):
    x, y = parse_title(a), parse_title(b)
    assert x.numeric == y.numeric and L.judged(x.core, y.core, 0.9) == L.SAME


@pytest.mark.parametrize("a,b", OTHER)
def test_other_item(a, b):
    x, y = parse_title(a), parse_title(b)
    assert x.numeric != y.numeric or L.judged(x.core, y.core, 0.9) == L.OTHER


def test_short_names_a_letter_apart_need_facts(names):
    """One letter replaced in a short name is another name, unless other facts agree; a doubled one is a slip."""
    short = [("doom", "door"), ("fez", "rez"), ("hades", "fades"), ("ba", "bo")]
    long = [("covenantofpirothenzu", "covenantofpirrothenzu")]
    table = L.train_encoder(names + [n for p in short + long for n in p])
    cosine = lambda a, b: float(L.embed([a], table)[0] @ L.embed([b], table)[0])
    assert all(L.judged(a, b, cosine(a, b)) < L.SAME for a, b in short)
    assert all(L.judged(a, b, cosine(a, b)) == L.SAME for a, b in long)


def test_slips_equal_a_full_table():
    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = np.random.default_rng(3)
    for _ in range(400):
        a = "".join(rng.choice(list("abc"), rng.integers(0, 8)))
        b = L.spoil(a, rng).replace(" ", "") if a else ""
        for k in (1, 2):
            assert L.within_slips(a, b, k) == (distance(a, b) <= k)


@pytest.fixture(scope="module")
def names():
    rng = np.random.default_rng(5)
    syllables = ["ba", "do", "ki", "mur", "len", "sa", "tov", "ri", "pel", "ghu", "nes", "fi", "zor", "we"]
    kept = []
    for n in sorted({"".join(rng.choice(syllables, rng.integers(4, 7))) for _ in range(500)}):
        if not any(L.within_slips(n, k, 4) for k in kept):
            kept.append(n)
    return kept


def test_groups(spark, names):
    rng = np.random.default_rng(6)
    data, truth = [], {}
    for i, n in enumerate(names[:250]):
        for j, t in enumerate((f"{n} (PS5)", f"{n.upper()} - Deluxe Edition", n[:4] + n[5:], f"{n} 2")):
            data.append((f"{i:03d}-{j}", t, 1, "x"))
            truth[f"{i:03d}-{j}"] = (i, j == 3)
    data += [(f"hot{i}", names[0], 1, "x") for i in range(400)]  # a third of all rows share a title
    data += [("none", None, 1, "x"), ("blank", "  ", 1, "x"), (None, "Amo", 1, "x"), ("noise", "Deluxe Edition", 1, "x"), ("long", "amo " * 20_000, 1, "x"), data[0]]
    groups = L.group_listings(spark.createDataFrame(data, SCHEMA)).toPandas().drop_duplicates(["id", "group"])
    by = dict(zip(groups.id, groups.group))
    assert "none" not in by and "blank" not in by and "noise" in by and "long" in by
    right = [k for k in truth if by[k] == by[f"{truth[k][0]:03d}-{3 if truth[k][1] else 0}"]]
    assert len(right) / len(truth) > 0.98
    assert len({by[f"{i:03d}-0"] for i in range(250)} | {by[f"{i:03d}-3"] for i in range(250)}) >= 498
    assert by["hot7"] == by["000-0"]
    pairs = L.same_item_pairs(spark.createDataFrame([("b", 1), ("a", 1), ("c", 2), ("a", 1)], "id string, group bigint"))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]


def test_index_recall_and_every_row(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "n bigint, name string")
    vectors, c, probes, recall = L.build_index(df)
    assert vectors.count() == len(names) and recall >= 0.9
    v = {r["n"]: L._unit([bytes(r["vector"])])[0] for r in vectors.collect()}
    found = L.search(vectors, vectors, c, len(c), k=5, near=2.0, floor=-1.0).groupBy("q").agg(F.collect_set("n").alias("n")).collect()
    m = np.array([v[i] for i in range(len(names))])
    s = m @ m.T
    np.fill_diagonal(s, -2)
    hits = sum(len(set(r["n"]) & set(np.argsort(-s[r["q"]])[:5].tolist())) for r in found)
    assert hits / (5 * len(names)) >= 0.99
    assert L.search(vectors, vectors, c, probes).count() > 0


def test_empty_and_components(spark, rows):
    assert L.group_listings(spark.createDataFrame([], SCHEMA)).count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5)] + [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1100)], "a bigint, b bigint")
    chain = [(i, 100) for i in range(100, 401)] + [(i, 1000) for i in range(1000, 1100)]
    assert rows(L.components(edges)) == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (8, 8), (9, 8)] + chain, key=repr)
    assert L.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,cosine,verdict", [("nildengardrru", "niledngardru", 0.5, L.SAME), ("nildengardrru", "niledngardru", 0.4, L.PERHAPS), ("larogofa", "lorogofo", 0.7, L.PERHAPS), ("larogofa", "larogofo", 0.77, L.SAME), ("larogofa", "larogofo", 0.7, L.PERHAPS), ("amo", "oam", 0.2, L.OTHER), ("amogate", "ridupel", 0.99, L.OTHER), ("amo gate", "gate amo", -1.0, L.SAME)])
def test_the_cosine_decides_and_the_spelling_refuses(a, b, cosine, verdict):
    assert L.judged(a, b, cosine) == verdict == L.judged(b, a, cosine)


def test_subtitles_of_a_number(spark):
    data = [("a", "Amovelo 2: Long Night"), ("b", "Amovelo 2: Distant Oath"), ("c", "Amovelo II"), ("d", "Dorzika 3: Long Night"), ("e", "Dorzika 3"), ("f", "Dorzika III - Lonng Night (PC)")]
    by = {r["id"]: r["group"] for r in L.group_listings(spark.createDataFrame(data, "product_id string, title string")).collect()}
    assert len({by["a"], by["b"], by["c"]}) == 3 and by["d"] == by["e"] == by["f"]


def test_two_slips_without_shared_facts(spark):
    data = [("a", "Nilden Gardrru", None, None), ("b", "Niledn Gardru", "2015-03-04", None), ("c", "Larogofa", None, "x"), ("d", "Lorogofo", None, "y"), ("e", "Darkezomilofane", None, "z"), ("f", "Dirkezomilufane", None, "z")]
    groups = L.group_listings(spark.createDataFrame(data, "product_id string, title string, day string, zh string"), facts=("day", "zh"))
    by = {r["id"]: r["group"] for r in groups.collect()}
    assert by["a"] == by["b"] and by["c"] != by["d"] and by["e"] == by["f"]


def test_localized_names():
    assert localized_name("《黑曜王印》2 Xbox One 版") == localized_name("黑曜王印 II") == localized_name("黑曜王印2（Windows 版）") != localized_name("黑曜王印")
    assert localized_name(None) is None and localized_name(" ") is None


def test_hot_name_with_hundreds_of_spellings(spark):
    name = "mirevora"
    spellings = {name[:i] + c + name[i + j :] for i in range(9) for j in (0, 1) for c in "bcdfghklmnprstvz"} - {name}
    crowd = {f"mir{a}{b}evora{c}{a}" for a in "bdgklmnprst" for b in "aeiou" for c in "bdgklm"}
    data = [("right", name, "2019-05-01")] + [(s, s, "2019-05-01") for s in sorted(spellings)] + [(c, c, None) for c in sorted(crowd)]
    groups = L.group_listings(spark.createDataFrame(data, "product_id string, title string, day string"), facts=("day",))
    by = {r["id"]: r["group"] for r in groups.collect()}
    assert len(spellings) > 200 and {by[s] for s in spellings} == {by["right"]}
    found = spark.createDataFrame([(1, 2, 0.9, 1), (2, 3, 0.95, 1)], "q bigint, n bigint, cosine float, rank int")
    assert {tuple(r)[:2] for r in L.mutual_pairs(found, k=1).collect()} == {(1, 2), (2, 3)}


def test_a_spelling_with_another_number_bridges(spark):
    data = [("a", "Amovelo"), ("b", "Amovleoo"), ("c", "Aomveloo 2"), ("d", "Amoveloo 3"), ("e", "Amoveloo 2"), ("x", "Dorzikape"), ("y", "Drozikape"), ("z", "Dorzikap"), ("u", "Mrenelu"), ("v", "Mureneu"), ("w", "Murenelu 2")]
    by = {r["id"]: r["group"] for r in L.group_listings(spark.createDataFrame(data, "product_id string, title string")).collect()}
    assert by["a"] == by["b"] and by["u"] == by["v"]  # each two slips apart; the right spelling stands with a number only
    assert by["c"] == by["e"] and len({by[i] for i in "acdxuw"}) == 6 and by["x"] == by["y"] == by["z"]


def test_sellers_phrases_are_learned_and_subtitles_are_not(spark, names):
    data = []
    for i, n in enumerate(names[:60]):
        day = f"20{10 + i % 10}-0{1 + i % 9}-1{i % 9}"
        data.append((f"{i}a", n, day, f"名{i}"))
        data.append((f"{i}b", f"{n} - {('Seen On Stage', 'Hidden Oath', 'Grand Old Stock')[i % 3]}", day if i % 3 != 1 else f"2001-{1 + i % 9:02d}-{1 + i % 20:02d}", None))
    data += [("x", "  ", "2001-01-01", None), ("y", None, None, None), ("z", "Long " * 3000, None, "q"), data[0]]
    df = spark.createDataFrame(data, "product_id string, title string, day string, zh string")
    learned = L.seller_phrases(df, "title", ["day", "zh"])
    assert {"seen on stage", "grand old stock"} <= learned and not any("oath" in p for p in learned)
    by = {r["id"]: r["group"] for r in L.group_listings(df, facts=("day", "zh")).collect()}
    assert all((by[f"{i}a"] == by[f"{i}b"]) == (i % 3 != 1) for i in range(60))
    assert L.seller_phrases(df.limit(0), "title", ["day"]) == frozenset()


def test_makers_words_are_learned_from_their_columns(spark):
    data = [("a", f"{n} Kontor", None) for n in ("Amo", "Bel", "Cor")] + [("b", "Dun Kontor", "Eri Werk"), ("c", None, "Fen Werk"), ("d", "", "Solo"), ("e", "Amo Kontor", "Amo Werkstatt")]
    df = spark.createDataFrame(data, "product_id string, developer string, publisher string")
    assert L.maker_words(df, ["developer", "publisher"]) == ("kontor",) and L.maker_words(df, []) == ()
    assert parse_title("Kilre Kontor: Velvet Road", makers=("kontor",)).core == "velvetroad" != parse_title("Kilre Kontor: Velvet Road", makers=()).core


def test_leaves_no_files_but_its_result(spark, names, monkeypatch):
    """No step's shuffle files stay when it is done, nor checkpoints that nothing is yet to read; the setting for it doesn't either."""
    import time

    from caddis import session

    made, dropped = [], []
    folder = lambda df: df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    cut, drop = session.cut, session.drop_cut
    monkeypatch.setattr(L, "cut", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(L, "drop_cut", lambda *cuts: dropped.extend(map(folder, cuts)) or drop(*cuts))
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in manager.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    there = shuffles()
    data = [(f"{i}-{j}", t, 1, n) for i, n in enumerate(names[:60]) for j, t in enumerate((f"{n} (PS5)", n[:4] + n[5:]))]
    groups = L.group_listings(spark.createDataFrame(data, SCHEMA), facts=("name",))
    kept = {folder(df) for df in made} - set(dropped)
    assert len(made) > 10 and folder(groups) in kept and len(kept) <= 3  # the result, and the last edges and links
    fs = lambda path: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not any(fs(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs(p)) for p in dropped)
    until = time.time() + 20
    while shuffles() - there and time.time() < until:  # Spark removes them in the background
        time.sleep(0.2)
    assert not shuffles() - there
    assert spark.conf.get(session.FREE_SHUFFLES, None) is None
    assert groups.count() == len(data) and groups.groupBy("group").count().where("count = 2").count() > 50
