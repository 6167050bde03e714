from caddis.llm.entities import date_span, match_records, name_similarity, slip_keys

SCHEMA = "_id string, _title string, _date string, _genres array<string>, _dlc boolean, gap int"


def test_sequels_namesakes_addons_and_strangers(spark):
    names = ["Amo Gate", "Bel Tower", "Cor Lagoon", "Dunmarrow", "Eridu Fields", "Folk Harbour", "Gil Mountain", "Hollow Vale", "Iron Pasture", "Jade Cavern"]
    right, left = [], []
    for i, n in enumerate(names):
        right += [(f"s{i}", n, f"20{10 + i}-03-0{1 + i % 9}", ["Action"], False, 0), (f"s{i}-2", f"{n} II", f"20{12 + i}-05-01", ["Action"], False, 0), (f"s{i}-old", n, f"{1999 - i}-03-01", ["Action"], False, 0), (f"s{i}-dlc", f"{n} - Map Pack", f"20{10 + i}-06-01", ["Action"], True, 0)]
        left += [(f"p{i}", f"{n} (PC)", f"20{10 + i}-03-0{1 + i % 9}T00:00:00Z", ["Action"], False, 0), (f"q{i}", f"[Windows] {n[:3]}{n[4:]} 2", f"{2012 + i}", None, False, 0), (f"n{i}", f"{n} Soundtrack", f"20{10 + i}-03-01", ["Action"], False, 0)]
    left += [("x", "Another Thing", "2011-01-01", None, False, 0), ("y", None, None, None, False, 0), ("z", "", None, [], False, 0), ("w", "Amo Gate" + " very long" * 5000, None, None, False, 0)]
    matches = {r["l_id"]: (r["r_id"], r["confidence"]) for r in match_records(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()}
    for i in range(len(names)):
        assert matches[f"p{i}"][0] == f"s{i}" and 0.5 < matches[f"p{i}"][1] <= 1
        assert matches[f"q{i}"][0] == f"s{i}-2"
    assert len(matches) == 2 * len(names)
    empty = spark.createDataFrame([], SCHEMA)
    assert match_records(empty, spark.createDataFrame(right, SCHEMA)).count() == 0


def test_parts():
    assert date_span("Dec 02, 2013") == date_span("2013-12-02") == date_span("2013-12-02T00:00:00Z")
    assert date_span("2013")[1] - date_span("2013")[0] == 364 and date_span("TBA") is None and date_span(None) is None and date_span("2013-13-40") is None
    assert set(slip_keys("lantern")) & set(slip_keys("lantren")) and set(slip_keys("lantern")) & set(slip_keys("lanttern")) and not set(slip_keys("lantern")) & set(slip_keys("cavern"))
    assert name_similarity(["ab"], ["ab"]) == 1 and name_similarity(["abcd"], ["wxyz"]) == 0


def test_posteriors_are_exclusive_and_equal_a_plain_fit(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from caddis.llm import entities as E

    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        for j in range(int(rng.integers(1, 4))):
            good = j == 0 and i % 3
            vector = [round(float(v), 2) for v in (rng.uniform(0.9, 1, 3) if good else rng.uniform(0, 0.8, 3))]
            rows.append((f"l{i}", f"r{i}-{j}", f"r{i}-{j}", int(rng.integers(1, 3)), 1, vector[0], None if i % 7 == 0 else vector[1], vector[2], float(good > 0)))
    columns = ["l_sig", "r_sig", "r_id", "l_many", "r_many", *E.FEATURES]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns, ["string"] * 3 + ["bigint"] * 2 + ["double"] * 4)))
    got = {(r["l_sig"], r["r_sig"]): r["posterior"] for r in E.fit_posteriors(df).collect()}
    # the same, row by row in numpy
    x = np.array([[np.nan if v is None else v for v in r[5:]] for r in rows], float)
    w = np.array([r[3] * r[4] for r in rows], float)
    x = np.where(np.isnan(x), [np.nansum(x[:, k] * w) / w[~np.isnan(x[:, k])].sum() for k in range(4)], x)
    of = np.unique([r[0] for r in rows], return_inverse=True)[1]
    odds, last = np.where(x.mean(1) > 0.8, 2.0, -2.0), None

    def exclusive(o):
        e = np.exp(o)
        return e / (1 + np.bincount(of, e))[of]

    for _ in range(E.ROUNDS):
        p, parts = exclusive(odds), []
        for m in (p * w, (1 - p) * w):
            mean = m @ x / m.sum()
            c = (x * m[:, None]).T @ x / m.sum() - np.outer(mean, mean)
            parts.append((m.sum() / w.sum(), mean, 0.8 * c + 0.2 * np.diag(np.diag(c)) + E.RIDGE * np.eye(4)))
        density = lambda q: np.log(q[0]) - 0.5 * np.linalg.slogdet(q[2])[1] - 0.5 * np.einsum("ni,ij,nj->n", x - q[1], np.linalg.inv(q[2]), x - q[1])
        odds = density(parts[0]) - density(parts[1])
        now = np.concatenate([parts[0][1], parts[1][1]])
        if last is not None and abs(now - last).max() < 1e-3:
            break
        last = now
    want = exclusive(odds)
    assert all(abs(got[r[0], r[1]] - v) < 1e-6 for r, v in zip(rows, want))
    assert E.fit_posteriors(df.limit(0)).count() == 0
    assert E.fit_posteriors(df).groupBy("l_sig").agg(F.sum("posterior").alias("s")).where("s > 1.000001").count() == 0
