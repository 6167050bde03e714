import numpy as np

from caddis.llm import repetition as R

SCHEMA = "doc_id bigint, text string, id int, units string"
LINES = [f"the {a} of {b} stands beside the {c} in the year {n}" for n, (a, b, c) in enumerate(zip(["gate", "mill", "road", "pool", "fort"], ["Amo", "Bel", "Cor", "Dun", "Eri"], ["sea", "hill", "wood", "lake", "fen"]))]
CHINESE = "玩了九小时雨琴书终于延续那段嘈杂的天气。没有鱼琴田玉的音乐就不会优雅。"


def test_found_documents(spark, rows):
    plain = ". ".join(LINES)
    changed = ". ".join(x.replace("stands", w) for x, w in zip(LINES, ["lies", "sits", "is", "rests", "leans"]))
    data = [
        (1, plain), (2, plain + ".\n" + plain), (3, LINES[0] + "\n" + "so good, " * 60), (4, "\n".join(f"{i}) {LINES[0].upper() if i % 2 else LINES[0]}!" for i in range(6))),
        (5, CHINESE), (6, CHINESE + CHINESE), (7, "哈" * 40), (8, None), (9, ""), (10, "   \n\t"), (11, "?!..."), (12, plain + ". " + LINES[0]), (13, "gg"), (14, "go " * 50_000), (15, plain + ". " + changed),
    ]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in data], SCHEMA)
    assert {r[0] for r in rows(R.repetitive(df))} == {2, 3, 4, 6, 7, 14, 15}
    shares = {r["doc_id"]: r for r in R.repeated_share(df).collect()}
    assert shares[8]["share"] is None and shares[9]["share"] == 0.0 and shares[10]["units"] == 0 and abs(shares[2]["share"] - 0.5) < 0.05
    assert abs(shares[12]["share"] - 1 / 6) < 0.06
    assert R.repetitive(df.limit(0)).count() == 0
    assert rows(R.repetitive(df.where("doc_id = 2").union(df.where("doc_id = 2")))) == [(2,), (2,)]


def test_the_labels_decide(spark):
    """With every line labelled content nothing is found, with every line labelled repetition all texts with words."""
    df = spark.createDataFrame([(1, ". ".join(LINES), 0, ""), (2, ". ".join(LINES * 2), 0, ""), (3, "", 0, "")], SCHEMA)
    width = R.lines(["a b"]).features.shape[1]
    for label, found in ((0, []), (1, [1, 2])):
        weights = np.zeros((width, 2))
        weights[:, label] = 1
        shares = R.repeated_share(df, labeller=R.Labeller(weights, np.zeros((2, 2))))
        assert sorted(r["doc_id"] for r in shares.where("share > 0.34").collect()) == found


def test_held_out_accuracy():
    texts = R._invented(160, seed=99)
    labeller = R.fitted(R._invented(100, seed=7))
    right = total = 0
    for f, y in R._examples(texts, seed=5):
        right += (labeller.decode(f, np.arange(len(y)) == 0) == y).sum()
        total += len(y)
    assert right / total > 0.95


def test_runs_that_stood_before_equal_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        of = np.sort(rng.integers(0, 3, 40))
        code = R._mix(rng.integers(0, 3, 40).astype(np.uint64) + np.uint64(1))
        for length in (1, 2, 4):
            want = np.zeros(40, bool)
            for i in range(41 - length):
                if of[i] == of[i + length - 1] and any(of[j] == of[i] and (code[j : j + length] == code[i : i + length]).all() for j in range(i)):
                    want[i : i + length] = True
            assert (R._inside(code, of, R._mix(of.astype(np.uint64) + np.uint64(77)), length) == want).all()


def test_viterbi_equals_trying_all_labels():
    rng = np.random.default_rng(1)
    labeller = R.Labeller(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, 3))
    s = x @ labeller.weights
    best = max(np.ndindex(*[2] * 6), key=lambda y: sum(s[i, y[i]] for i in range(6)) + sum(labeller.transitions[a, b] for a, b in zip(y, y[1:])))
    assert tuple(labeller.decode(x, np.array([True] + [False] * 5)).astype(int)) == best
