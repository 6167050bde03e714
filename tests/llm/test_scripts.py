import pytest

from caddis.llm.scripts import COMMON_LOOKS, consistent_form, icu, lookalike_pairs, with_consistent_form

SCHEMA = "id string, t string, _c string, a int"

SAME = [
    ("Ρeta Gil", "Peta Gil"), ("Ｄｅｎ （ＰＳ４）", "Den (PS4)"), ("café", "café"), ("a​b­", "ab"), ("a  b ", "a b"),
    ("XII", "Ⅻ"), ("ﬁn", "fin"), ("⽉光", "月光"), ("エ木", "工木"), ("рaу", "pay"), ("ό", "ó"), ("ё", "ë"), ("привет", "npивeт"),
]
# Alike by the public data, which the short list of common look-alikes does not hold.
SAME_BY_DATA = [("ɑbc", "abc"), ("ıce", "ice"), ("ꓮBC", "ABC"), ("ⲟne", "one"), ("a−b", "a-b"), ("日本ロード", "日本口一ド"), ("スーパー", "ス一パ一"), ("ЁЛΚA", "ЁЛКА"), ("ΓΛ", "ГЛ"), ("rock ʼn roll", "rock ’n roll")]
DIFFERENT = [
    ("cafe", "café"), ("Abc", "abc"), ("a b", "ab"), ("Road™", "RoadTM"), ("x2", "x²"), ("エビ", "クビ"), ("l", "I"), ("0", "O"), ("a-b", "a–b"), ("it's", "it’s"), ("Քar", "Kar"), ("Зара", "3apa"), ("第一", "第二"),
]


@pytest.fixture(scope="module")
def looks(spark):
    return icu(spark)


@pytest.mark.parametrize("a,b", SAME)
def test_alike(looks, a, b):
    assert consistent_form(a) == consistent_form(b)
    assert consistent_form(a, looks) == consistent_form(b, looks)


@pytest.mark.parametrize("a,b", SAME_BY_DATA)
def test_alike_by_the_public_data(looks, a, b):
    assert consistent_form(a, looks) == consistent_form(b, looks)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_not_alike(looks, a, b):
    assert consistent_form(a) != consistent_form(b)
    assert consistent_form(a, looks) != consistent_form(b, looks)


def test_words_of_one_script_keep_it(looks):
    for word in ("привет", "Зара", "Ωμέγα", "战地", "ロード", "ЁЛКА", "naïve", "Straße", "日本"):
        assert consistent_form(word, looks) == word


def test_resolved_script_sets(looks):
    assert COMMON_LOOKS.resolved("abm") == {"Latin"} and COMMON_LOOKS.resolved("mб") == frozenset() and "Jpan" in COMMON_LOOKS.resolved("エ木")
    assert {"Latin", "Cyrillic"} <= looks.resolved("рaу") and len(looks.look) > 1000


def test_the_form_is_its_own_form(looks):
    for a, b in SAME + SAME_BY_DATA + DIFFERENT:
        for t in (a, b):
            assert consistent_form(consistent_form(t)) == consistent_form(t)
            assert consistent_form(consistent_form(t, looks), looks) == consistent_form(t, looks)


def test_pairs_and_degenerate_rows(spark, rows):
    long = "Тhe " + "x" * 100_000
    data = [("b", "Peta", "z", 1), ("a", "Ρeta", "z", 1), ("a", "Ρeta", "z", 1), ("c", "Peta", "z", 1), ("d", None, None, None), (None, "Peta", "z", 1), ("e", "​ ", "z", 1), ("f", "", "z", 1), ("g", "  ", "z", 1), ("h", long, "z", 1), ("i", long.replace("Т", "T"), "z", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(lookalike_pairs(df, "id", "t")) == [("a", "b"), ("a", "c"), ("h", "i")]
    assert rows(lookalike_pairs(df.limit(0), "id", "t")) == []
    forms = {r["id"]: r["consistent"] for r in with_consistent_form(df, "t").collect()}
    assert forms["d"] is None and forms["e"] == "" and forms["a"] == "Peta"
