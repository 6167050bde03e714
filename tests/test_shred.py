import json
import random

from pyspark.sql import functions as F

from caddis.operators.shred import game_objects, places, shred

SCHEMA = "envelope_id bigint, payload string, node_id int, ordinal int"


def walk(data):
    """Every listed object, by a plain walk."""
    out = set()

    def listed(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return []
        if isinstance(v, list):
            return list(enumerate(v))
        if isinstance(v, dict):
            return [(int(k), x) for k, x in v.items()] if v and all(k.isdigit() for k in v) else [(0, v)]
        return []

    for i, text in data:
        try:
            record = json.loads(text)
        except (TypeError, ValueError):
            continue
        if not isinstance(record, dict):
            continue
        games = list(record.get("games") or []) + [g for group in record.get("groups") or [] for g in group.get("games") or []]
        for at, game in enumerate(games):
            if not isinstance(game, dict):
                continue
            m, p = game.get("metacritic") or {}, game.get("playtime") or {}
            for kind, v in (("genre", m.get("genres")), ("platform", m.get("platforms")), ("run", p.get("runs"))):
                for pos, x in listed(v):
                    if isinstance(x, dict):
                        out.add((i, at, kind, -1, pos))
                        if kind == "platform":
                            out |= {(i, at, "review", pos, q) for q, y in listed(x.get("reviews")) if isinstance(y, dict)}
    return sorted(out)


def spelled(rng, items):
    form = rng.randrange(5)
    if form == 0:
        return json.dumps(items)
    if form == 1 and all(x is not None for x in items) and items:
        return {str(i): x for i, x in enumerate(items)}
    if form == 2 and len(items) == 1 and items[0]:
        return items[0]
    return items if form < 4 else None


def envelopes(rng, n):
    for i in range(n):
        games = []
        for _ in range(rng.randrange(4)):
            review = lambda: rng.choice([{"outlet": "a", "score": rng.randrange(3)}, None])
            platform = lambda: rng.choice([None, {"name": rng.choice("ab"), "reviews": spelled(rng, [review() for _ in range(rng.randrange(3))])}])
            m = rng.choice([None, {"score": 1, "genres": spelled(rng, [{"name": "x"}] * rng.randrange(3)), "platforms": spelled(rng, [platform() for _ in range(rng.randrange(3))])}])
            games.append(rng.choice([{"title": "t", "metacritic": m, "playtime": {"main": 1, "runs": spelled(rng, [{"kind": "main"}])}}, {"metacritic": m}, None]))
        body = {"games": games} if rng.random() < 0.5 else {"groups": [{"games": games[:1]}, {"games": []}, {"games": games[1:]}]}
        yield i, json.dumps(body)


def test_objects_equal_a_plain_walk(spark, rows):
    data = list(envelopes(random.Random(5), 120))
    data += [(500, None), (501, ""), (502, "{"), (503, "[1]"), (504, '"x"'), (505, '{"games": 3}'), (506, '{"games": [{"playtime": {"runs": NaN}}]}'), (507, "[" * 100_000), data[0]]
    data += [(508, json.dumps({"games": [{"title": "x" * 200_000, "metacritic": {"genres": [{"name": "g"}] * 300}}]}))]
    occurrences, bridges, nodes = shred(spark.createDataFrame([(i, t, 1, 2) for i, t in data], SCHEMA))
    found = game_objects(occurrences, bridges).select("envelope_id", "game_pos", "kind", "parent_pos", "pos")
    assert rows(found) == sorted(walk([x for x in data if x[0] not in (505, 506, 507)]), key=repr)
    assert nodes.count() == nodes.select("node_id").distinct().count()


def test_identical_objects_are_stored_once(spark, rows):
    game = {"title": "t", "metacritic": {"genres": [{"b": 1, "a": 2}, {"a": 2, "b": 1}]}}
    data = [(i, json.dumps({"games": [game, game]}), 0, 0) for i in range(50)]
    occurrences, bridges, nodes = shred(spark.createDataFrame(data, SCHEMA))
    assert rows(nodes.groupBy("kind").count()) == [("game", 1), ("genre", 1), ("metacritic", 1)]
    assert bridges.count() == 3 and occurrences.count() == 100
    assert game_objects(occurrences, bridges).where(F.col("kind") == "genre").count() == 200


def test_places_and_empty_table(spark):
    assert places('"[{}, null]"') == [(0, {}), (1, None)] and places({"2": 1, "0": None}) == [(0, None), (2, 1)] and places({}) == [(0, {})]
    assert places({"0": 1, "x": 2}) == [(0, {"0": 1, "x": 2})] and places(7) == [] and places("tbd") == []
    assert [df.count() for df in shred(spark.createDataFrame([], SCHEMA))] == [0, 0, 0]


def test_numbers_have_one_spelling(spark, rows):
    games = [{"title": "62", "metacritic": {"score": s}, "playtime": {"main": m}} for s, m in (("62", 1.5), (62, "1.5"), (62.0, 1.5), ("tbd", None))]
    _, _, nodes = shred(spark.createDataFrame([(1, json.dumps({"games": games}), 0, 0)], SCHEMA))
    assert rows(nodes.groupBy("kind").count()) == [("game", 2), ("metacritic", 2), ("playtime", 2)]
    assert rows(nodes.where("kind = 'game'").select("attributes").distinct()) == [('{"title":"62"}',)]
