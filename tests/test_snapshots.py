from datetime import datetime as T

from caddis.operators.snapshots import snapshot_changes, validity_intervals

SCHEMA = "service string, snapshot_date string, product_id string, title string, tier int, platforms array<string>, loaded_at timestamp, key string, _s int"


def row(service, day, product, title="t", tier=None, platforms=("a",), loaded=1):
    return (service, day, product, title, tier, None if platforms is None else list(platforms), None if loaded is None else T(2025, 1, 1, 0, loaded), "extra", 7)


def brute(data):
    """Changes by comparing each snapshot with the one before, in plain Python."""
    out = []
    for s in {r[0] for r in data}:
        days = sorted({r[1] for r in data if r[0] == s and r[1] and r[2]})
        states = []
        for day in days:
            best = {}
            for r in data:
                if r[0] == s and r[1] == day and r[2] and (r[2] not in best or (r[6] or T.min) > (best[r[2]][6] or T.min)):
                    best[r[2]] = r
            states.append({k: (r[3], r[4], frozenset(r[5]) if r[5] is not None else None) for k, r in best.items()})
        for day, a, b in zip(days[1:], states, states[1:]):
            out += [(s, k, day, "added") for k in b.keys() - a.keys()] + [(s, k, day, "removed") for k in a.keys() - b.keys()]
            out += [(s, k, day, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    return sorted(out, key=repr)


def test_changes_equal_brute_force(spark, rows):
    data = [
        row("x", "2025-01-01", "p"), row("x", "2025-01-08", "p", "new"), row("x", "2025-01-22", "p", "new"), row("x", "2025-02-01", "p"),
        row("x", "2025-01-01", "q"), row("x", "2025-01-22", "q"), row("x", "2025-01-22", "q"),
        row("x", "2025-01-08", "r", platforms=("b", "a", "a")), row("x", "2025-01-22", "r", platforms=("a", "b")), row("x", "2025-02-01", "r", platforms=None),
        row("x", "2025-01-08", "s", tier=1), row("x", "2025-01-22", "s", None, 1), row("x", "2025-02-01", "s", None, None),
        row("x", "2025-01-22", "u", "old", loaded=1), row("x", "2025-01-22", "u", "late", loaded=9), row("x", "2025-02-01", "u", "late"), row("x", "2025-02-01", "u", "nullload", loaded=None),
        row("y", "2025-01-08", "p"), row("y", "2025-01-22", "p", "z"), row(None, "2025-01-01", "p"), row(None, "2025-01-02", "k"),
        row("y", "2025-01-22", None), row("y", None, "p", "lost"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(snapshot_changes(df)) == brute(data)


def test_interval_ends_and_empty_table(spark, rows):
    data = [row("x", "2025-01-01", "p"), row("x", "2025-01-08", "p"), row("x", "2025-01-15", "q")]
    spans = rows(validity_intervals(spark.createDataFrame(data, SCHEMA)).select("key", "first_date", "last_date", "next_date"))
    assert spans == [("p", "2025-01-01", "2025-01-08", "2025-01-15"), ("q", "2025-01-15", "2025-01-15", None)]
    assert rows(snapshot_changes(spark.createDataFrame([], SCHEMA))) == []


def test_a_key_with_a_third_of_all_rows(spark, rows):
    data = [row("x", "2025-01-01", "hot", loaded=i % 50) for i in range(300)] + [row("x", "2025-01-08", f"p{i}") for i in range(600)]
    found = snapshot_changes(spark.createDataFrame(data, SCHEMA)).groupBy("change").count()
    assert rows(found) == [("added", 600), ("removed", 1)]
