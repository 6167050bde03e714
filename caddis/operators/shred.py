"""Deeply nested records as related flat tables, by Merkle identities of subtrees.

Every object of a record gets an identity: the hash of its own scalar fields in canonical form together with the places
and identities of its child objects, computed from the leaves up. An object that occurs many times is stored once, as a
node; a bridge row (parent, kind, ordinal, child) keeps each place it holds below a parent, and an occurrence row keeps
each place a root object holds in an envelope. Bridge rows hang on the parent's identity, so a subtree that repeats is
bridged once, and all its occurrences follow from its parent's.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caddis.session import cut

EDGES = "root_id bigint, part string, parent_id string, kind string, ordinal int, node_id string, attributes string"


@dataclass(frozen=True)
class Child:
    """A field that holds child objects: ``many`` for a list in any spelling, else one object at place 0.

    ``numbers`` are the child's own fields that hold numbers, however they are spelled (62, 62.0, "62").
    """

    field: str
    kind: str
    many: bool = True
    children: tuple["Child", ...] = field(default_factory=tuple)
    numbers: tuple[str, ...] = ()


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """The JSON value of a text; ValueError if it isn't valid JSON (also NaN or Infinity, or nesting too deep to read)."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("too deep") from None


def places(value) -> list[tuple[int, object]]:
    """(place, entry) pairs of a list however it is spelled.

    A list gives its entries, null ones included, with their index; an object whose keys are all numbers gives its
    entries with their keys as places; any other object, an empty one too, is a lone entry at place 0; a text holding
    JSON is read first, as often as needed. Null, a missing list, a number, a flag and any other text give nothing.
    """
    while isinstance(value, str):
        try:
            value = parse(value)
        except ValueError:
            return []
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict):
        if value and all(k.isascii() and k.isdigit() and len(k) < 10 for k in value):
            return sorted((int(k), v) for k, v in value.items()) if len({int(k) for k in value}) == len(value) else [(int(k), v) for k, v in value.items()]
        return [(0, value)]
    return []


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _number(value):
    """A number in one spelling; what isn't one stays."""
    try:
        number = float(value) if isinstance(value, (str, int, float)) and not isinstance(value, bool) else math.nan
    except (ValueError, OverflowError):
        return value
    if not math.isfinite(number):
        return value
    return int(number) if number.is_integer() else number


class Shredder:
    """Turns records into edges; keeps what it has already emitted, to emit each node and bridge once per partition."""

    def __init__(self, children: tuple[Child, ...], limit: int = 200_000):
        self.children, self.limit, self.seen = children, limit, set()

    def node(self, value: dict, kind: str, children: tuple[Child, ...], out: list, numbers: tuple[str, ...] = ()) -> str:
        own, links = dict(value), []
        for name in numbers:
            if name in own:
                own[name] = _number(own[name])
        for child in children:
            inner = own.pop(child.field, None)
            for place, entry in places(inner) if child.many else ([(0, inner)] if isinstance(inner, dict) else []):
                if isinstance(entry, dict):
                    links.append((child.kind, place, self.node(entry, child.kind, child.children, out, child.numbers)))
        attributes = _canonical(own)
        identity = hashlib.blake2b(_canonical([kind, attributes, links]).encode(), digest_size=16).hexdigest()
        if identity not in self.seen:
            if len(self.seen) >= self.limit:  # what is forgotten is emitted again and made one by the distinct below
                self.seen.clear()
            self.seen.add(identity)
            out.append((None, "node", None, kind, None, identity, attributes))
            out.extend((None, "bridge", identity, k, place, n, None) for k, place, n in links)
        return identity

    def envelope(self, root_id, text: str | None) -> list:
        """Edges of one envelope: roots in ``games``, then in each of ``groups[].games``, in order."""
        try:
            record = parse(text)
        except ValueError:
            return []
        if not isinstance(record, dict):
            return []
        out: list = []
        base = 0
        lists = [record.get("games"), *(g.get("games") for _, g in places(record.get("groups")) if isinstance(g, dict))]
        for entries in map(places, lists):
            for place, game in entries:
                if isinstance(game, dict):
                    out.append((root_id, "root", None, "game", base + place, self.node(game, "game", self.children, out), None))
            base += max((p for p, _ in entries), default=-1) + 1
        return out


#: The shape of the game envelopes.
GAME_CHILDREN = (
    Child("metacritic", "metacritic", False, (Child("genres", "genre"), Child("platforms", "platform", True, (Child("reviews", "review", numbers=("score",)),))), ("score",)),
    Child("playtime", "playtime", False, (Child("runs", "run", numbers=("hours",)),), ("main", "extra", "complete")),
)


def shred(df: DataFrame, root_id: str = "envelope_id", payload: str = "payload", children: tuple[Child, ...] = GAME_CHILDREN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, bridges, nodes) of the objects in a JSON column.

    occurrences: root_id, ordinal, node_id; bridges: parent_id, kind, ordinal, node_id; nodes: node_id, kind, attributes
    (canonical JSON of the object's own fields). Each distinct row stands once: an envelope received twice adds
    nothing. Null, empty and invalid payloads, and payloads that aren't an object, give no rows; two payloads of one
    envelope id give the union of their objects. Rows without an id are kept under a null root_id. Extra columns are
    ignored. The edges are written once to the checkpoint folder and read by all three results.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in EDGES.split(", ")]
        shredder = Shredder(children)
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                rows = [r for i, t in zip(part["_id"], part["_p"]) for r in shredder.envelope(None if pd.isna(i) else int(i), t)]
                edges = pd.DataFrame(rows, columns=names)
                yield edges.astype({"root_id": "Int64", "ordinal": "Int32"})

    source = df.select(F.col(root_id).cast("bigint").alias("_id"), F.col(payload).alias("_p")).where(F.col("_p").isNotNull())
    edges = cut(source.mapInPandas(run, EDGES))
    occurrences = edges.where("part = 'root'").select("root_id", "ordinal", "node_id").distinct()
    bridges = edges.where("part = 'bridge'").select("parent_id", "kind", "ordinal", "node_id").distinct()
    nodes = edges.where("part = 'node'").select("node_id", "kind", "attributes").dropDuplicates(["node_id"])
    return occurrences, bridges, nodes


def game_objects(occurrences: DataFrame, bridges: DataFrame) -> DataFrame:
    """Every listed object of every game occurrence, rebuilt from occurrences and bridges.

    Returns envelope_id, game_pos, kind, parent_pos (the platform's place for a review, else -1), pos, node_id.
    Joins run on the parent's identity; AQE splits an identity that very many occurrences share.
    """
    games = occurrences.select(F.col("root_id").alias("envelope_id"), F.col("ordinal").alias("game_pos"), F.col("node_id").alias("_n"))
    holder = bridges.where("kind IN ('metacritic', 'playtime')").select(F.col("parent_id").alias("_n"), F.col("node_id").alias("_h"))
    listed = bridges.where("kind IN ('genre', 'platform', 'run')").select(F.col("parent_id").alias("_h"), "kind", F.col("ordinal").alias("pos"), "node_id")
    below = bridges.where("kind = 'review'").select(F.col("parent_id").alias("node_id"), F.col("kind").alias("_kind"), F.col("ordinal").alias("_pos"), F.col("node_id").alias("_child"))
    shape = holder.join(listed, "_h").drop("_h")  # one row per listed object of a distinct game
    reviews = shape.where("kind = 'platform'").join(below, "node_id").select("_n", F.col("_kind").alias("kind"), F.col("pos").alias("parent_pos"), F.col("_pos").alias("pos"), F.col("_child").alias("node_id"))
    own = shape.select("_n", "kind", F.lit(-1).alias("parent_pos"), "pos", "node_id")
    return games.join(own.unionByName(reviews), "_n").select("envelope_id", "game_pos", "kind", "parent_pos", "pos", "node_id")
