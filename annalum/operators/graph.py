"""Graphs of events: building edges, following them, telling stories along them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalum.functions import scores
from annalum.operators.joins import co_mention_pairs, first_columns, join_hot, near_between, near_pairs
from annalum.operators.pairs import between
from annalum.operators.windows import consecutive, top_n
from annalum.sources.shared import kept


FOLD, FIRST = 500_000, 4096


def _scored(edges: DataFrame, layer: str) -> DataFrame:
    """edges (a_id, b_id, a_year, b_year, sources, ...) with distance, direction and strength. Year 0 is a year."""
    distance = F.abs(F.col("b_year") - F.col("a_year"))
    return edges.withColumns({"distance": distance, "direction": scores.direction(F.col("a_year"), F.col("b_year")), "strength": F.round(scores.strength(layer, F.col("sources"), distance), 6)})


def causal_edges(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Every pair of events that share a source, with its strength. One plan: no query per pair."""
    dated = events.select("id", "date_start")
    pairs = co_mention_pairs(mentions)
    ends = pairs.join(dated.select(F.col("id").alias("a_id"), F.col("date_start").alias("a_year")), "a_id").join(dated.select(F.col("id").alias("b_id"), F.col("date_start").alias("b_year")), "b_id")
    return _scored(ends, "causal").select("a_id", "b_id", "sources", "distance", "direction", "strength")


def _person_steps(people: DataFrame, happened: DataFrame, events: DataFrame) -> DataFrame:
    """person_id, events, a_id, b_id, a_year, b_year: each person's consecutive events by date, and how many the person has.

    A source's pairs of a person and an event are many times its mentions. They are dealt by person once, with the event's
    date, and made distinct, counted and put in order where they are. people: source_id, person_id; happened: source_id, id.
    """
    dated = happened.join(events.select("id", "date_start", F.lit(True).alias("_known")), "id", "left")
    own = between(people, dated, ["source_id"], ["person_id"], ["id", "date_start", "_known"]).select("person_id", "id", "date_start", "_known")
    own = own.repartition("person_id").distinct().withColumn("events", F.count("*").over(W.partitionBy("person_id"))).filter("_known")
    w = W.partitionBy("person_id").orderBy("date_start", "id")
    steps = own.select("person_id", "events", F.col("id").alias("a_id"), F.lead("id").over(w).alias("b_id"), F.col("date_start").alias("a_year"), F.lead("date_start").over(w).alias("b_year"))
    return steps.filter("b_id is not null")


def person_chain_edges(person_mentions: DataFrame, event_mentions: DataFrame, events: DataFrame, of: int | None = None) -> DataFrame:
    """Consecutive events of a person's sources, by date; an edge that several people give stays with the one who has
    most events (the smallest id of equals).

    of: only the edges that stay with this person. Then only people are followed who have both events of an edge of theirs.
    """
    people = kept(person_mentions.select("source_id", F.col("entity_id").alias("person_id")).distinct(), "mentioned")
    happened = kept(event_mentions.select("source_id", F.col("entity_id").alias("id")).distinct(), "mentioned")
    edges = None
    if of is not None:
        near = lambda some: happened.join(some.select("source_id").distinct(), "source_id", "left_semi")
        own = people.filter(F.col("person_id") == of)
        edges = kept(_person_steps(own, near(own), events).select("a_id", "b_id"), "own-edges")
        ends = edges.select(F.col("a_id").alias("id")).union(edges.select("b_id")).distinct()
        who = kept(between(people, happened.join(ends, "id"), ["source_id"], ["person_id"], ["id"]).select("person_id", "id").distinct(), "who")
        both = who.withColumnRenamed("id", "a_id").join(edges, "a_id").join(who.withColumnRenamed("id", "b_id"), ["person_id", "b_id"])
        people = kept(people.join(both.select("person_id").distinct(), "person_id", "left_semi"), "mentioned")
        happened = near(people)
    steps = _person_steps(people, happened, events)
    steps = steps if edges is None else steps.join(edges, ["a_id", "b_id"], "left_semi")
    first = top_n(steps.repartition("a_id", "b_id"), ["a_id", "b_id"], [F.desc("events"), F.asc("person_id")], 1)
    first = first if of is None else first.filter(F.col("person_id") == of)
    return _scored(first.withColumn("sources", F.lit(1)), "person").select("person_id", "a_id", "b_id", "distance", "direction", "strength")


def location_chain_edges(events: DataFrame, least: int = 2, most_locations: int = 1000) -> DataFrame:
    """Consecutive events of a location by date; locations of most events first, `most_locations` of them."""
    placed = events.filter("location_id is not null")
    busy = placed.groupBy("location_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), F.asc("location_id")).limit(most_locations).select("location_id")
    steps = consecutive(placed.join(F.broadcast(busy), "location_id").select("location_id", "id", "date_start"), "location_id", ["date_start", "id"], ["id", "date_start"])
    edges = steps.select("location_id", F.col("id_a").alias("a_id"), F.col("id_b").alias("b_id"), F.col("date_start_a").alias("a_year"), F.col("date_start_b").alias("b_year"), F.lit(1).alias("sources"))
    return _scored(edges, "location").select("location_id", "a_id", "b_id", "distance", "direction", "strength")


def incident(edges: DataFrame, node: Column | int, way: str = "both") -> DataFrame:
    """Edges out of, into, or at a node, turned so that the node is a_id."""
    out = edges.filter(F.col("a_id") == node)
    into = edges.filter(F.col("b_id") == node).withColumns({"a_id": F.col("b_id"), "b_id": F.col("a_id")})
    return {"out": out, "in": into}.get(way) if way in ("out", "in") else out.unionByName(into)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"a_id": F.col("b_id"), "b_id": F.col("a_id")})).distinct()


def bfs(edges: DataFrame, start: int, depth: int, min_strength: float = 0.0, fan_out: int | None = 20, way: str = "both", limit: int | None = None) -> DataFrame:
    """node, depth of what can be reached from start: each node follows its strongest `fan_out` edges.

    way: out along edges, in against them, both. With a limit the walk ends at the depth that reaches it, and the nodes
    of least depth and then id stay. A layer is a filter of the edges.
    """
    strong = edges.filter(F.col("strength") >= min_strength).select("a_id", "b_id", "strength")
    turned = strong.withColumns({"a_id": F.col("b_id"), "b_id": F.col("a_id")})
    around = {"out": strong.distinct(), "in": turned.distinct()}[way] if way != "both" else both_ways(strong)
    if fan_out:
        around = top_n(around, ["a_id"], [F.desc("strength"), F.asc("b_id")], fan_out)
    around = kept(around.select(F.col("a_id").alias("node"), F.col("b_id").alias("next")))
    seen = front = kept(edges.sparkSession.createDataFrame([(start, 0)], "node long, depth int"))
    met = 1
    for d in range(1, depth + 1):
        front = kept(front.join(around, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        found = front.count()
        seen, met = seen.unionByName(front), met + found
        if not found or (limit and met >= limit):
            break
    return seen.orderBy("depth", "node").limit(limit) if limit else seen


def two_ways(edges: DataFrame, strength: float = 2.0, confidence: float = 0.5) -> DataFrame:
    """a_id, b_id both ways, each once, with fixed strength and confidence; no edge to itself."""
    plain = both_ways(edges.select("a_id", "b_id").filter("a_id <> b_id"))
    return plain.withColumns({"strength": F.lit(strength), "confidence": F.lit(confidence)})


def absorbed(pairs: DataFrame) -> DataFrame:
    """id, keep_id of what is absorbed when ids are taken in order and each one still there takes in its larger partners.

    pairs: a_id < b_id. An id without smaller undecided partners stays and its partners go; then those whose smaller
    partners all went stay, and so on, one round for each such step. keep_id is the smallest partner that stays.
    """
    each = now = kept(pairs.select("a_id", "b_id").distinct())
    gone = []
    while not now.isEmpty():
        stays = now.select("a_id").distinct().join(now.select(F.col("b_id").alias("a_id")), "a_id", "left_anti")
        hit = kept(now.join(stays, "a_id").select("b_id").distinct())
        gone.append(hit)
        now = kept(now.join(hit, "b_id", "left_anti").join(hit.withColumnRenamed("b_id", "a_id"), "a_id", "left_anti"))
    all_gone = reduce(DataFrame.unionByName, gone) if gone else each.select("b_id").limit(0)
    left = each.join(all_gone.withColumnRenamed("b_id", "a_id"), "a_id", "left_anti")
    return left.groupBy(F.col("b_id").alias("id")).agg(F.min("a_id").alias("keep_id"))


def greedy_places(rows: DataFrame, km: float = 500.0, first: int = FIRST) -> DataFrame:
    """id, seed of every row: in the order of ids, a row that no seed has taken is a seed and takes all others within km.

    Rows at one place always go together, so places are compared, not rows: a place stands under its smallest id. Places
    are decided in batches by id, the first of `first` places, each four times the one before: of what earlier seeds have
    left of a batch, absorbed() finds the seeds, and these take what they reach of the rest. What is left of a batch hardly
    has neighbours, unless ids follow places, so crowded places are not compared with one another. At last every place goes
    to the smallest seed within km. No group is a task of its own. Rows without a place, or with a coordinate of 0, are one
    batch, with a null seed. rows: id, latitude, longitude.
    """
    placed = rows.select("id", "latitude", "longitude").withColumn("_ok", F.coalesce((F.col("latitude") != 0) & (F.col("longitude") != 0), F.lit(False)))
    places = left = kept(placed.filter("_ok").groupBy("latitude", "longitude").agg(F.min("id").alias("id")), "places")
    found = []
    while n := left.count():
        last = left.select("id").orderBy("id").limit(first).agg(F.max("id")).first()[0] if n > first else None
        batch = kept(left.filter(F.col("id") <= last), "batch") if n > first else left
        taken = absorbed(near_pairs(batch, km).select("a_id", "b_id"))
        found.append(kept(batch.join(taken, "id", "left_anti"), "seeds"))
        if n <= first:
            break
        reached = near_between(found[-1], left.filter(F.col("id") > last), km).select(F.col("b_id").alias("id")).distinct()
        left, first = kept(left.filter(F.col("id") > last).join(reached, "id", "left_anti"), "places"), 4 * first
    seeds = reduce(DataFrame.unionByName, found) if found else places.limit(0)
    nearest = near_between(seeds, places, km).groupBy(F.col("b_id").alias("id")).agg(F.min("a_id").alias("seed"))
    of_place = places.join(nearest, "id").select("latitude", "longitude", "seed")
    out = placed.filter("_ok").join(of_place, ["latitude", "longitude"]).select("id", "seed")
    return out.unionByName(placed.filter("not _ok").select("id", F.lit(None).cast(out.schema["seed"].dataType).alias("seed")))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> (u, v): a star, to the smallest, of what each FOLD edges of a task connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(x, y)] = min(x, y)
        if len(root) >= FOLD:
            yield stars()
            root.clear()
    if root:
        yield stars()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that is connected).

    In a round each task replaces its own edges by stars, FOLD edges at a time; then large-star and small-star hang nodes
    lower. The smallest node of a component gathers edges from round to round: minima of nodes with over a 512th of the
    edges are broadcast (fewer than 512), so no task gets such a node's edges as a whole. Rounds end when nothing changes.
    """
    kind = edges.schema["a_id"].dataType.simpleString()
    long = edges.select(F.col("a_id").cast("long").alias("a"), F.col("b_id").cast("long").alias("b"))
    nodes = long.select(F.col("a").alias("node")).union(long.select("b")).distinct()
    summed = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    fold = lambda df: kept(df.mapInArrow(_folded, "u long, v long").distinct())

    def star(df: DataFrame, total: int) -> DataFrame:
        least = df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        return join_hot(df, least, ["u"], "k", total)

    now = fold(long.filter("a <> b"))
    state = summed(now)
    for _ in range(rounds):
        if not state[0]:
            break
        large = kept(star(now.union(now.select("v", "u")), 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = star(large, 2 * state[0])
        now, before = fold(small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select("v", "m")).distinct()), state
        state = summed(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    found = nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    return found.select(F.col("node").cast(kind).alias("node"), F.coalesce("root", "node").cast(kind).alias("component"))


def story_nodes(edges: DataFrame, events: DataFrame) -> DataFrame:
    """The distinct events at either end of edges, in order of date."""
    ends = edges.select(F.col("a_id").alias("id")).union(edges.select("b_id")).distinct()
    told = ends.join(events.select("id", "title", "date_start", "importance"), "id")
    return told.withColumn("kind", F.when(F.col("importance") >= 5, "major").otherwise("minor"))


def follow(successors: DataFrame, start: int, steps: int) -> DataFrame:
    """A causal chain: from start, each step to the smallest successor. successors: id, next_id. step, id."""
    one = kept(successors.groupBy("id").agg(F.min("next_id").alias("next_id")))
    now = edges = successors.sparkSession.createDataFrame([(0, start)], "step int, id long")
    for step in range(1, steps + 1):
        now = kept(now.join(one, "id").select(F.lit(step).alias("step"), F.col("next_id").alias("id")))
        if now.isEmpty():
            break
        edges = edges.unionByName(now)
    return edges


def link_edges(pages: DataFrame, people: DataFrame, events: DataFrame, places: DataFrame) -> DataFrame:
    """Edges from page links: a target is a person, else an event, else a place of that title. pages: id, links."""
    each = pages.select("id", F.explode(F.array_distinct("links")).alias("target"))
    tables = {"person": people, "event": events, "location": places}
    for kind, t in tables.items():
        each = each.join(t.groupBy(F.lower("name").alias(f"_{kind}")).agg(F.max("id").alias(f"{kind}_id")), F.lower("target") == F.col(f"_{kind}"), "left")
    kind = F.coalesce(*[F.when(F.col(f"{k}_id").isNotNull(), F.lit(k)) for k in tables])
    return each.select("id", "target", kind.alias("kind"), F.coalesce(*[F.col(f"{k}_id") for k in tables]).alias("target_id")).filter("kind is not null")


def typed_links(pages: DataFrame, names: DataFrame) -> DataFrame:
    """from_kind, from_id, to_kind, to_id of links between pages of people, events and places, each pair once.

    A link is to the person of that title, else the event, else the place; of one kind's equal titles the largest id. A
    person's links to people, events and places, an event's to people, events and places and a place's to people and
    events count; nobody links to itself. Pairs stand as person-person, event-event (the smaller id first), event-person,
    event-location and person-location. pages: kind, id, links; names: kind, id, name.
    """
    known = names.groupBy("kind", F.lower("name").alias("name")).agg(F.max("id").alias("id"))
    rank = F.when(F.col("kind") == "person", 0).when(F.col("kind") == "event", 1).otherwise(2)
    target = first_columns(known.withColumn("_r", rank), ["name"], ["_r"], ["kind", "id"]).select(F.col("name").alias("_link"), F.col("kind").alias("to_kind"), F.col("id").alias("to_id"))
    each = pages.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id"), F.explode(F.array_distinct(F.transform("links", F.lower))).alias("_link"))
    met = each.join(target, "_link").filter("not (from_kind = to_kind and (from_id = to_id or from_kind = 'location'))").drop("_link")
    order = lambda c: F.when(F.col(c) == "event", 0).when(F.col(c) == "person", 1).otherwise(2)
    turn = (order("from_kind") > order("to_kind")) | ((F.col("from_kind") == F.col("to_kind")) & (F.col("from_id") > F.col("to_id")))
    pick = lambda c: [F.when(turn, F.col(f"to_{c}")).otherwise(F.col(f"from_{c}")).alias(f"from_{c}"), F.when(turn, F.col(f"from_{c}")).otherwise(F.col(f"to_{c}")).alias(f"to_{c}")]
    return met.select(*pick("kind"), *pick("id")).distinct()


def follow_all(successors: DataFrame, seeds: DataFrame, steps: int = 10) -> DataFrame:
    """seed, segment, id: the causal chain of every seed, `steps` rows at most, each step to the smallest successor. A
    chain ends where there is none. One join a step for all seeds together. successors: id, next_id; seeds: id."""
    one = kept(successors.groupBy("id").agg(F.min("next_id").alias("next_id")))
    now = kept(seeds.select(F.col("id").alias("seed"), F.lit(1).alias("segment"), "id").distinct())
    told = [now]
    for step in range(2, steps + 1):
        now = kept(now.join(one, "id").select("seed", F.lit(step).alias("segment"), F.col("next_id").alias("id")))
        told.append(now)
    return reduce(DataFrame.unionByName, told)


def edges_without(edges: DataFrame, false_ids: DataFrame) -> DataFrame:
    """Edges neither end of which is listed."""
    ids = false_ids.select("id")
    return edges.join(ids.withColumnRenamed("id", "a_id"), "a_id", "left_anti").join(ids.withColumnRenamed("id", "b_id"), "b_id", "left_anti")
