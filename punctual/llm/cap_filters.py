"""Near duplicates among embeddings by spherical-cap filters with structured random product codes.

1. ``vectors``: equal vectors become one node with its number of copies.
2. ``Codes``: directions are sums of one random unit code word for each block of dimensions, so a few hundred
   words make millions of directions. A vector is list-decoded to all directions whose cap it lies in:
   partial sums that cannot reach the bar any more are cut block by block. A few turns of the space
   have directions of their own.
3. ``_stars``: in each filter, vectors meet the node of the smallest id; those with a cosine of 0.95 make a star.
   Members within half the angle of a link around a star's mean are all linked to each other, as a ball, and need no
   pairs among themselves.
4. ``near_duplicates``: balls and single vectors that share a filter are verified. Angles and radii often
   settle that all members of two balls are linked, or none; what is left is verified vector by vector, in
   blocks of at most about ``TILE`` by ``TILE`` vectors.

Filters decide which pairs are looked at; every link is verified in double precision or follows from the
triangle inequality on the sphere.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.components import components
from punctual.llm.store import sent, stored

#: Least cosine of a link.
COSINE = 0.95
#: Turns of the space, each with directions of its own: those of one turn share words and so are met or missed together.
TURNS = 4
#: Caps of a turn that a vector lies in on average, and the best ones it goes to if it lies in fewer.
CAPS, LEAST = 4, 2
#: Vectors that a filter holds on average if they point anywhere: the number of directions grows with the vectors.
BUCKET = 4
#: Code words of a block, at most, and directions of a turn, at least.
WORDS, DIRECTIONS = 512, 1024
#: The highest bar: the cosine of the narrowest cap's angle.
WIDE = 0.85
#: Members whose mean is a star's centre, and vectors of a side of a block that is verified at once.
MEAN, TILE = 32, 256
#: Room for rounding of angles.
SLACK = 1e-7

_ANGLE = math.acos(COSINE)


def _differing(angle: float) -> int:
    """Signs of 64 random planes that two vectors at this angle differ in, plus five deviations and a half."""
    share = min(1.0, angle / math.pi)
    return min(64, math.ceil(64 * share + 5.5 * math.sqrt(64 * share * (1 - share))))


def _units(values: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


class ProductCode:
    """The directions of one turn of the space: a word for each block of dimensions, and the bar of their caps."""

    def __init__(self, dimension: int, vectors: int, number: int):
        draw = np.random.default_rng([dimension, vectors, number])
        # Turned at random, any vector spreads over the blocks like a random one.
        self.turn = np.linalg.qr(draw.standard_normal((dimension, dimension)))[0]
        sample = _units(draw.standard_normal((64, dimension)))
        directions = max(DIRECTIONS, CAPS * vectors // BUCKET)
        self._draw(directions, sample, draw)
        # In few dimensions caps would grow narrower than a link; then there are fewer and wider ones.
        while self.bar > WIDE and directions > CAPS:
            directions //= 2
            self._draw(directions, sample, draw)

    def _draw(self, directions: int, sample: np.ndarray, draw: np.random.Generator) -> None:
        dimension = len(self.turn)
        blocks = 1
        while math.ceil(directions ** (1 / blocks)) > WORDS and blocks < dimension:
            blocks += 1
        self.words = math.ceil(directions ** (1 / blocks))
        self.spans = [slice(int(x[0]), int(x[-1]) + 1) for x in np.array_split(np.arange(dimension), blocks)]
        self.codes = [_units(draw.standard_normal((self.words, x.stop - x.start))) / math.sqrt(blocks) for x in self.spans]
        products = self.products(sample)
        #: The bar that random vectors reach in ``CAPS`` directions.
        self.bar = float(np.mean([self.best([x[i] for x in products], CAPS)[0].min() for i in range(len(sample))]))

    def products(self, units: np.ndarray) -> list[np.ndarray]:
        turned = units @ self.turn
        return [turned[:, span] @ words.T for span, words in zip(self.spans, self.codes, strict=True)]

    def best(self, parts: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray]:
        """The directions of the greatest products: they consist of the best words of each block."""
        sums, index = np.zeros(1), np.zeros(1, np.int64)
        for part in parts:
            top = np.argsort(-part, kind="stable")[:count]
            whole = (sums[:, None] + part[top]).ravel()
            keep = np.argsort(-whole, kind="stable")[:count]
            sums, index = whole[keep], (index[:, None] * self.words + top).ravel()[keep]
        return sums, index

    def above(self, parts: list[np.ndarray]) -> np.ndarray:
        """All directions whose product is at the bar or above."""
        rest = np.cumsum([0.0, *(part.max() for part in parts[::-1])])[::-1][1:]
        sums, index = np.zeros(1), np.zeros(1, np.int64)
        for part, left in zip(parts, rest, strict=True):
            words = np.flatnonzero(part + sums.max(initial=-np.inf) >= self.bar - left)
            whole = sums[:, None] + part[words]
            row, column = np.nonzero(whole >= self.bar - left)
            sums, index = whole[row, column], index[row] * self.words + words[column]
            if not len(sums):
                break
        return index

    def directions(self, units: np.ndarray) -> Iterator[np.ndarray]:
        """Directions whose caps each vector lies in, and in any case the ``LEAST`` best ones."""
        products = self.products(units)
        for i in range(len(units)):
            parts = [x[i] for x in products]
            found = self.above(parts)
            yield found if len(found) >= LEAST else np.union1d(found, self.best(parts, LEAST)[1])


class Codes:
    """Filters and planes for vectors of one dimension; the same wherever they are made."""

    def __init__(self, dimension: int, vectors: int):
        self.turns = [ProductCode(dimension, vectors, number) for number in range(TURNS)]
        self.base = dimension << 46

    def filters(self, units: np.ndarray) -> Iterator[np.ndarray]:
        """Filters of each vector, told apart from those of other turns and dimensions."""
        for at in range(0, len(units), 1024):
            found = [turn.directions(units[at : at + 1024]) for turn in self.turns]
            for own in zip(*found, strict=True):
                yield np.concatenate([x * TURNS + number + self.base for number, x in enumerate(own)])


def _signs(units: np.ndarray, vectors: int) -> np.ndarray:
    """Sides of 64 random planes, the same for all vectors of a dimension, as the bits of a number."""
    planes = np.random.default_rng([units.shape[1], vectors]).standard_normal((units.shape[1], 64))
    return np.packbits(units @ planes > 0, axis=1).view(">i8").ravel().astype(np.int64)


class AllCodes(dict):
    """Codes by dimension, made when they are first asked for."""

    def __init__(self, counts: dict[int, int]):
        super().__init__()
        self.counts = counts

    def __missing__(self, dimension: int) -> Codes:
        codes = self[dimension] = Codes(dimension, self.counts[dimension])
        return codes


def _by_dimension(values: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of each dimension among the values."""
    sizes = np.array([len(x) for x in values])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _units(np.frombuffer(b"".join(values[i] for i in rows), kind).reshape(len(rows), -1))


def _valid(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            column = batch.column(1)
            for i in range(batch.num_rows):
                own = column[i].values if column[i].is_valid else None
                vector = None
                if own is not None and len(own) and not own.null_count:
                    # Adding zero makes the two zeros one.
                    vector = own.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)
                    vector = vector if np.isfinite(vector).all() and vector.any() else None
                values.append(None if vector is None else vector.tobytes())
                keys.append(None if vector is None else xxhash.xxh3_128_digest(values[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["vec_id", "key", "vector"]
            )

    return run


def vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Rows with the key of their vector, the distinct vectors with an ``id``, and their number format."""
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    source = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding")
    )
    rows = source.mapInArrow(_valid(kind), "vec_id long, key binary, vector binary")
    nodes = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    return rows.drop("vector"), nodes, kind


def _capped(codes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = AllCodes(pickle.loads(codes.value))
        for batch in batches:
            signs = np.zeros(batch.num_rows, np.int64)
            filters: list = [None] * batch.num_rows
            for rows, units in _by_dimension(batch.column(1).to_pylist(), kind):
                own = known[units.shape[1]]
                signs[rows] = _signs(units, known.counts[units.shape[1]])
                for row, found in zip(rows, own.filters(units), strict=True):
                    filters[row] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signs), pa.array(filters, pa.list_(pa.int64()))], names=["id", "signs", "filters"]
            )

    return run


def _cosines(kind: str):
    """The cosine of two vectors, ``left`` and ``right``, in place of them; -1 if their lengths differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(name).to_pylist() for name in ("left", "right"))
            sizes = [len(a) if len(a) == len(b) else 0 for a, b in zip(left, right, strict=True)]
            found = np.full(len(left), -1.0)
            for size in set(sizes) - {0}:
                rows = [i for i in range(len(left)) if sizes[i] == size]
                a, b = (_units(np.array([np.frombuffer(side[i], kind) for i in rows])) for side in (left, right))
                found[rows] = (a * b).sum(axis=1)
            rest = [name for name in batch.schema.names if name not in ("left", "right")]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in rest), pa.array(found)], names=[*rest, "cosine"])

    return run


def _with_cosine(pairs: DataFrame, kind: str) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in pairs.dtypes if name not in ("left", "right"))
    return pairs.mapInArrow(_cosines(kind), f"{schema}, cosine double")


def _angle(cosine: Column | str) -> Column:
    value = F.col(cosine) if isinstance(cosine, str) else cosine
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value)))


def _apart(a: str, b: str) -> Column:
    """Planes that lie between two vectors."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _stars(caps: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``id``, ``ball``: the least node of a shared filter that a node is linked with, itself included."""
    postings = caps.select("id", "signs", F.explode("filters").alias("filter"))
    hubs = postings.groupBy("filter").agg(F.min(F.struct("id", "signs")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = hubs.select("filter", F.col("hub.id").alias("ball"), F.col("hub.signs").alias("hub_signs"))
    met = postings.join(hubs, "filter").where((F.col("id") != F.col("ball")) & (_apart("signs", "hub_signs") <= _differing(_ANGLE)))
    met = met.select("id", "ball").distinct()
    pairs = met.join(nodes.select("id", F.col("vector").alias("left")), "id").join(
        nodes.select(F.col("id").alias("ball"), F.col("vector").alias("right")), "ball"
    )
    near = _with_cosine(pairs, kind).where(F.col("cosine") >= COSINE)
    arms = stored(near.groupBy("id").agg(F.min("ball").alias("ball")), "arms")
    hubs = arms.select("ball").distinct().join(arms.select(F.col("id").alias("ball")), "ball", "left_anti")
    return arms.unionByName(hubs.select(F.col("ball").alias("id"), "ball"))


def _mean(kind: str, codes):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        centre = _units(np.array([np.frombuffer(x, kind) for x in frame["vector"]])).sum(axis=0, keepdims=True)
        centre = _units(centre).astype(kind)
        signs = _signs(_units(centre), pickle.loads(codes.value)[centre.shape[1]])
        return pd.DataFrame([(key[0], signs[0], centre.tobytes())], columns=["ball", "signs", "centre"])

    return run


def _balls(stars: DataFrame, nodes: DataFrame, kind: str, codes) -> tuple[DataFrame, DataFrame]:
    """Members of balls (``id``, ``ball``, ``copies``) and the balls (``ball``, ``signs``, ``centre``, ``mass``, ``radius``)."""
    drawn = stars.select("ball", "id", F.xxhash64("id").alias("lot"))
    drawn = drawn.groupBy("ball", F.pmod("lot", F.lit(MEAN)).alias("lot")).agg(F.min("id").alias("id"))
    centres = drawn.select("ball", "id").join(nodes.select("id", "vector"), "id").groupBy("ball").applyInPandas(
        _mean(kind, codes), "ball long, signs long, centre binary"
    )
    centres = stored(centres, "centres")
    met = stars.join(nodes.select("id", "copies", F.col("vector").alias("left")), "id").join(
        centres.select("ball", F.col("centre").alias("right")), "ball"
    )
    members = _with_cosine(met, kind).withColumn("angle", _angle("cosine")).where(F.col("angle") <= _ANGLE / 2 - SLACK)
    members = stored(members.select("id", "ball", "copies", "angle"), "members")
    sizes = members.groupBy("ball").agg(F.sum("copies").alias("mass"), (F.max("angle") + SLACK).alias("radius"))
    return members, stored(centres.join(sizes, "ball"), "balls")


def _tiles(kind: str):
    """Links between the vectors of two blocks, summed for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, left, right in zip(*(batch.column(name).to_pylist() for name in ("a", "b", "left", "right")), strict=True):
                units = [_units(np.array([np.frombuffer(x["vector"], kind) for x in side])) for side in (left, right)]
                linked = units[0] @ units[1].T >= COSINE
                copies = [np.array([x["copies"] for x in side], np.int64) for side in (left, right)]
                counts = np.concatenate([linked @ copies[1], copies[0] @ linked])
                ids = np.array([x["id"] for side in (left, right) for x in side], np.int64)
                some = counts > 0
                n = int(some.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * n, pa.int64()), pa.array([b] * n, pa.int64()), pa.array(ids[some]), pa.array(counts[some])],
                    names=["a", "b", "id", "n"],
                )

    return run


def _settled(pairs: DataFrame, things: DataFrame, members: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Links of the vectors of two things each that angles and radii could not settle: ``a``, ``b``, ``id``, ``n``."""
    sides = pairs.select("a", "b", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("a").alias("own"), F.col("b").alias("other")),
        F.struct(F.lit(1).alias("side"), F.col("b").alias("own"), F.col("a").alias("other")),
    )).alias("x")).select("a", "b", "x.*")
    sides = sides.join(members.select(F.col("ball").alias("own"), "id"), "own", "left").withColumn("id", F.coalesce("id", "own"))
    sides = sides.join(nodes.select("id", "copies", F.col("vector").alias("left")), "id")
    other = things.select(F.col("thing").alias("other"), F.col("centre").alias("right"), "mass", "radius")
    sides = _with_cosine(sides.join(other, "other"), kind).withColumn("angle", _angle("cosine"))
    exact, angle, radius = F.col("radius") == 0, F.col("angle"), F.col("radius")
    state = (
        F.when(exact, F.when(F.col("cosine") >= COSINE, "all").otherwise("none"))
        .when(angle + radius <= _ANGLE - SLACK, "all").when(angle - radius > _ANGLE + SLACK, "none").otherwise("some")
    )
    sides = stored(sides.select("a", "b", "side", "id", "copies", "mass", state.alias("state")).where("state <> 'none'"), "sides")
    # Whoever is linked with all of the other side counts it whole; the rest counts those of the other
    # side that are linked with all of this one, and is verified against the others.
    whole = sides.where("state = 'all'").select("a", "b", "id", F.col("mass").alias("n"))
    every = sides.where("state = 'all'").groupBy("a", "b", (1 - F.col("side")).alias("side")).agg(F.sum("copies").alias("n"))
    some = sides.where("state = 'some'")
    part = some.join(every, ["a", "b", "side"]).select("a", "b", "id", "n")
    held = some.groupBy("a", "b", "side").agg(F.count("*").alias("held"))
    tiles = some.join(held, ["a", "b", "side"]).join(nodes.select("id", "vector"), "id")
    tiles = tiles.withColumn("tile", F.pmod(F.xxhash64("id"), F.ceil(F.col("held") / TILE))).groupBy("a", "b", "side", "tile").agg(
        F.collect_list(F.struct("id", "copies", "vector")).alias("held")
    )
    met = tiles.where("side = 0").select("a", "b", F.col("held").alias("left")).join(
        tiles.where("side = 1").select("a", "b", F.col("held").alias("right")), ["a", "b"]
    )
    return whole.unionByName(part).unionByName(met.mapInArrow(_tiles(kind), "a long, b long, id long, n long"))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Links are pairs of rows with a cosine of 0.95 or more, copies of one vector among them; ``n_links`` counts
    the other rows that a row is linked with. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are their own component; vectors of different
    lengths never link. Rows of one vec_id are separate rows. A null vec_id names a component only
    if all its ids are null; such a row is kept if its component has no id. An empty table
    gives no rows. Columns other than vec_id and embedding are not read.

    Links are found by filters, so one may be missed; measured on pairs at a cosine just over 0.95, fewer than 1 in 100
    is, and fewer at higher ones.
    """
    spark = embeddings.sparkSession
    rows, nodes, kind = vectors(embeddings)
    counts = nodes.groupBy((F.length("vector") / int(kind[2])).cast("int").alias("size")).agg(F.count("*").alias("n"))
    codes = sent(spark, {row["size"]: row["n"] for row in counts.toLocalIterator()})
    caps = stored(nodes.select("id", "vector").mapInArrow(_capped(codes, kind), "id long, signs long, filters array<long>"), "caps")
    members, balls = _balls(_stars(caps, nodes, kind), nodes, kind, codes)

    # A thing is a ball or a vector in none. Balls have ids of their own, beside those of the vectors.
    own = members.select("id", (-1 - F.col("ball")).alias("ball"))
    balls = balls.withColumn("ball", -1 - F.col("ball"))
    placed = caps.join(own, "id", "left").join(balls.select("ball", F.col("signs").alias("ball_signs")), "ball", "left")
    things = placed.select(F.coalesce("ball", "id").alias("thing"), F.coalesce("ball_signs", "signs").alias("signs"), "filters")
    held = things.select("thing", "signs", F.explode("filters").alias("filter"))
    held = held.where("thing >= 0").unionByName(held.where("thing < 0").distinct())
    several = (F.col("a") < 0).cast("int") + (F.col("b") < 0).cast("int")
    most = F.element_at(F.array(*(F.lit(_differing(_ANGLE * x)) for x in (1, 1.5, 2))), several + 1)
    pairs = held.select("filter", F.col("thing").alias("a"), F.col("signs").alias("x")).join(
        held.select("filter", F.col("thing").alias("b"), F.col("signs").alias("y")), "filter"
    ).where((F.col("a") < F.col("b")) & (_apart("x", "y") <= most)).select("a", "b").distinct()

    single = nodes.select(F.col("id").alias("thing"), F.col("vector").alias("centre"), F.col("copies").alias("mass"), F.lit(0.0).alias("radius"))
    info = single.unionByName(balls.select(F.col("ball").alias("thing"), "centre", "mass", "radius"))
    met = pairs.join(info.select(*(F.col(x).alias(y) for x, y in zip(info.columns, ("a", "left", "a_mass", "a_radius")))), "a").join(
        info.select(*(F.col(x).alias(y) for x, y in zip(info.columns, ("b", "right", "b_mass", "b_radius")))), "b"
    )
    radius = F.col("a_radius") + F.col("b_radius")
    met = _with_cosine(met, kind).withColumn("angle", _angle("cosine")).withColumn("state", (
        F.when(radius == 0, F.when(F.col("cosine") >= COSINE, "all").otherwise("none"))
        .when(F.col("angle") + radius <= _ANGLE - SLACK, "all").when(F.col("angle") - radius > _ANGLE + SLACK, "none").otherwise("some")
    ))
    met = stored(met.where("state <> 'none'").select("a", "b", "a_mass", "b_mass", "state"), "met")
    whole = met.where("state = 'all'")
    found = stored(_settled(met.where("state = 'some'").select("a", "b"), info, own, nodes, kind), "found")

    edges = whole.select("a", "b").unionByName(found.select("a", "b"))
    groups = stored(components(edges).withColumnRenamed("node", "thing"), "groups")
    each = whole.select(F.col("a").alias("thing"), F.col("b_mass").alias("n")).unionByName(
        whole.select(F.col("b").alias("thing"), F.col("a_mass").alias("n"))
    ).groupBy("thing").agg(F.sum("n").alias("whole"))
    some = found.groupBy("id").agg(F.sum("n").alias("some"))
    light = nodes.select("id", "key", "least", "copies").join(own, "id", "left").join(balls.select("ball", "mass"), "ball", "left")
    light = light.withColumn("thing", F.coalesce("ball", "id")).join(each, "thing", "left").join(some, "id", "left").join(groups, "thing", "left")
    light = stored(light.select(
        "key", "least", F.coalesce("root", "thing").alias("root"),
        (F.coalesce("mass", "copies") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("some", F.lit(0))).alias("n_links"),
    ), "linked")
    named = light.groupBy("root").agg(F.min("least").alias("component_id"))
    light = light.join(named, "root").select("key", "n_links", "component_id")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(light, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
