"""All queries against all vectors: exact cosine distances, in blocks of a bounded number of rows.

Units are dealt to slices and queries to blocks; each slice meets each block in one task, which multiplies matrices and keeps
what may count.  Products are taken in another order than Spark's functions take them, so they only choose: whatever lies within SLACK of
what was chosen has its distance computed again, component by component, as `functions.vector.cosine_distance` does.
Rows that a matrix cannot hold (of other dimensions, with null, non-finite or extreme components) meet the others
in a plain join.  Pairs are as many as the question has; what is shuffled is each row once for each block of the other
side, and what each slice finds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcorpus.functions import vector as V

#: Units of a slice, queries of a block, and queries whose distances are held at once.
SLICE, BLOCK, HELD = 16_384, 16_384, 128
#: More than double precision loses in a product of unit vectors.
SLACK = 1e-9
#: Components beyond these, or below their inverse, could leave doubles when they are squared.
MOST = 1e100


def plain(vector: Column) -> Column:
    """Vectors of finite components whose squares are doubles as well."""
    some = lambda x: x.isNotNull() & ~F.isnan(x) & ((x == 0) | F.abs(x).between(1 / MOST, MOST))
    return F.coalesce(F.forall(V.doubles(vector), some) & (F.size(vector) > 0), F.lit(False))


@dataclass
class Sides:
    """Queries (query, q) and units (unit, v, and others) of one dimension, dealt to groups (slice, block); and pairs with the odd rows, if any."""

    units: DataFrame
    queries: DataFrame
    odd: DataFrame | None


def sides(queries: DataFrame, units: DataFrame, unit: str, vector: str, *others: str, carried: tuple = (), slice_: int | None = None, block: int | None = None) -> Sides:
    q = queries.filter(F.col("vector").isNotNull()).select("query", *carried, V.doubles(F.col("vector")).alias("q"))
    u = units.filter(F.col(vector).isNotNull()).select(F.col(unit).alias("unit"), *[F.col(c) for c in others], V.doubles(F.col(vector)).alias("v"))
    shape = lambda df, c, side: df.select(F.lit(side).alias("side"), plain(F.col(c)).alias("ok"), F.size(c).alias("n"))
    both = shape(u, "v", 0).unionByName(shape(q, "q", 1)).groupBy("ok", "n").agg(F.count_if(F.col("side") == 0).alias("units"), F.count_if(F.col("side") == 1).alias("queries"))
    kinds = both.orderBy(F.desc("ok"), F.desc("units"), F.desc("queries"), "n").limit(2).collect()  # the commonest dimension, and whether there is another kind
    if not kinds or not kinds[0]["ok"]:
        return Sides(*dealt(u.limit(0), q.limit(0), 1, 1), pairs(u, q))
    n = kinds[0]["n"]
    usual = lambda c: plain(F.col(c)) & (F.size(c) == n)
    odd = None
    if len(kinds) > 1:
        odd = pairs(u.filter(~usual("v")), q).unionByName(pairs(u.filter(usual("v")), q.filter(~usual("q"))))
        u, q = u.filter(usual("v")), q.filter(usual("q"))
    return Sides(*dealt(u, q, -(-kinds[0]["units"] // (slice_ or SLICE)) or 1, -(-kinds[0]["queries"] // (block or BLOCK)) or 1), odd)


def pairs(units: DataFrame, queries: DataFrame) -> DataFrame:
    return units.join(queries).withColumn("distance", V.cosine_distance(F.col("v"), F.col("q"))).drop("v", "q")


def dealt(units: DataFrame, queries: DataFrame, slices: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    u = units.withColumn("slice", F.pmod(F.xxhash64("unit"), F.lit(slices)).cast("int")).withColumn("block", each(blocks))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("slice", each(slices))
    return u, q


class Vectors:
    """Rows of a list column, with their lengths and unit vectors."""

    def __init__(self, column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) + 0.0  # -0.0 becomes 0.0
        square = np.zeros(len(self.x))
        for c in self.x.T:  # in the order in which Spark's function adds
            square += c * c
        self.size = np.sqrt(square)
        self.unit = self.x / np.where(self.size > 0, self.size, 1.0)[:, None]

    def take(self, at: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.x, out.size, out.unit = self.x[at], self.size[at], self.unit[at]
        return out


def exact(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """Cosine distances of rows i of a and j of b, to the last bit those of `cosine_distance`."""
    dot = np.zeros(len(i))
    for c, d in zip(a.x.T, b.x.T, strict=True):
        dot += c[i] * d[j]
    size = a.size[i] * b.size[j]
    return np.where(size == 0, 1.0, 1.0 - dot / np.where(size == 0, 1.0, size))


class Distinct:
    """Different vectors among rows that ascend by unit: one of each, how many copies it has, and where they are."""

    def __init__(self, rows: Vectors, at: np.ndarray):
        x = np.ascontiguousarray(rows.x[at])
        _, first, self.of_row, self.copies = np.unique(x.view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True, return_counts=True)
        self.vectors = rows.take(at[first])
        self.at = at[np.argsort(self.of_row, kind="stable")]
        self.begin = np.cumsum(self.copies) - self.copies
        self.rows = at

    def alone(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these rows are here without copies, and as which vectors."""
        place = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
        i = np.flatnonzero(self.rows[place] == rows)
        j = self.of_row[place[i]]
        return i[self.copies[j] == 1], j[self.copies[j] == 1]

    def upto(self, j: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where in `at` the copies of vectors j end that are before these rows."""
        most = int(self.at.max()) + 2
        keys = np.repeat(np.arange(len(self.copies)), self.copies) * most + self.at
        return np.searchsorted(keys, j * most + np.minimum(row, most - 1))


def nearest(queries: DataFrame, units: DataFrame, k: int, unit: str = "id", vector: str = "embedding", group: str | None = None, **sizes) -> DataFrame:
    """(query, group, unit, distance): of each slice of units, the k nearest each query, or of each group those; ties by unit.

    A superset of the k nearest of all, k rows a query, group and slice.
    """
    s = sides(queries, units, unit, vector, *[group] * bool(group), **sizes)
    fields = ["query", *[group] * bool(group), "unit"]
    kinds = {f.name: f.dataType.simpleString() for f in [*s.units.schema, *s.queries.schema]}

    def scan(key, rows, wanted):
        out = []
        if rows.num_rows and wanted.num_rows:
            rows = rows.sort_by("unit")
            x, q = Vectors(rows.column("v")), Vectors(wanted.column("q"))
            label = pc.dictionary_encode(rows.column(group).combine_chunks(), null_encoding="encode").indices.to_numpy() if group else np.zeros(rows.num_rows, np.int32)
            order = np.argsort(label, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                own = Distinct(x, at)
                for begin in range(0, len(q.x), HELD):
                    i, row, distance = of_block(own, q.take(np.arange(begin, min(begin + HELD, len(q.x)))))
                    out.append((i + begin, row, distance))
        i, row, distance = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        named = {"query": wanted.column("query").take(pa.array(i)), "unit": rows.column("unit").take(pa.array(row)), "distance": pa.array(distance)}
        if group:
            named[group] = rows.column(group).take(pa.array(row))
        return pa.table({c: named[c] for c in [*fields, "distance"]})

    def of_block(own: Distinct, q: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = 1.0 - q.unit @ own.vectors.unit.T
        most = min(k, d.shape[1])
        best = np.argpartition(d, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(d, best, axis=1)
        order = np.argsort(near, axis=1)
        near, copies = np.take_along_axis(near, order, axis=1), np.take_along_axis(own.copies[best], order, axis=1)
        last = np.minimum((np.cumsum(copies, axis=1) < k).sum(axis=1), most - 1)
        i, j = np.nonzero(d <= np.take_along_axis(near, last[:, None], axis=1) + SLACK)
        distance, many = exact(own.vectors, j, q, i), np.minimum(own.copies[j], k)
        i, distance = np.repeat(i, many), np.repeat(distance, many)
        row = own.at[np.arange(len(i)) + np.repeat(own.begin[j] - (np.cumsum(many) - many), many)]
        order = np.lexsort((row, distance, i))
        i, row, distance = i[order], row[order], distance[order]
        first = np.searchsorted(i, i)
        kept = np.arange(len(i)) - first < k
        return i[kept], row[kept], distance[kept]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in fields) + ", distance double"
    found = s.units.groupBy("slice", "block").cogroup(s.queries.groupBy("slice", "block")).applyInArrow(scan, schema)
    return found if s.odd is None else found.unionByName(s.odd.select(*fields, "distance"))


def within(queries: DataFrame, units: DataFrame, thresholds: tuple, unit: str = "id", vector: str = "embedding", **sizes) -> DataFrame:
    """(query, nearest, and a count for each threshold, c0, c1, ...): the least distance of other units than the query's own, and how many of them
    lie within each threshold.  Queries without any other unit have no row."""
    s = sides(queries, units, unit, vector, **sizes)
    counts = [f"c{i}" for i in range(len(thresholds))]

    def scan(key, rows, wanted):
        out = []
        if rows.num_rows and wanted.num_rows:
            rows = rows.sort_by("unit")
            own, q = Distinct(Vectors(rows.column("v")), np.arange(rows.num_rows)), Vectors(wanted.column("q"))
            mine = pc.index_in(wanted.column("query").cast(rows.column("unit").type), value_set=rows.column("unit")).to_numpy(zero_copy_only=False)
            for begin in range(0, len(q.x), HELD):
                some = np.arange(begin, min(begin + HELD, len(q.x)))
                out.append((some, *of_block(own, q.take(some), mine[some])))
        at, least, *within_ = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64)] * len(counts))
        kept = np.isfinite(least)
        return pa.table({"query": wanted.column("query").take(pa.array(at[kept])), "nearest": least[kept], **{c: n[kept].astype(np.int64) for c, n in zip(counts, within_, strict=True)}})

    def of_block(own: Distinct, q: Vectors, mine: np.ndarray) -> tuple:
        d, self_ = 1.0 - q.unit @ own.vectors.unit.T, np.full(len(q.x), -1)
        has = np.flatnonzero(~np.isnan(mine))
        self_[has] = own.of_row[mine[has].astype(np.int64)]
        alone = has[own.copies[self_[has]] == 1]
        d[alone, self_[alone]] = np.inf
        least = np.full(len(q.x), np.inf)
        i, j = np.nonzero(d <= np.minimum(d.min(axis=1), 3.0)[:, None] + SLACK)
        np.minimum.at(least, i, exact(own.vectors, j, q, i))
        i, j = np.nonzero(d <= max(thresholds) + SLACK)
        near, copies, out = d[i, j], own.copies[j] - (self_[i] == j), []
        for t in thresholds:
            doubt = np.flatnonzero(np.abs(near - t) <= SLACK)
            inside = near < t
            inside[doubt] = exact(own.vectors, j[doubt], q, i[doubt]) <= t
            out.append(np.bincount(i, weights=np.where(inside, copies, 0), minlength=len(least)).astype(np.int64))
        return least, *out

    kind = s.queries.schema["query"].dataType.simpleString()
    found = s.units.groupBy("slice", "block").cogroup(s.queries.groupBy("slice", "block")).applyInArrow(scan, f"query {kind}, nearest double, {', '.join(f'{c} long' for c in counts)}")
    if s.odd is not None:
        odd = s.odd.filter(F.col("query") != F.col("unit"))
        found = found.unionByName(odd.groupBy("query").agg(F.min("distance").alias("nearest"), *[F.count_if(F.col("distance") <= t).alias(c) for t, c in zip(thresholds, counts, strict=True)]))
    return found.groupBy("query").agg(F.min("nearest").alias("nearest"), *[F.sum(c).alias(c) for c in counts])


def nearest_alike(queries: DataFrame, units: DataFrame, like: str, unit: str = "id", vector: str = "embedding", **sizes) -> DataFrame:
    """(query, unit, distance): of each slice of units, the one nearest each query (query, vector, like) of those with the query's own value of
    `like`, but for the query itself; ties by unit.  Null is like nothing."""
    own_value = queries.filter(F.col(like).isNotNull()).select("query", "vector", F.col(like).alias("__like"))
    s = sides(own_value, units.filter(F.col(like).isNotNull()), unit, vector, like, carried=("__like",), **sizes)
    kinds = {f.name: f.dataType.simpleString() for f in [*s.units.schema, *s.queries.schema]}

    def scan(key, rows, wanted):
        out = []
        if rows.num_rows and wanted.num_rows:
            rows = rows.sort_by("unit")
            x, q, mine = Vectors(rows.column("v")), Vectors(wanted.column("q")), row_of(wanted.column("query"), rows.column("unit"))
            values = pc.unique(rows.column(like))
            label, asked = (pc.fill_null(pc.index_in(c, value_set=values), -1).to_numpy() for c in (rows.column(like), wanted.column("__like").cast(values.type)))
            for g in np.unique(asked[asked >= 0]):
                at, of = np.flatnonzero(label == g), np.flatnonzero(asked == g)
                own = Distinct(x, at)
                for begin in range(0, len(of), HELD):
                    some = of[begin : begin + HELD]
                    i, row, distance = of_block(own, q.take(some), mine[some])
                    out.append((some[i], row, distance))
        i, row, distance = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": wanted.column("query").take(pa.array(i)), "unit": rows.column("unit").take(pa.array(row)), "distance": pa.array(distance)})

    def of_block(own: Distinct, q: Vectors, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = 1.0 - q.unit @ own.vectors.unit.T
        i, j = own.alone(mine)
        d[i, j] = np.inf
        i, j = np.nonzero((d <= d.min(axis=1)[:, None] + SLACK) & (d < np.inf))
        distance, row = exact(own.vectors, j, q, i), own.at[own.begin[j]]
        self_ = np.flatnonzero(row == mine[i])
        row[self_] = own.at[own.begin[j[self_]] + 1]  # a copy of the query itself
        order = np.lexsort((row, distance, i))
        i, row, distance = i[order], row[order], distance[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        return i[first], row[first], distance[first]

    found = s.units.groupBy("slice", "block").cogroup(s.queries.groupBy("slice", "block")).applyInArrow(scan, f"query {kinds['query']}, unit {kinds['unit']}, distance double")
    if s.odd is not None:
        odd = s.odd.filter((F.col(like) == F.col("__like")) & (F.col("query") != F.col("unit")))
        found = found.unionByName(odd.select("query", "unit", "distance"))
    return found


def row_of(keys, units) -> np.ndarray:
    """Places of keys among units, -1 where they are not."""
    return pc.fill_null(pc.index_in(keys.cast(units.type), value_set=units), -1).to_numpy().astype(np.int64)


def before(queries: DataFrame, units: DataFrame, unit: str = "id", vector: str = "embedding", others: bool = False, **sizes) -> DataFrame:
    """(query, n): how many units come before (best, best_unit) of each query (query, vector, best, best_unit) by (distance, unit), those without
    a distance last; with `others` the query itself does not count.  No best is null.  Counts of 0 may be missing."""
    s = sides(queries, units, unit, vector, carried=("best", "best_unit"), **sizes)

    def scan(key, rows, wanted):
        n = np.zeros(wanted.num_rows, np.int64)
        if rows.num_rows and wanted.num_rows:
            rows = rows.sort_by("unit")
            ids, q = rows.column("unit"), Vectors(wanted.column("q"))
            own = Distinct(Vectors(rows.column("v")), np.arange(rows.num_rows))
            best = wanted.column("best").to_numpy()
            best = np.where(np.isnan(best), np.inf, best)  # after all numbers
            place = np.searchsorted(ids.to_numpy(zero_copy_only=False), wanted.column("best_unit").cast(ids.type).to_numpy(zero_copy_only=False))
            mine = row_of(wanted.column("query"), ids) if others else np.full(len(n), -1)
            for begin in range(0, len(n), HELD):
                some = np.arange(begin, min(begin + HELD, len(n)))
                n[some] = of_block(own, q.take(some), best[some], place[some], mine[some])
        return pa.table({"query": wanted.column("query"), "n": n})

    def of_block(own: Distinct, q: Vectors, best: np.ndarray, place: np.ndarray, mine: np.ndarray) -> np.ndarray:
        d = 1.0 - q.unit @ own.vectors.unit.T
        i, j = np.nonzero(np.abs(d - best[:, None]) <= SLACK)
        sure = d < best[:, None] - SLACK
        n = np.count_nonzero(sure, axis=1) if len(own.at) == len(own.copies) else (sure @ own.copies.astype(np.float64)).astype(np.int64)
        distance = exact(own.vectors, j, q, i)
        equal = own.begin[j] + own.copies[j]
        at = np.flatnonzero(distance == best[i])
        equal[at] = own.upto(j[at], place[i[at]])
        np.add.at(n, i, np.where(distance <= best[i], equal - own.begin[j], 0))
        has = np.flatnonzero(mine >= 0)
        self_ = exact(own.vectors, own.of_row[mine[has]], q, has)
        n[has] -= (self_ < best[has]) | ((self_ == best[has]) & (mine[has] < place[has]))
        return n

    kind = s.queries.schema["query"].dataType.simpleString()
    found = s.units.groupBy("slice", "block").cogroup(s.queries.groupBy("slice", "block")).applyInArrow(scan, f"query {kind}, n long")
    if s.odd is not None:
        odd = s.odd.filter(F.col("query") != F.col("unit")) if others else s.odd
        ahead = F.struct(F.isnull("distance"), "distance", "unit") < F.struct(F.lit(False), "best", "best_unit")
        found = found.unionByName(odd.filter(ahead).groupBy("query").agg(F.count("*").alias("n")))
    return found.groupBy("query").agg(F.sum("n").alias("n"))
