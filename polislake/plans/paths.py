"""Property paths as joins: from a bound end by frontiers, without one as a whole.

Relations are s, o and `keys` (the graph, where that is a variable). From a bound end only reached pairs move: a round goes a step ahead of the pairs
that the last one found (broadcast to the triples while they are few) and keeps those not seen before, so rounds grow with the length of the longest way. Without a bound
end the closure doubles its steps, and rounds grow with the logarithm of that length. Each round is written to the shared folder, so plans stay flat."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import drop, written
from .algebra import Path

#: Rows of pairs that are broadcast; rounds whose tables are read apart.
SMALL, TOGETHER = 100_000, 16
CLOSING = ("plus", "star")


def closes(path: Any) -> bool:
    """Whether a path holds a transitive closure."""
    return isinstance(path, Path) and (path.op in CLOSING or any(closes(a) for a in path.args))


def flip(path: Any) -> Any:
    """The path from its other end."""
    if isinstance(path, str):
        return Path("inverse", (path,))
    if path.op == "inverse":
        return path.args[0]
    args = tuple(flip(a) for a in path.args)
    return Path(path.op, args[::-1] if path.op == "sequence" else args)


class Paths:
    def __init__(self, triples: Callable[[str], DataFrame], nodes: Callable[[], DataFrame], keys: list[str]) -> None:
        """triples(predicate): s, o and keys; nodes(): s and keys of every term of the graph, distinct."""
        self.triples, self.nodes, self.keys = triples, nodes, keys

    def then(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.withColumnRenamed("o", "m").join(right.withColumnRenamed("s", "m"), [*self.keys, "m"]).select(*self.keys, "s", "o")

    def turned(self, df: DataFrame) -> DataFrame:
        return df.select(*self.keys, F.col("o").alias("s"), F.col("s").alias("o"))

    def same(self, nodes: DataFrame) -> DataFrame:
        return nodes.select(*self.keys, "s", F.col("s").alias("o"))

    # Without a bound end
    def pairs(self, path: Any) -> DataFrame:
        """All pairs that a path connects."""
        if isinstance(path, str):
            return self.triples(path).select(*self.keys, "s", "o")
        if path.op == "inverse":
            return self.turned(self.pairs(path.args[0]))
        if path.op == "sequence":
            return reduce(self.then, map(self.pairs, path.args))
        if path.op == "alternative":
            return reduce(DataFrame.unionByName, map(self.pairs, path.args))
        step = self.pairs(path.args[0]).distinct()
        found = step if path.op == "optional" else self.closure(step)
        return found if path.op == "plus" else found.unionByName(self.same(self.nodes())).distinct()

    def closure(self, step: DataFrame) -> DataFrame:
        """Walks of 2^k steps, alone and followed by the shorter ones found, until they connect no new pair."""
        spark = step.sparkSession
        found, path = written(step, "path")
        paths, power, last = [path], found, ""
        while True:
            power, at = written(self.then(power, power).distinct(), "power")
            new = power.unionByName(self.then(power, found)).distinct().join(found, [*self.keys, "s", "o"], "left_anti")
            new, path = written(new, "path")
            drop(spark, *filter(None, [last]))
            last = at
            if new.isEmpty():
                drop(spark, path, last)
                return found
            paths.append(path)
            found = spark.read.schema(step.schema).parquet(*paths)

    # From a bound end
    def reach(self, path: Any, seeds: DataFrame) -> DataFrame:
        """The pairs of a path whose s is among `seeds` (s and keys, distinct)."""
        if isinstance(path, str):
            return self.triples(path).select(*self.keys, "s", "o").join(seeds, [*self.keys, "s"], "left_semi")
        if path.op == "inverse":
            if isinstance(path.args[0], str):
                return self.turned(self.triples(path.args[0])).join(seeds, [*self.keys, "s"], "left_semi")
            return self.reach(flip(path.args[0]), seeds)
        if path.op == "sequence":
            out = self.reach(path.args[0], seeds)
            for a in path.args[1:]:
                out = self.then(out, self.reach(a, out.select(*self.keys, F.col("o").alias("s")).distinct()))
            return out
        if path.op == "alternative":
            return reduce(DataFrame.unionByName, [self.reach(a, seeds) for a in path.args])
        found = self.reach(path.args[0], seeds).distinct() if path.op == "optional" else self.frontiers(path.args[0], seeds)
        return found if path.op == "plus" else found.unionByName(self.same(seeds)).distinct()

    def ahead(self, pairs: DataFrame, path: Any, step: DataFrame | None) -> DataFrame:
        """A step further."""
        if step is None:
            step = self.reach(path, pairs.select(*self.keys, F.col("o").alias("s")).distinct())
        return self.then(pairs, step).distinct()

    def frontiers(self, path: Any, seeds: DataFrame) -> DataFrame:
        spark, pair = seeds.sparkSession, [*self.keys, "s", "o"]
        front, start = written(self.same(seeds), "seeds")
        rows, total, paths, schema = front.count(), 0, [], front.schema
        # The triples of a single predicate are read each round: once they are s and o alone.
        step = written(self.pairs(path), "step")[0] if isinstance(path, str) or path.op == "inverse" and isinstance(path.args[0], str) else None
        while True:
            new = self.ahead(_sized(front, rows), path, step)
            if paths:
                new = new.join(_sized(spark.read.schema(schema).parquet(*paths), total), pair, "left_anti")
            front, at = written(new, "reached")
            rows = front.count()
            if not rows:
                if not paths:
                    return front
                drop(spark, at, start)
                return spark.read.schema(schema).parquet(*paths)
            paths, total = [*paths, at], total + rows
            if len(paths) == TOGETHER:
                _, one = written(spark.read.schema(schema).parquet(*paths), "reached")
                front, last = written(front, "front")
                drop(spark, *paths, start)
                paths, start = [one], last


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A table of known size: to be broadcast if it is small."""
    return F.broadcast(df) if rows <= SMALL else df
