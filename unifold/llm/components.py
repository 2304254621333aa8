"""Connected components, and links within large groups, without collecting any of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

SMALL = 1_000_000  #: nodes that may be broadcast (16 MB); beyond, a shuffled join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the least node that each node of ``links`` reaches.

    Each round, every node joins the neighbour of least hash (or stays, if that is
    its own), goes on to where that one went, and links are redrawn between what
    nodes have joined; the rest is the same for the smaller table that is left. As
    the order is random, chains are short, and rounds grow with the logarithm of
    the nodes. Links are joined with labels once, then they are few; minima are
    taken before the shuffle, so hubs are no bottleneck. Every round is a written
    table. Nulls and self-links are ignored; an empty table gives an empty one.
    """
    spark = links.sparkSession
    x, y = F.col(a).alias("a"), F.col(b).alias("b")
    edges = storage.written(links.select(x, y).where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["v"].alias("c"))
        to = storage.written(to.select(F.col("a").alias("node"), "c"), "joined")
        for _ in range(2):
            gone, to = to, storage.written(to.join(to.select(F.col("node").alias("c"), F.col("c").alias("_n")), "c").select("node", F.col("_n").alias("c")), "joined")
            storage.drop(spark, gone)
        left, right = to.select(F.col("node").alias("a"), F.col("c").alias("_a")), to.select(F.col("node").alias("b"), F.col("c").alias("_b"))
        redrawn = edges.join(left, "a").join(right, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        gone, edges = edges, storage.written(redrawn, "edges")
        storage.drop(spark, gone)
        if labels is None:
            labels = to.select("node", F.col("c").alias("comp"))
        else:
            gone, labels = labels, storage.written(labels.join(to.withColumnsRenamed({"node": "comp"}), "comp", "left").select("node", F.coalesce("c", "comp").alias("comp")), "labels")
            storage.drop(spark, gone)
            storage.drop(spark, to)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    least = labels.groupBy("comp").agg(F.min("node").alias("_m"))
    out = storage.written(labels.join(least, "comp").select("node", F.least("_m", "comp").alias("comp")), "components")
    storage.drop(spark, labels)
    return out


def pick(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), one row for each of ``nodes`` (distinct): by a broadcast if they are few, else by a shuffled join."""
    if nodes.count() <= SMALL:
        nodes = F.broadcast(nodes)
    return df.join(nodes, "node", "left_semi").dropDuplicates(["node"])


ROUNDS = "one", "main", "rest"  #: who is compared with whom, see :func:`linked`


def linked(todo: DataFrame, attributes: tuple[str, ...], size: str, possible, compare, leaders: int = 1, distance=None, few_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, components) among nodes that share a key, without forming all pairs of large groups.

    ``todo`` is a written table with a row (h, node, c, attributes) for each key of each
    node; c is how many rows have the key. Pairs have columns a, b, and each attribute of both (na and nb for n);
    ``possible`` is a condition on these that every link meets for at least one
    of its keys, and that holds for no pair whose ``size`` differs by more than a
    quarter of the lesser. ``compare`` gets distinct possible pairs and returns
    those that link, as a written table.

    A round compares each node with at most one other, and what is one component
    by then is not compared any more. Nodes whose keys many others have come first:
    in a group of copies each with changes of its own, that is the text they
    come from, or one near to it, with which they link more often than with each other. In
    the round *one*, every key names ``leaders`` of its nodes for each step of size, and a node meets one of the
    leaders of its keys, that of the least ``distance`` (a cheap column on a pair), then the first. In
    the round *main*, a node outside the largest component of a key meets one of as many
    nodes of that component, chosen likewise. Last comes the exact round
    *rest*: under each key that still has several components, the nodes outside the largest are
    compared with all in other components, dealt by key and size, so that a key
    of many nodes is many tasks; where a node has ``few_keys`` (a bounded number), a pair is
    made under the least of its common keys only. So two nodes of a key are compared, connected,
    or impossible, and a group of copies costs rows in proportion to its size.
    """
    spark = todo.sparkSession
    attributes = (*attributes, "w")
    columns = ("node", "comp", *attributes)
    # Steps of 1.26: sizes that differ by a quarter at most are in one step or in two next to each other.
    step = F.floor(F.log(F.col(size).cast("double")) / math.log(1.26))
    weights = todo.groupBy("node").agg((-F.sum("c")).alias("w"))
    have = todo.join(weights, "node").select("h", "node", F.col("node").alias("comp"), *attributes)
    links, comps, mine = None, None, None

    def sided(rows: DataFrame, side: str, *more: str) -> DataFrame:
        return rows.select("h", F.col("node").alias(side), F.col("comp").alias("c" + side), *(F.col(z).alias(z + side) for z in attributes), *more)

    def ordered(found: DataFrame) -> DataFrame:
        swap = F.col("a") > F.col("b")
        sides = [("a", "b"), *((z + "a", z + "b") for z in attributes)]
        return found.select(*(F.when(swap, F.col(v)).otherwise(F.col(u)).alias(w) for m, n in sides for u, v, w in ((m, n, m), (n, m, n))))

    share = lambda: F.pmod(F.xxhash64(F.lit(number), "node"), F.lit(leaders)).alias("q")

    def first():
        """The node that comes first, with its columns."""
        return F.min(F.struct(F.col("w").alias("_w"), F.xxhash64(F.lit(number), "node").alias("_r"), *columns)).alias("t")

    for number, turn in enumerate(ROUNDS):
        apart = (F.col("ca") != F.col("cb")) & possible
        if turn == "one":
            top = have.groupBy("h", step.alias("k"), share()).agg(first()).select("h", "k", *(f"t.{c}" for c in columns))
            pairs = sided(have.withColumn("k", step), "a", "k").join(sided(top, "b", "k"), ["h", "k"]).where(apart)
        else:
            sizes = have.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"))
            main = sizes.groupBy("h").agg(F.max(F.struct("m", "comp")).alias("u")).select("h", F.col("u.comp").alias("_c"))
            if turn == "main":
                top = have.join(main, "h").where("comp = _c").groupBy("h", share()).agg(first()).select("h", *(f"t.{c}" for c in columns))
                pairs = sided(have, "a").join(sided(top, "b"), "h").where(apart)
            else:
                marked = have.join(main, "h").withColumn("minor", F.col("comp") != F.col("_c")).withColumn("k", step)
                own = apart & (~F.col("minor") | (F.col("a") < F.col("b")))
                more = ()
                if few_keys:
                    marked = marked.join(have.groupBy("node").agg(F.collect_set("h").alias("keys")), "node")
                    more, own = ("keys",), own & (F.col("h") == F.array_min(F.array_intersect("keysa", "keysb")))
                named = lambda rows, side: rows.withColumnsRenamed({z: z + side for z in more})  # noqa: B023, E731
                one = sided(named(marked.where("minor").withColumn("k", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1))), "a"), "a", "k", *(z + "a" for z in more))
                pairs = one.join(sided(named(marked, "b"), "b", "k", "minor", *(z + "b" for z in more)), ["h", "k"]).where(own)
        if turn != "rest":
            near = F.struct(F.lit(0) if distance is None else distance, F.col("wb").alias("_w"), F.xxhash64("b"), "b", *(z + y for y in "ba" for z in attributes))
            pairs = pairs.groupBy("a").agg(F.min(near).alias("t")).select("a", "t.b", *(f"t.{z}{y}" for y in "ba" for z in attributes))
        got = compare(ordered(pairs))
        links = got if links is None else links.union(got)
        # What is known already counts as one link for each node.
        new = components(got if comps is None else got.union(comps.select("node", "comp")))
        if comps is not None:
            storage.drop(spark, comps)
        comps = new
        if turn != "rest":
            again = have.drop("comp").join(comps, "node", "left").select("h", "node", F.coalesce("comp", "node").alias("comp"), *attributes)
            alive = again.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
            have = storage.written(again.join(alive, "h"), "shared-keys")
            if mine is not None:
                storage.drop(spark, mine)
            mine = have
            if have.isEmpty():
                break
    storage.drop(spark, mine)
    return links, comps
