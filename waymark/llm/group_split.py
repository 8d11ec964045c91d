"""Problem 2: splits that keep related records together.

Records and the values of their keys (a sequence, an author, an entity) are the two sides
of one graph; a record has an edge to each of its key values. Records with the same keys
and split are one node with a count, so the graph is as small as the distinct
combinations. Hash-to-min finds the components: every node sends its cluster to the
cluster's least node and that least node to the cluster, until nothing changes. Clusters
are rows, never arrays, so a component with a third of all keys is no single task's
burden. Weighted rendezvous hashing then gives every component its split, whatever its
size: adding records moves no component that wasn't merged with another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.sources.staging import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every end of the string edges ``u, v``.

    The component's name is its least node. Edges with a null end are left out, repeated
    edges change nothing, a loop makes a component of one.
    """
    kept = edges.where("u is not null and v is not null").select("u", "v").distinct()
    sides = F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("member")) for a in "uv" for b in "uv"])
    own = kept.select(F.inline(sides))
    clusters = stage(own.distinct(), "clusters")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first())

    before = state(clusters)
    for _ in range(max_rounds):
        least = clusters.groupBy("node").agg(F.min("member").alias("least"))
        sent = clusters.join(least, "node")
        sent = sent.select(F.explode(F.array(F.struct(F.col("least").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("m")).select("m.node", "m.member")
        clusters = stage(sent.distinct(), "clusters")
        after = state(clusters)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return clusters.groupBy("node").agg(F.min("member").alias("component"))


def key_groups(records: DataFrame, keys: list[str], split_col: str | None = None) -> DataFrame:
    """Records counted by key values (and split), with the component they lie in.

    Pre-aggregates before anything else; each combination is a node tied to every one of
    its key values, a null key ties to nothing. Returns the keys, ``split`` if named, ``n``
    and ``component``, which is named after its least key value (``0:`` and the value for
    the first key, ``1:`` for the second); records without any key have a null component.
    """
    columns = [F.col(k).cast("string").alias(k) for k in keys] + ([F.col(split_col).alias("split")] if split_col else [])
    of = [*keys, *(["split"] if split_col else [])]
    # Nothing but the braces of JSON starts a record's name, and digits sort before them.
    name = F.to_json(F.struct(*of), {"ignoreNullFields": "false"})
    groups = stage(records.select(*columns).groupBy(*of).agg(F.count("*").alias("n")).withColumn("record", name), "groups")
    edges = reduce(DataFrame.unionByName, [groups.where(F.col(k).isNotNull()).select(F.col("record").alias("u"), F.concat(F.lit(f"{i}:"), F.col(k)).alias("v")) for i, k in enumerate(keys)])
    found = components(edges).withColumnRenamed("node", "record")
    return groups.join(found, "record", "left").drop("record")


def torn_groups(records: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """Values of ``key`` whose records carry more than one non-null split: the torn components."""
    groups = key_groups(records, [key], split_col).where("component is not null")
    return groups.groupBy("component").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.min(key).alias(key)).where("low < high").select(key)


def _uniform(component: Column, name: Column, seed: Column) -> Column:
    """Number in (0, 1) from 52 bits of a digest, fixed by component, split name and seed."""
    digits = F.substring(F.md5(F.concat_ws("|", component, name, seed.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(component: Column, weights: dict[str, float], seed: Column | int = 0) -> Column:
    """Name of the split with the greatest weighted rendezvous score -w / ln(u)."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    scores = [F.struct((F.lit(float(w)) / -F.log(_uniform(component, F.lit(s), seed))).alias("score"), F.lit(s).alias("name")) for s, w in sorted(weights.items()) if w > 0]
    return F.array_max(F.array(*scores))["name"]


def _checked(proportions: dict[str, float]) -> dict[str, float]:
    if not proportions or min(proportions.values()) < 0 or sum(proportions.values()) <= 0:
        raise ValueError("proportions must be non-negative and not all zero")
    return {s: w / sum(proportions.values()) for s, w in proportions.items()}


def best_seed(groups: DataFrame, proportions: dict[str, float], tries: int = 128) -> int:
    """The seed from 0 to ``tries - 1`` whose rendezvous comes closest to the proportions, the least of equals.

    ``groups`` has ``component, n``. Every seed is a complete assignment of its own; few
    large components make most of them miss the shares. Keep the number with the dataset:
    with a fixed seed nothing moves as records are added.
    """
    wanted = _checked(proportions)
    sizes = groups.groupBy("component").agg(F.sum("n").alias("n"))
    tried = sizes.select("n", "component", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("seed"))
    rows = tried.groupBy("seed", rendezvous(F.col("component"), wanted, F.col("seed")).alias("split")).agg(F.sum("n").alias("n")).collect()  # tries x splits at most
    total = sum(r["n"] for r in rows) / tries
    got = {(r["seed"], r["split"]): r["n"] for r in rows}
    return min(range(tries), key=lambda i: (round(sum(abs(got.get((i, s), 0) - w * total) for s, w in wanted.items()), 6), i)) if rows else 0


def assign_splits(records: DataFrame, keys: list[str], proportions: dict[str, float], seed: int | None = None) -> DataFrame:
    """A split for every component such that none is torn.

    ``proportions`` are shares of records. Every component goes by weighted rendezvous
    hashing, so few move when splits are added and none when records are. Without a
    ``seed`` the one is taken that meets the proportions best. Returns the keys,
    ``component, n, split, seed``; records without any key form no group and are left out;
    an empty input gives no rows. How far the shares are missed, ``split_shares`` says.
    """
    wanted = _checked(proportions)
    groups = stage(key_groups(records, keys).where("component is not null"), "grouped")
    seed = best_seed(groups, wanted) if seed is None else seed
    return groups.select(*keys, "component", "n", rendezvous(F.col("component"), wanted, seed).alias("split"), F.lit(seed).alias("seed"))


def split_shares(assigned: DataFrame, proportions: dict[str, float]) -> DataFrame:
    """``split, n, share, wanted``: what every split got and should have, splits left empty included."""
    wanted = _checked(proportions)
    names = assigned.sparkSession.createDataFrame(sorted(wanted.items()), "split string, wanted double")
    got = assigned.groupBy("split").agg(F.sum("n").alias("n"))
    total = assigned.agg(F.sum("n")).scalar()
    return names.join(got, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") / total, F.lit(0.0)).alias("share"), "wanted")
