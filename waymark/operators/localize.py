"""Coordinate estimates from result lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.geo import EARTH_RADIUS_M, haversine

#: Sharpness of the softmax weight.
TEMPERATURE = 20.0


def softmax_weight(temperature: float = TEMPERATURE) -> Column:
    """``exp(T * (sim - best sim of the query))``."""
    return F.exp(temperature * (F.col("sim") - F.max("sim").over(Window.partitionBy("query_id"))))


def top1(found: DataFrame) -> DataFrame:
    """L1: the first hit's coordinate and its error."""
    return found.where("rank = 1").select("query_id", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"), F.col("d_m").alias("error_m"))


def weighted_centroid(found: DataFrame, k: int = 10, temperature: float | None = None) -> DataFrame:
    """L2: weighted mean of the first ``k`` in a plane around the first hit.

    Weights are ``max(sim, 0)``, or the softmax weight if a temperature is given; lists
    whose weights are all zero fall back to the first hit.
    """
    rows = found.where(F.col("rank") <= k)
    first = rows.where("rank = 1").select("query_id", F.col("r_lat").alias("lat1"), F.col("r_lon").alias("lon1"))
    weight = F.greatest(F.col("sim"), F.lit(0.0)) if temperature is None else softmax_weight(temperature)
    rows = rows.withColumn("w", weight).join(first, "query_id")
    east = F.radians(F.pmod(F.col("r_lon") - F.col("lon1") + 180.0, F.lit(360.0)) - 180.0) * F.cos(F.radians("lat1")) * EARTH_RADIUS_M
    north = F.radians(F.col("r_lat") - F.col("lat1")) * EARTH_RADIUS_M
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c * F.col("w")), F.sum("w")), F.lit(0.0))
    out = rows.groupBy("query_id", "q_lat", "q_lon", "lat1", "lon1").agg(mean(east).alias("x"), mean(north).alias("y"))
    lat = F.col("lat1") + F.degrees(F.col("y") / EARTH_RADIUS_M)
    lon = F.col("lon1") + F.degrees(F.col("x") / (EARTH_RADIUS_M * F.cos(F.radians("lat1"))))
    return out.select("query_id", lat.alias("lat"), lon.alias("lon"), haversine("q_lat", "q_lon", lat, lon).alias("error_m"))


def cluster_labels(x: np.ndarray, y: np.ndarray, eps: float, min_samples: int = 2) -> np.ndarray:
    """L3: labels of density clusters in order of their first member, -1 for noise."""
    near = np.hypot(x[:, None] - x[None], y[:, None] - y[None]) <= eps
    core = near.sum(1) >= min_samples
    labels, found = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        queue = [i]
        labels[i] = found
        while queue:
            p = queue.pop()
            for j in np.flatnonzero(near[p] & (labels < 0)):
                labels[j] = found
                if core[j]:
                    queue.append(j)
        found += 1
    return labels


def clustered(found: DataFrame, k: int = 10, eps_m: float = 25.0, temperature: float = TEMPERATURE, gate: float = 0.7) -> DataFrame:
    """Estimates from the strongest cluster of the first ``k`` hits of each query.

    Returns per query the centroid of the group (``lat, lon``), its best-ranked member
    (``snap_lat, snap_lon``), the group's ``share`` of the weight, and ``gated``: whether
    that share reaches ``gate``, so that the centroid is to be trusted over the first hit.
    Groups of equal weight: the one whose first member ranks best. A list without a cluster
    keeps its first hit. Lists are short arrays, so whole batches of queries go to Python.
    """
    entry = F.struct("rank", "sim", "r_lat", "r_lon")
    lists = found.where(F.col("rank") <= k).groupBy("query_id", "q_lat", "q_lon").agg(F.sort_array(F.collect_list(entry)).alias("hits"))

    @F.pandas_udf("lat double, lon double, snap_lat double, snap_lon double, share double")
    def estimate(ranks: pd.Series, sims: pd.Series, lats: pd.Series, lons: pd.Series) -> pd.DataFrame:
        out = []
        for s, la, lo in zip(sims, lats, lons):
            s = np.nan_to_num(np.array(s, dtype=float), nan=-1.0)
            la, lo = np.array(la, dtype=float), np.array(lo, dtype=float)
            scale = np.cos(np.radians(la[0]))
            x = np.radians((lo - lo[0] + 180) % 360 - 180) * scale * EARTH_RADIUS_M
            y = np.radians(la - la[0]) * EARTH_RADIUS_M
            w = np.exp(temperature * (s - s.max()))
            labels = cluster_labels(x, y, eps_m)
            groups = [(w[labels == g].sum(), -g) for g in range(labels.max() + 1)]
            if not groups:
                out.append((la[0], lo[0], la[0], lo[0], 0.0))
                continue
            weight, g = max(groups)
            mine = np.flatnonzero(labels == -g)
            own = np.exp(temperature * (s[mine] - s[mine].max()))
            cx, cy = (x[mine] * own).sum() / own.sum(), (y[mine] * own).sum() / own.sum()
            out.append((la[0] + np.degrees(cy / EARTH_RADIUS_M), lo[0] + np.degrees(cx / (EARTH_RADIUS_M * scale)), la[mine[0]], lo[mine[0]], weight / w.sum()))
        return pd.DataFrame(out, columns=["lat", "lon", "snap_lat", "snap_lon", "share"])

    got = lists.select("query_id", "q_lat", "q_lon", F.col("hits")[0].alias("first"), estimate("hits.rank", "hits.sim", "hits.r_lat", "hits.r_lon").alias("e")).select("query_id", "q_lat", "q_lon", "first", "e.*")
    gated = F.col("share") >= gate
    glat, glon = F.when(gated, F.col("lat")).otherwise(F.col("first.r_lat")), F.when(gated, F.col("lon")).otherwise(F.col("first.r_lon"))
    return got.select(
        "query_id", "lat", "lon", "snap_lat", "snap_lon", "share", gated.alias("gated"),
        haversine("q_lat", "q_lon", "lat", "lon").alias("cluster_error_m"), haversine("q_lat", "q_lon", "snap_lat", "snap_lon").alias("snap_error_m"), haversine("q_lat", "q_lon", glat, glon).alias("gated_error_m"),
    )


def midpoint_baseline(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Error of always answering with the references' mean coordinate."""
    middle = references.agg(F.struct(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))).scalar()
    rows = queries.select(F.col("image_id").alias("query_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), middle.alias("middle"))
    return rows.select("query_id", haversine("q_lat", "q_lon", "middle.lat", "middle.lon").alias("error_m"))


def random_baseline(found_random: DataFrame) -> DataFrame:
    """Error of one random reference per query (``hits`` of a random ranking)."""
    return found_random.where("rank = 1").select("query_id", F.col("d_m").alias("error_m"))
