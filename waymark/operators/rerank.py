"""Re-ranking of result lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.operators import skew
from waymark.operators.quantiles import exact_quantiles
from waymark.sources.staging import stage


def reranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` counted anew per query in the given order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def sequence_window(rankings: DataFrame, positions: DataFrame, width: int, k: int = 10) -> DataFrame:
    """Sums of similarities over the lists of ``width`` frames before and after, weighted triangularly.

    ``positions`` has ``image_id, sequence_id, pos``. A join on sequence and position: each
    entry is sent to the 2 w + 1 frames it counts for, so no sequence is gathered. Queries
    without a sequence keep their own list.
    """
    frames = positions.where("sequence_id is not null").select(F.col("image_id").alias("query_id"), "sequence_id", "pos")
    offsets = F.explode(F.sequence(F.lit(-width), F.lit(width)))
    sent = rankings.join(frames, "query_id").select("sequence_id", "pos", "ref_id", "sim", offsets.alias("off"))
    sent = sent.select("sequence_id", (F.col("pos") + F.col("off")).alias("pos"), "ref_id", (F.col("sim") * (1 - F.abs("off") / (width + 1))).alias("part"))
    own = rankings.select("query_id").distinct().join(frames, "query_id")
    summed = sent.groupBy("sequence_id", "pos", "ref_id").agg(F.sum("part").alias("sim")).join(own, ["sequence_id", "pos"])
    alone = rankings.join(frames, "query_id", "left_anti").select("query_id", "ref_id", "sim")
    rows = summed.select("query_id", "ref_id", "sim").unionByName(alone)
    return reranked(rows, F.round("sim", 9).desc_nulls_last(), F.col("ref_id")).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "sim")


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)  # where nothing is possible the sum stays -inf
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _move(lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray, seconds: float, sigma: float, speed: float) -> np.ndarray:
    """Log weights of the transitions between the candidates of two frames."""
    phi, lam, to_phi, to_lam = np.radians(lat)[:, None], np.radians(lon)[:, None], np.radians(to_lat)[None], np.radians(to_lon)[None]
    h = np.sin((to_phi - phi) / 2) ** 2 + np.cos(phi) * np.cos(to_phi) * np.sin((to_lam - lam) / 2) ** 2
    d = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    return -np.abs(d - speed * seconds) / sigma


def _links(sim: np.ndarray, lat: np.ndarray, lon: np.ndarray, at_ms: np.ndarray, beta: float, sigma: float, speed: float) -> list[np.ndarray]:
    """For each frame but the first the log weights of coming to its candidates from those before."""
    seconds = np.diff(at_ms) / 1000.0
    return [_move(lat[i], lon[i], lat[i + 1], lon[i + 1], dt, sigma, speed) + beta * sim[i + 1] for i, dt in enumerate(seconds)]


def _sweep(start: np.ndarray, links: list[np.ndarray], gather) -> list[np.ndarray]:
    """Messages along a chain: each is the one before, joined with a link and gathered over the candidates left behind.

    ``gather`` is a sum or a maximum in logarithms; leading axes of ``start`` are swept side by side.
    """
    told = [start]
    for link in links:
        told.append(gather(told[-1][..., None] + link, -2))
    return told


def hmm_paths(sim: np.ndarray, lat: np.ndarray, lon: np.ndarray, at_ms: np.ndarray, beta: float, sigma: float, speed: float, outside: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (frames x candidates) and the best path of one drive, or of a block of it.

    Emissions are ``beta * sim``, transitions ``-|d - speed * dt| / sigma`` with the great-circle
    distance between candidates; absent candidates carry a similarity of -inf. ``outside``
    has what ``hmm_boundaries`` says about the rest of the drive. Messages run from both
    ends, as sums for the posteriors and as maxima for the path, which then goes forward
    along the greatest remainder.
    """
    k = sim.shape[1]
    links = _links(sim, lat, lon, at_ms, beta, sigma, speed)
    returning = [link.T for link in reversed(links)]
    enter, before, after, leave = beta * sim[0], beta * sim[0], np.zeros(k), np.zeros(k)
    if outside is not None:
        fill = lambda v: np.pad(np.asarray(v, dtype=float), (0, k - len(v)))
        before, enter, after = before + fill(outside["forward"]), enter + fill(outside["enter"]), fill(outside["backward"])
        leave = np.where(np.arange(k) == outside["leave"], 0.0, -np.inf)
    joint = np.stack(_sweep(before, links, _log_sum)) + np.stack(_sweep(after, returning, _log_sum)[::-1])
    remainder = _sweep(leave, returning, np.max)[::-1]
    path = [int((enter + remainder[0]).argmax())]
    for link, rest in zip(links, remainder[1:]):
        path.append(int((link[path[-1]] + rest).argmax()))
    return np.exp(joint - _log_sum(joint, 1)[:, None]), np.array(path)


def hmm_transfer(sim: np.ndarray, lat: np.ndarray, lon: np.ndarray, at_ms: np.ndarray, beta: float, sigma: float, speed: float) -> tuple[np.ndarray, np.ndarray]:
    """Log sum and maximum over all paths from each candidate of the first frame to each of the last.

    The first frame's emission is left out, all others count.
    """
    links = _links(sim, lat, lon, at_ms, beta, sigma, speed)
    each = np.where(np.eye(sim.shape[1], dtype=bool), 0.0, -np.inf)
    return _sweep(each, links, _log_sum)[-1], _sweep(each, links, np.max)[-1]


def hmm_boundaries(blocks: list[dict], sigma: float, speed: float) -> list[dict]:
    """What each block of a drive must know of the others, from the blocks' transfer matrices in order.

    ``forward`` and ``enter`` go to the candidates of its first frame: the log sum over all
    paths before it, and the step from the best path's candidate in the frame before.
    ``backward`` is the log sum over all paths after its last frame, by that frame's
    candidates, and ``leave`` the candidate there on the best path. Each vector of sums is
    shifted to a maximum of 0, which posteriors don't see.
    """
    steps = [_move(a["last_lat"], a["last_lon"], b["first_lat"], b["first_lon"], (b["first_at"] - a["last_at"]) / 1000.0, sigma, speed) for a, b in zip(blocks, blocks[1:])]
    out = [{"forward": np.zeros(len(b["first_lat"])), "enter": np.zeros(len(b["first_lat"])), "backward": np.zeros(len(b["last_lat"]))} for b in blocks]
    best, back = (blocks[0]["emit"][:, None] + blocks[0]["tops"]).max(0), []
    for i, step in enumerate(steps):
        here, b = blocks[i], blocks[i + 1]
        told = _log_sum((out[i]["forward"] + here["emit"])[:, None] + here["sums"], 0)
        forward = _log_sum(told[:, None] + step, 0)
        out[i + 1]["forward"] = forward - forward.max()
        through = ((step + b["emit"][None])[:, :, None] + b["tops"][None]).max(1)
        options = best[:, None] + through
        back.append(options.argmax(0))
        best = options.max(0)
    for i in range(len(steps) - 1, -1, -1):
        b = blocks[i + 1]
        told = _log_sum(b["sums"] + out[i + 1]["backward"][None], 1)
        backward = _log_sum(steps[i] + (b["emit"] + told)[None], 1)
        out[i]["backward"] = backward - backward.max()
    out[-1]["leave"] = int(best.argmax())
    for i in range(len(steps) - 1, -1, -1):
        out[i]["leave"] = int(back[i][out[i + 1]["leave"]])
        out[i + 1]["enter"] = steps[i][out[i]["leave"]]
    return out


def _lattice(drive: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows in order, their frames and places, and ``sim, lat, lon, at_ms`` as arrays."""
    drive = drive.assign(q_at=drive["q_at"].fillna(0)).sort_values(["q_at", "query_id", "rank"], kind="stable").reset_index(drop=True)
    frame = drive.groupby(["q_at", "query_id"], sort=True).ngroup().to_numpy()
    place = drive.groupby("query_id").cumcount().to_numpy()
    t, k = frame.max() + 1, place.max() + 1
    sim, lat, lon = np.full((t, k), -np.inf), np.zeros((t, k)), np.zeros((t, k))
    sim[frame, place], lat[frame, place], lon[frame, place] = drive["sim"].fillna(-1.0), drive["r_lat"], drive["r_lon"]
    at = np.zeros(t)
    at[frame] = drive["q_at"]
    return drive, frame, place, (sim, lat, lon, at)


def drive_speed(database: DataFrame, max_gap_s: float = 60.0, max_speed: float = 50.0) -> float:
    """Median speed in m/s from frame to frame of the sequences of ``database``, exactly.

    ``database`` has ``image_id, sequence_id, captured_at, lat, lon``. Longer gaps and
    greater speeds don't count; without any speed left there is nothing to estimate from.
    """
    steps = skew.frames(database.where("captured_at is not null").select("image_id", "sequence_id", "captured_at", "lat", "lon"))
    speeds = stage(steps.where((F.col("gap_ms") <= 1000 * max_gap_s) & (F.col("speed_ms") <= max_speed)).select("speed_ms"), "speeds")
    median = exact_quantiles(speeds, "speed_ms", [0.5])[0]
    if median is None:
        raise ValueError("no consecutive frames with a plausible speed; give the speed by hand")
    return median


_LINK = "chain string, block long, first_at double, first_lat array<double>, first_lon array<double>, emit array<double>, last_at double, last_lat array<double>, last_lon array<double>, sums array<double>, tops array<double>"
_BOUNDARY = "chain string, block long, forward array<double>, enter array<double>, backward array<double>, leave long"


def hmm_smoothing(found: DataFrame, positions: DataFrame, beta: float = 30.0, sigma: float = 25.0, speed: float = 8.0, max_frames: int = 2_000) -> DataFrame:
    """R2: lists re-ranked by the posterior of a hidden Markov model along each drive.

    ``found`` has ``query_id, rank, ref_id, sim, q_at, r_lat, r_lon``, ``positions`` the
    place of each image in its sequence (``image_id, sequence_id, pos``). A chain is all
    queries of a sequence; those without a sequence or time are chains of one. A task has
    the queries among ``max_frames`` consecutive frames, and a chain over several such
    blocks is exact all the same: each block is reduced to the sums and maxima over its
    paths (two matrices), these are composed along the chain, and every block then runs
    with the messages from both sides. What a task sees of a whole chain is two small
    matrices per block. Queries' own positions are never read; equal posteriors keep the
    search order.
    """
    seat = positions.where("sequence_id is not null").select(F.col("image_id").alias("query_id"), "sequence_id", "pos")
    rows = found.select("query_id", "rank", "ref_id", "sim", "q_at", "r_lat", "r_lon").join(seat, "query_id", "left")
    alone = F.col("sequence_id").isNull() | F.col("q_at").isNull()
    block = F.when(alone, F.lit(0)).otherwise(F.floor((F.col("pos") - 1) / max_frames)).cast("long")
    chain = F.when(alone, F.concat(F.lit("q:"), F.col("query_id").cast("string"))).otherwise(F.concat(F.lit("s:"), "sequence_id"))
    rows = stage(rows.withColumns({"chain": chain, "block": block}).drop("sequence_id", "pos"), "chains")
    cut = stage(rows.groupBy("chain").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("chain"), "cut")

    def smoothed(drive: pd.DataFrame, outside: dict | None) -> pd.DataFrame:
        drive, frame, place, lattice = _lattice(drive)
        posterior, path = hmm_paths(*lattice, beta, sigma, speed, outside)
        return pd.DataFrame({"query_id": drive["query_id"], "ref_id": drive["ref_id"], "old_rank": drive["rank"], "posterior": posterior[frame, place], "on_path": path[frame] == place})

    def link(part: pd.DataFrame) -> pd.DataFrame:
        drive, frame, _, (sim, lat, lon, at) = _lattice(part)
        sums, tops = hmm_transfer(sim, lat, lon, at, beta, sigma, speed)
        n, m = (frame == 0).sum(), (frame == frame[-1]).sum()
        cells = [at[0], lat[0, :n], lon[0, :n], beta * sim[0, :n], at[-1], lat[-1, :m], lon[-1, :m], sums[:n, :m].ravel(), tops[:n, :m].ravel()]
        return pd.DataFrame([[drive["chain"][0], drive["block"][0], *cells]], columns=[c.split()[0] for c in _LINK.split(", ")])

    def bound(links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values("block")
        blocks = links.to_dict("records")
        for b in blocks:
            b["sums"], b["tops"] = (np.asarray(b[c]).reshape(len(b["first_lat"]), -1) for c in ("sums", "tops"))
        out = pd.DataFrame(hmm_boundaries(blocks, sigma, speed))
        return out.assign(chain=links["chain"].to_numpy(), block=links["block"].to_numpy())[[c.split()[0] for c in _BOUNDARY.split(", ")]]

    def whole_drive(drive: pd.DataFrame) -> pd.DataFrame:
        return smoothed(drive, None)

    def piece(drive: pd.DataFrame, boundary: pd.DataFrame) -> pd.DataFrame:
        return smoothed(drive, boundary.iloc[0].to_dict())

    schema = "query_id long, ref_id long, old_rank long, posterior double, on_path boolean"
    whole = rows.join(cut, "chain", "left_anti").groupBy("chain").applyInPandas(whole_drive, schema)
    pieces = rows.join(cut, "chain").select(rows.columns)
    bounds = pieces.groupBy("chain", "block").applyInPandas(link, _LINK).groupBy("chain").applyInPandas(bound, _BOUNDARY)
    parts = pieces.groupBy("chain", "block").cogroup(bounds.groupBy("chain", "block")).applyInPandas(piece, schema)
    return reranked(whole.unionByName(parts), F.col("posterior").desc(), F.col("old_rank")).select("query_id", "rank", "ref_id", "posterior", "on_path")


def twins_last(found: DataFrame, is_twin: Column) -> DataFrame:
    """Twins move to the end of the list, order is kept otherwise."""
    return reranked(found.withColumn("is_twin", is_twin), F.col("is_twin"), F.col("rank"))


def verified_first(found: DataFrame, inliers: Column, k: int, least: int) -> DataFrame:
    """Among the first ``k`` the entries with at least ``least`` inliers come first, most inliers first.

    The rest of the first ``k`` follow in the old order, later entries don't move, and an
    entry without a count is unverified.
    """
    n = F.coalesce(inliers, F.lit(0))
    head = F.when(F.col("rank") <= k, F.when(n >= least, F.lit(0)).otherwise(F.lit(1))).otherwise(F.lit(2))
    return reranked(found, head, F.when(head == 0, -n), F.col("rank"))


def z_score(value: str) -> Column:
    """Value within its query, 0 where all are equal; nulls stay null and don't count."""
    w = Window.partitionBy("query_id")
    spread = F.stddev_pop(value).over(w)
    return F.when(F.col(value).isNotNull(), F.when(spread > 0, (F.col(value) - F.avg(value).over(w)) / spread).otherwise(F.lit(0.0)))


def fused_first(candidates: DataFrame, weights: Sequence[float]) -> DataFrame:
    """First hit per query and weight of ``z(sim) + weight * z(det)``.

    A missing detection score counts as the mean of those present, hence as 0, and a query
    without any as 0 throughout. Ties keep the search order.
    """
    rows = candidates.withColumn("zs", F.coalesce(z_score("sim"), F.lit(0.0))).withColumn("zd", F.coalesce(z_score("det"), F.lit(0.0)))
    best = [F.max_by(F.struct("ref_id", "d_m"), F.struct(F.round(F.col("zs") + w * F.col("zd"), 9).alias("s"), (-F.col("rank")).alias("r"))).alias(f"w{i}") for i, w in enumerate(weights)]
    wide = rows.groupBy("query_id").agg(*best)
    cells = [F.struct(F.lit(float(w)).alias("weight"), F.col(f"w{i}.ref_id").alias("ref_id"), F.col(f"w{i}.d_m").alias("d_m")) for i, w in enumerate(weights)]
    return wide.select("query_id", F.inline(F.array(*cells)))


def mixed_queries(found: DataFrame, correct: Column, k: int) -> DataFrame:
    """Queries with a right and a wrong candidate among the first ``k``."""
    return found.where(F.col("rank") <= k).groupBy("query_id").agg(F.bool_or(correct).alias("any_right"), F.bool_or(~correct).alias("any_wrong")).where("any_right and any_wrong").select("query_id")


def histogram_vectors(detections: DataFrame, key: str = "image_id", skip_prefix: str | None = None) -> DataFrame:
    """``<key>, class, weight``: ``sqrt(count) * idf``, L2-normalised per image, ``idf = ln(n / df) + 1``.

    ``detections`` has a ``map<string,int>`` column ``counts``; classes that start with
    ``skip_prefix`` and non-positive counts are left out.
    """
    rows = detections.select(key, F.explode("counts").alias("class", "count")).where("count > 0")
    if skip_prefix:
        rows = rows.where(~F.startswith("class", F.lit(skip_prefix)))
    n = detections.agg(F.count("*")).scalar()
    df = rows.groupBy("class").agg(F.countDistinct(key).alias("df")).withColumn("n_images", n)
    weighted = rows.join(df, "class").select(key, "class", (F.sqrt("count") * (F.log(F.col("n_images") / F.col("df")) + 1)).alias("w"))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, key).select(key, "class", (F.col("w") / F.col("norm")).alias("weight"))
