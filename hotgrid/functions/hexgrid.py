"""A planar hexagon grid as column expressions: cells, rings and adjacency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.config import Config

#: Axial offsets of the six and twelve cells around a cell.
RING1 = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
RING2 = ((2, 0), (2, -1), (2, -2), (1, -2), (0, -2), (-1, -1), (-2, 0), (-2, 1), (-2, 2), (-1, 2), (0, 2), (1, 1))


def axial(lat: Column, lon: Column, cfg: Config = Config()) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the hexagon that a point is in; null for impossible points."""
    x = (lon - cfg.grid_lon) * (111.320 * math.cos(math.radians(cfg.grid_lat)))
    y = (lat - cfg.grid_lat) * 110.574
    q, r = (x * (math.sqrt(3) / 3) - y / 3) / cfg.edge_km, (y * (2 / 3)) / cfg.edge_km
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_worst, r_worst = (dq > dr) & (dq > ds), dr > ds
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.when(q_worst, -rr - rs).otherwise(rq)), F.when(ok, F.when(~q_worst & r_worst, -rq - rs).otherwise(rr))


def name(q: Column, r: Column) -> Column:
    return F.concat_ws("_", q.cast("long").cast("string"), r.cast("long").cast("string"))


def cell(lat: str | Column, lon: str | Column, cfg: Config = Config()) -> Column:
    """The cell's id; null where a coordinate is null, NaN or out of range."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    q, r = axial(lat, lon, cfg)
    return F.when(q.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon), name(q, r))


def with_cell(df: DataFrame, lat: str = "latitude", lon: str = "longitude", cfg: Config = Config(), to: str = "cell") -> DataFrame:
    """``df`` with the cell of each row as :func:`cell` tells it, by steps that each name what the next ones use.

    As one expression the steps are repeated inside of each other, which is too much code to be compiled: it costs a hundredfold.
    """
    c = F.col
    out = df.withColumn("_y", (c(lat) - cfg.grid_lat) * 110.574).withColumn("_x", (c(lon) - cfg.grid_lon) * (111.320 * math.cos(math.radians(cfg.grid_lat))))
    out = out.withColumns({"_q": (c("_x") * (math.sqrt(3) / 3) - c("_y") / 3) / cfg.edge_km, "_r": (c("_y") * (2 / 3)) / cfg.edge_km}).withColumn("_s", -c("_q") - c("_r"))
    out = out.withColumns({f"_r{k}": F.floor(c(f"_{k}") + 0.5) for k in "qrs"})
    out = out.withColumns({f"_d{k}": F.abs(c(f"_r{k}") - c(f"_{k}")) for k in "qrs"})
    q_worst, r_worst = (c("_dq") > c("_dr")) & (c("_dq") > c("_ds")), c("_dr") > c("_ds")
    out = out.withColumns({"_cq": F.when(q_worst, -c("_rr") - c("_rs")).otherwise(c("_rq")), "_cr": F.when(~q_worst & r_worst, -c("_rq") - c("_rs")).otherwise(c("_rr"))})
    ok = c(lat).between(-90, 90) & c(lon).between(-180, 180)
    steps = ("_x", "_y", "_cq", "_cr", *[f"_{a}{k}" for a in ("", "r", "d") for k in "qrs"])
    return out.withColumn(to, F.when(ok & ~F.isnan(lat) & ~F.isnan(lon), name(c("_cq"), c("_cr")))).drop(*steps)


def edges(cells: DataFrame, cell_col: str = "cell") -> DataFrame:
    """(cell, nbr, ring): rings 1 and 2 around each cell, of cells that are there themselves.

    Eighteen offsets a cell and one semi-join: linear in the cells.
    """
    part = F.split("cell", "_")
    offsets = F.array(*[F.struct(F.lit(ring).alias("ring"), F.lit(q).alias("q"), F.lit(r).alias("r")) for ring, ps in ((1, RING1), (2, RING2)) for q, r in ps])
    own = cells.select(F.col(cell_col).alias("cell")).where("cell is not null").distinct()
    around = own.select("cell", part[0].cast("long").alias("q0"), part[1].cast("long").alias("r0"), F.explode(offsets).alias("o"))
    around = around.select("cell", name(F.col("q0") + F.col("o.q"), F.col("r0") + F.col("o.r")).alias("nbr"), F.col("o.ring").alias("ring"))
    return around.join(own.select(F.col("cell").alias("nbr")), "nbr", "left_semi").select("cell", "nbr", "ring")


def disk_offsets(near: int, far: int) -> list[tuple[int, int]]:
    """(dq, dr) of the cells that are ``near`` + 1 to ``far`` steps away; with ``near`` -1 the cell itself too."""
    steps = lambda q, r: max(abs(q), abs(r), abs(q + r))
    return [(q, r) for q in range(-far, far + 1) for r in range(max(-far, -q - far), min(far, far - q) + 1) if steps(q, r) > near]


def least_km(steps: int, cfg: Config = Config()) -> float:
    """A distance that points of cells so many steps apart have at least.

    Centres are 1.5 edges a step apart at least, and a point is within an edge of its centre. The plane's distances are within one
    percent of those on the sphere inside of the box that the grid is for.
    """
    return max(0.0, 0.99 * (1.5 * steps - 2) * cfg.edge_km)
