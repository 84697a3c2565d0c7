"""Polygon measures on nested arrays: rings are ``array<array<struct<x, y>>>``.

The first ring is the outline and the others are holes, as in GeoJSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from panelwright.operators.staging import shuffled, staged

# Bounding box (min lon, min lat, max lon, max lat) of the region.
REGION_BOX = (85.5, 21.5, 90.0, 27.5)


def _edge_sum(ring: Column, term) -> Column:
    """Sum ``term(p, q)`` over the consecutive point pairs of a closed ring."""
    pairs = F.sequence(F.lit(0), F.size(ring) - 2)
    return F.when(
        F.size(ring) >= 2,
        F.aggregate(
            pairs,
            F.lit(0.0),
            lambda total, i: total + term(F.get(ring, i), F.get(ring, i + 1)),
        ),
    ).otherwise(F.lit(0.0))


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def ring_area(ring: Column) -> Column:
    """Signed shoelace area; positive when counter-clockwise."""
    return _edge_sum(ring, _cross) / F.lit(2.0)


def polygon_area(rings: Column) -> Column:
    """Area of the outline minus the holes."""
    areas = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return F.aggregate(
        F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))),
        F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0)),
        lambda total, hole: total - hole,
    )


def centroid(rings: Column, digits: int = 5) -> tuple[Column, Column]:
    """Area-weighted centroid (x, y) of the outline minus its holes, null for zero area."""
    first = F.get(rings, F.lit(0))
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))

    def net(measure) -> Column:
        """``measure`` of the outline minus that of the holes, all turned one way."""
        def turned(ring: Column) -> Column:
            return F.signum(ring_area(ring)) * measure(ring)

        return F.aggregate(
            F.transform(holes, turned), turned(first), lambda total, hole: total - hole
        )

    area = net(ring_area)

    def axis(name: str) -> Column:
        moment = net(
            lambda ring: _edge_sum(ring, lambda p, q: (p[name] + q[name]) * _cross(p, q))
        )
        return F.when(area != 0.0, F.round(moment / (area * F.lit(6.0)), digits))

    return axis("x"), axis("y")


def bounding_box(rings: Column) -> tuple[Column, Column, Column, Column]:
    """Smallest and largest x and y over all points: (min x, max x, min y, max y)."""
    points = F.flatten(rings)
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def is_open(rings: Column) -> Column:
    """Whether any ring does not end at its first point."""
    return F.exists(
        rings, lambda r: F.get(r, F.lit(0)) != F.element_at(r, -1)
    )


def segments(df: DataFrame, id_col: str, rings: str) -> DataFrame:
    """One row per ring edge: unit, ring, edge number, number of edges, end points.

    Points that repeat their predecessor make no edge and are left out before numbering.
    Each edge has the corner ``x0, y0``, the size ``wx, wy`` and the number ``n`` of edges of
    its feature beside it. The features are spread by id before their edges are made, in a
    fixed number of partitions (a few bytes grow into many rows), so the aggregate and the
    join that add these find the edges in place.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(partitions, F.col(id_col))
    bare = F.transform(
        rings, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    )
    ring_rows = df.select(F.col(id_col), F.posexplode(bare).alias("ring", "pts"))
    edges = ring_rows.select(
        id_col,
        "ring",
        (F.size("pts") - 1).alias("edges"),
        F.posexplode(
            F.expr(
                "transform(sequence(0, greatest(size(pts) - 2, 0)),"
                " i -> struct(get(pts, i) as p, get(pts, i + 1) as q))"
            )
        ).alias("edge", "pq"),
    ).select(
        id_col, "ring", "edges", "edge",
        F.col("pq.p.x").alias("px"), F.col("pq.p.y").alias("py"),
        F.col("pq.q.x").alias("qx"), F.col("pq.q.y").alias("qy"),
    ).where("qx is not null")
    frame = edges.groupBy(id_col).agg(
        F.min(F.least("px", "qx")).alias("x0"),
        F.min(F.least("py", "qy")).alias("y0"),
        (F.max(F.greatest("px", "qx")) - F.min(F.least("px", "qx"))).alias("wx"),
        (F.max(F.greatest("py", "qy")) - F.min(F.least("py", "qy"))).alias("wy"),
        F.count(F.lit(1)).alias("n"),
    )
    return edges.join(shuffled(frame), id_col)


def _cells(seg: DataFrame, id_col: str) -> DataFrame:
    """Each edge in the cells of its feature's grid that it passes, and in no others.

    The grid has about as many cells as the feature has edges. An edge is cut at the
    borders of the columns it crosses; within a column it covers the rows between the two
    cuts, so a long edge costs a cell per step and not its whole bounding box.
    """
    def share(value: str, origin: str, width: str) -> Column:
        part = (F.col(value) - F.col(origin)) / F.col(width) * F.col("cells")
        return F.when(F.col(width) > 0, part).otherwise(0.0)

    scaled = seg.withColumn("cells", F.ceil(F.sqrt("n")).cast("int")).select(
        id_col, "cells", "ring", "edges", "edge", "px", "py", "qx", "qy",
        share("px", "x0", "wx").alias("ux"), share("py", "y0", "wy").alias("uy"),
        share("qx", "x0", "wx").alias("vx"), share("qy", "y0", "wy").alias("vy"),
    )
    slack = 1e-9  # rounding of the cuts; a cell too many costs time, one too few a crossing
    low, high = F.least("ux", "vx"), F.greatest("ux", "vx")
    by_column = scaled.withColumn(
        "cx", F.explode(F.sequence(F.floor(low - slack).cast("int"), F.floor(high + slack).cast("int")))
    )
    slope = (F.col("vy") - F.col("uy")) / (F.col("vx") - F.col("ux"))

    def cut(border: Column) -> Column:
        x = F.least(F.greatest(border, low), high)
        return F.col("uy") + (x - F.col("ux")) * slope

    steep = F.abs(F.col("vx") - F.col("ux")) <= slack
    first = F.when(steep, F.col("uy")).otherwise(cut(F.col("cx") - slack))
    last = F.when(steep, F.col("vy")).otherwise(cut(F.col("cx") + 1 + slack))
    return by_column.withColumn(
        "cy",
        F.explode(
            F.sequence(
                F.floor(F.least(first, last) - slack).cast("int"),
                F.floor(F.greatest(first, last) + slack).cast("int"),
            )
        ),
    )


def is_flat(ring: Column) -> Column:
    """Whether all points of a ring lie on one line."""
    first = F.get(ring, F.lit(0))
    pairs = F.zip_with(
        ring, F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"])
        - (p["y"] - first["y"]) * (q["x"] - first["x"]),
    )
    return F.forall(pairs, lambda v: F.coalesce(v, F.lit(0.0)) == 0)


def edge_conflicts(df: DataFrame, id_col: str, rings: str) -> DataFrame:
    """Conflicts of the edges of every feature, see :func:`segment_conflicts`."""
    return segment_conflicts(segments(df, id_col, rings), id_col)


def segment_conflicts(seg: DataFrame, id_col: str) -> DataFrame:
    """Pairs of edges of one feature that make its outline invalid.

    Within a ring: edges that cross, overlap or touch, except that consecutive edges share
    their common point. Between rings: edges that cross or overlap; a touch in one point is
    allowed. Edges meet only in the grid cells they both pass.
    """
    placed = _cells(seg, id_col)
    ends = ("ring", "edges", "edge", "px", "py", "qx", "qy")
    cell = [id_col, "cx", "cy"]
    a = placed.select(*cell, *[F.col(c).alias(f"a_{c}") for c in ends])
    b = placed.select(*cell, *[F.col(c).alias(f"b_{c}") for c in ends])
    c = F.col

    def side(p: str, q: str, r: str) -> Column:
        """Orientation of point r relative to the line p -> q."""
        return F.signum(
            (c(f"{q}x") - c(f"{p}x")) * (c(f"{r}y") - c(f"{p}y"))
            - (c(f"{q}y") - c(f"{p}y")) * (c(f"{r}x") - c(f"{p}x"))
        )

    def on(p: str, q: str, r: str) -> Column:
        """Whether point r lies on the segment p -> q."""
        return (
            (side(p, q, r) == 0)
            & c(f"{r}x").between(F.least(f"{p}x", f"{q}x"), F.greatest(f"{p}x", f"{q}x"))
            & c(f"{r}y").between(F.least(f"{p}y", f"{q}y"), F.greatest(f"{p}y", f"{q}y"))
        )

    crossing = (side("a_p", "a_q", "b_p") * side("a_p", "a_q", "b_q") < 0) & (
        side("b_p", "b_q", "a_p") * side("b_p", "b_q", "a_q") < 0
    )
    touching = (
        on("a_p", "a_q", "b_p") | on("a_p", "a_q", "b_q")
        | on("b_p", "b_q", "a_p") | on("b_p", "b_q", "a_q")
    )
    in_line = (side("a_p", "a_q", "b_p") == 0) & (side("a_p", "a_q", "b_q") == 0)

    def shared(axis: str) -> Column:
        return F.least(F.greatest(f"a_p{axis}", f"a_q{axis}"), F.greatest(f"b_p{axis}", f"b_q{axis}")) - (
            F.greatest(F.least(f"a_p{axis}", f"a_q{axis}"), F.least(f"b_p{axis}", f"b_q{axis}"))
        )

    overlap = in_line & (shared("x") >= 0) & (shared("y") >= 0) & (shared("x") + shared("y") > 0)
    same = c("a_ring") == c("b_ring")
    follows = same & (c("b_edge") == c("a_edge") + 1)
    closes = same & (c("a_edge") == 0) & (c("b_edge") == c("b_edges") - 1)
    # rings of two edges have no area and are reported as such
    inside = F.when(follows | closes, overlap & (c("a_edges") > 2)).otherwise(crossing | touching)
    ordered = (c("a_ring") < c("b_ring")) | (same & (c("a_edge") < c("b_edge")))
    return (
        a.join(shuffled(b), cell)
        .where(ordered & F.when(same, inside).otherwise(crossing | overlap))
        .select(id_col, "a_ring", "a_edge", "b_ring", "b_edge")
        .distinct()
    )


def holes_inside(rings: Column) -> Column:
    """Whether the first point of every hole lies in or on the outline."""
    shell = F.get(rings, F.lit(0))
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))

    def within(p: Column) -> Column:
        edges = F.zip_with(
            shell, F.slice(shell, 2, F.greatest(F.size(shell) - 1, F.lit(0))),
            lambda u, v: F.struct(u.alias("u"), v.alias("v")),
        )

        def passed(e: Column) -> Column:
            u, v = e["u"], e["v"]
            at = u["x"] + (p["y"] - u["y"]) * (v["x"] - u["x"]) / F.nullif(v["y"] - u["y"], F.lit(0.0))
            return ((u["y"] > p["y"]) != (v["y"] > p["y"])) & (p["x"] < at)

        def beside(e: Column) -> Column:
            u, v = e["u"], e["v"]
            turn = (v["x"] - u["x"]) * (p["y"] - u["y"]) - (v["y"] - u["y"]) * (p["x"] - u["x"])
            return (
                (turn == 0)
                & p["x"].between(F.least(u["x"], v["x"]), F.greatest(u["x"], v["x"]))
                & p["y"].between(F.least(u["y"], v["y"]), F.greatest(u["y"], v["y"]))
            )

        crossings = F.size(F.filter(edges, lambda e: F.coalesce(passed(e), F.lit(False))))
        return (crossings % 2 == 1) | F.exists(edges, lambda e: F.coalesce(beside(e), F.lit(False)))

    return F.forall(holes, lambda h: F.coalesce(within(F.get(h, F.lit(0))), F.lit(False)))


def geometry_problems(df: DataFrame, id_col: str, geom_type: str, rings: str) -> DataFrame:
    """First problem of each feature: null, wrong type, empty, open, crossing, hole outside,
    no area."""
    crossed = edge_conflicts(df, id_col, rings).select(id_col).distinct().withColumn(
        "_crossed", F.lit(True)
    )
    r = F.col(rings)
    problem = (
        F.when(r.isNull(), "null_geometry")
        .when(~F.coalesce(F.col(geom_type).isin("Polygon", "MultiPolygon"), F.lit(False)), "wrong_type")
        .when(F.size(F.flatten(r)) == 0, "empty_geometry")
        .when(is_open(r), "open_ring")
        .when(is_flat(F.get(r, F.lit(0))), "zero_area")
        .when(F.coalesce("_crossed", F.lit(False)), "self_intersection")
        .when(~holes_inside(r), "hole_outside")
        .when(polygon_area(r) <= 0, "zero_area")
    )
    return (
        df.join(shuffled(crossed), id_col, "left")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select(id_col, "problem")
    )


def outside_region(df: DataFrame, id_col: str, rings: str, box=REGION_BOX) -> DataFrame:
    """Features whose bounding box leaves the region."""
    x0, x1, y0, y1 = bounding_box(F.col(rings))
    inside = (x0 >= box[0]) & (y0 >= box[1]) & (x1 <= box[2]) & (y1 <= box[3])
    return df.where(~inside).select(id_col)


def with_geometry(df: DataFrame, rings: str) -> DataFrame:
    """Rows whose geometry is there: not null and with at least one point."""
    return df.where(F.size(F.flatten(F.col(rings))) > 0)


# --- validity of whole features ---------------------------------------------------------

def _probes(seg: DataFrame, id_col: str) -> DataFrame:
    """Corners and edge midpoints of every ring, numbered by edge.

    Rings that do not cross or overlap lie on one side of each other as soon as one of these
    points does: an edge with both ends on another ring has its midpoint off it.
    """
    middle = [((F.col(f"p{v}") + F.col(f"q{v}")) / 2).alias(v) for v in "xy"]
    feature = [id_col, "y0", "wy", "bands", "ring", "edge"]
    corner = seg.select(*feature, F.lit(0).alias("half"), F.col("px").alias("x"), F.col("py").alias("y"))
    return corner.unionByName(seg.select(*feature, F.lit(1).alias("half"), *middle))


def ring_sides(seg: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """How rings of one feature lie to each other, and the points in which they touch.

    ``seg`` are the edges of :func:`segments`. First table: ``a``, ``b`` and how many of a's probes lie strictly ``inside`` b or ``on`` it, of all its ``probes``; pairs
    without a probe in or on b are left out. Second table: ``a``, ``b`` and a corner of a that
    lies on b. A probe meets the edges of its horizontal band only; a feature has as many
    bands as the root of its number of edges, and each (feature, band) is a group of its own,
    so a feature with very many edges spreads over tasks.
    """
    seg = seg.withColumn("bands", F.ceil(F.sqrt("n")).cast("int"))

    def band(y: Column) -> Column:
        place = F.floor((y - F.col("y0")) / F.col("wy") * F.col("bands")).cast("int")
        return F.when(F.col("wy") > 0, place).otherwise(0)

    edges = seg.select(
        id_col, F.col("ring").alias("b"), "px", "py", "qx", "qy",
        F.explode(F.sequence(band(F.least("py", "qy")), band(F.greatest("py", "qy")))).alias("band"),
    )
    probes = _probes(seg, id_col).select(
        id_col, F.col("ring").alias("a"), "edge", "half", "x", "y", band(F.col("y")).alias("band")
    )
    c = F.col
    turn = (c("qx") - c("px")) * (c("y") - c("py")) - (c("qy") - c("py")) * (c("x") - c("px"))
    on = (
        (turn == 0)
        & c("x").between(F.least("px", "qx"), F.greatest("px", "qx"))
        & c("y").between(F.least("py", "qy"), F.greatest("py", "qy"))
    )
    # a ray to the right crosses the edge: the probe lies left of it
    passed = ((c("py") > c("y")) != (c("qy") > c("y"))) & ((turn > 0) == (c("qy") > c("py")))
    met = probes.join(shuffled(edges), [id_col, "band"]).where("a != b").groupBy(
        id_col, "a", "b", "edge", "half", "x", "y"
    ).agg(
        F.max(on).alias("on"), (F.sum(passed.cast("int")) % 2 == 1).alias("odd")
    )
    counts = seg.groupBy(id_col, F.col("ring").alias("a")).agg((F.count(F.lit(1)) * 2).alias("probes"))
    sides = met.groupBy(id_col, "a", "b").agg(
        F.count_if(c("odd") & ~c("on")).alias("inside"), F.count_if("on").alias("on")
    ).where("inside + `on` > 0").join(shuffled(counts), [id_col, "a"])
    touches = met.where("`on` and half = 0").select(id_col, "a", "b", "x", "y").distinct()
    return sides, touches


def has_cycle(links: Column) -> Column:
    """Whether an undirected graph, an array of ``struct<u, v>`` without repeats, has a cycle.

    Links are added one by one to sets of connected nodes; a link inside one set closes a
    cycle.
    """
    start = F.struct(
        F.array().cast("array<array<string>>").alias("sets"), F.lit(False).alias("cycle")
    )

    def add(state, link):
        def meets(nodes):
            return F.array_contains(nodes, link["u"]) | F.array_contains(nodes, link["v"])

        joined = F.flatten(F.filter(state["sets"], meets))
        closed = F.exists(
            state["sets"], lambda n: F.array_contains(n, link["u"]) & F.array_contains(n, link["v"])
        )
        merged = F.array_union(joined, F.array(link["u"], link["v"]))
        return F.struct(
            F.concat(F.filter(state["sets"], lambda n: ~meets(n)), F.array(merged)).alias("sets"),
            (state["cycle"] | closed).alias("cycle"),
        )

    return F.aggregate(links, start, add)["cycle"]


def multipolygon_problems(df: DataFrame, id_col: str, parts: str) -> DataFrame:
    """First problem of each feature of one or more polygons, its parts judged together.

    ``parts`` is an array of polygons, each an array of rings (outline first). In order:
    ``null_geometry``, ``empty_geometry`` (no points, or a polygon without an outline),
    ``open_ring``, ``zero_area`` (a flat ring), ``self_intersection`` (edges that cross or
    overlap, of any rings), ``hole_outside``, ``nested_holes``, ``overlapping_parts`` (a part in
    the interior of another one; inside a hole it is an island and right), and
    ``interior_disconnected`` (rings of a part that touch in a closed chain cut its interior).
    Touches in single points are right. Features without a problem are left out. A null id
    is judged like any other as long as it is one feature. The edges are staged. The touches of one polygon are
    gathered in one row, which is never longer than the polygon itself.
    """
    ring_list = F.flatten(F.col(parts))
    base = df.select(
        F.col(id_col).alias("_id"), F.col(parts).alias("_parts"), ring_list.alias("_rings"),
        F.flatten(F.transform(parts, lambda part, i: F.transform(part, lambda ring: i))).alias("_part"),
        F.flatten(F.transform(parts, lambda part: F.transform(part, lambda ring, i: i > 0))).alias("_hole"),
    )
    broken = (
        F.when(F.col("_parts").isNull(), "null_geometry")
        .when(
            F.coalesce(F.size(F.flatten("_rings")) == 0, F.lit(True))
            | F.exists("_parts", lambda part: F.coalesce(F.size(F.get(part, F.lit(0))) <= 0, F.lit(True))),
            "empty_geometry",
        )
        .when(is_open(F.col("_rings")), "open_ring")
        .when(F.exists("_rings", is_flat), "zero_area")
    )
    base = base.withColumn("_broken", broken)
    sound = base.where("_broken is null").withColumn(
        "_key", F.coalesce(F.col("_id").cast("string"), F.lit(""))
    )
    seg = staged(segments(sound, "_key", "_rings"), "segments")
    crossed = segment_conflicts(seg, "_key").select("_key").distinct().withColumn("_crossed", F.lit(True))
    sides, touches = ring_sides(seg, "_key")
    rings_of = sound.select("_key", "_part", "_hole")

    def named(table: DataFrame) -> DataFrame:
        return table.join(shuffled(rings_of), "_key").withColumns(
            {f"{side}{kind}": F.get(kind, F.col(side)) for side in "ab" for kind in ("_part", "_hole")}
        )

    known = named(sides)
    same = F.col("a_part") == F.col("b_part")
    per_ring = known.groupBy("_key", "a", "a_hole", "b_part").agg(
        F.max(same).alias("same"),
        F.max(same & F.col("a_hole") & ~F.col("b_hole") & (F.col("inside") + F.col("on") == F.col("probes"))).alias("held"),
        F.max(same & F.col("a_hole") & F.col("b_hole") & (F.col("inside") > 0)).alias("nested"),
        F.max(~same & ~F.col("a_hole") & ~F.col("b_hole") & (F.col("inside") > 0)).alias("within"),
        F.max(~same & ~F.col("a_hole") & F.col("b_hole") & (F.col("inside") > 0)).alias("island"),
    )
    verdicts = per_ring.groupBy("_key").agg(
        F.count_if("held").alias("_held"), F.max("nested").alias("_nested"),
        F.max(F.col("within") & ~F.col("island")).alias("_overlap"),
    )
    meets = named(touches).where("a_part = b_part")
    point = F.concat_ws(" ", "x", "y")
    chains = meets.select(
        "_key", "a_part", F.explode(F.array(
            F.struct(F.concat(F.lit("ring "), "a").alias("u"), point.alias("v")),
            F.struct(F.concat(F.lit("ring "), "b").alias("u"), point.alias("v")),
        )).alias("link")
    ).groupBy("_key", "a_part").agg(F.collect_set("link").alias("links")).where(
        has_cycle(F.col("links"))
    ).select("_key").distinct().withColumn("_cut", F.lit(True))
    holes = F.size(F.filter("_hole", lambda h: h))
    no = F.lit(False)
    judged = (
        sound.join(shuffled(crossed), "_key", "left").join(shuffled(verdicts), "_key", "left")
        .join(shuffled(chains), "_key", "left")
        .withColumn(
            "problem",
            F.when(F.coalesce("_crossed", no), "self_intersection")
            .when(F.coalesce("_held", F.lit(0)) < holes, "hole_outside")
            .when(F.coalesce("_nested", no), "nested_holes")
            .when(F.coalesce("_overlap", no), "overlapping_parts")
            .when(F.coalesce("_cut", no), "interior_disconnected"),
        )
        .where("problem is not null")
    )
    return judged.select(F.col("_id").alias(id_col), "problem").unionByName(
        base.where("_broken is not null").select(F.col("_id").alias(id_col), F.col("_broken").alias("problem"))
    )


# --- units of several parts -----------------------------------------------------------

def moments(rings: Column) -> Column:
    """Additive moments of one polygon: area and first moments, outline minus holes.

    Sums of these over the parts of a unit give its area and centroid, so a unit is measured
    without a union of its boundaries and without gathering its parts.
    """
    first = F.get(rings, F.lit(0))
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))

    def net(measure) -> Column:
        def turned(ring: Column) -> Column:
            return F.signum(ring_area(ring)) * measure(ring)

        return F.coalesce(
            F.aggregate(F.transform(holes, turned), turned(first), lambda total, hole: total - hole),
            F.lit(0.0),
        )

    def axis(name: str) -> Column:
        return net(
            lambda ring: _edge_sum(ring, lambda p, q: (p[name] + q[name]) * _cross(p, q)) / F.lit(6.0)
        )

    return F.struct(
        net(ring_area).alias("area"), axis("x").alias("mx"), axis("y").alias("my")
    )


def unit_geometry(parts: DataFrame, keys: list[str], rings: str = "rings", digits: int = 5) -> DataFrame:
    """One row per unit: parts, area, area-weighted centroid and box of all its polygons.

    ``parts`` has a row per polygon. Moments and boxes are combined map-side, so a unit with
    a large share of the polygons sends one row per task. Polygons without points count as
    parts and add nothing; a unit without area has no centroid.
    """
    x0, x1, y0, y1 = bounding_box(F.col(rings))
    sums = parts.withColumns(
        {"_m": moments(F.col(rings)), "_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}
    ).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("_m.area").alias("area"), F.sum("_m.mx").alias("_mx"), F.sum("_m.my").alias("_my"),
        F.min("_x0").alias("min_x"), F.max("_x1").alias("max_x"),
        F.min("_y0").alias("min_y"), F.max("_y1").alias("max_y"),
    )
    some = F.col("area") > 0
    return sums.withColumns(
        {
            "centroid_lon": F.when(some, F.round(F.col("_mx") / F.col("area"), digits)),
            "centroid_lat": F.when(some, F.round(F.col("_my") / F.col("area"), digits)),
        }
    ).drop("_mx", "_my")


# Names of the longitude-latitude system of GeoJSON.
DEGREE_NAMES = ("4326", "CRS84", "WGS")
# Bounds of the axes (min x, max x, min y, max y) by code, in its unit.
AXIS_BOUNDS = {
    "4326": (-180.0, 180.0, -90.0, 90.0),
    "CRS84": (-180.0, 180.0, -90.0, 90.0),
    "3857": (-20037508.35, 20037508.35, -20048966.11, 20048966.11),
}


def crs_name(text: Column | str) -> Column:
    """Name of the reference system of a FeatureCollection text; without one it is EPSG:4326."""
    named = F.get_json_object(text, "$.crs.properties.name")
    return F.coalesce(named, F.lit("EPSG:4326"))


def crs_problems(collections: DataFrame, id_col: str, text: str = "value") -> DataFrame:
    """First problem of the reference system and the coordinates of each collection.

    ``crs_mismatch``: the named system is not the longitude-latitude one. ``no_features``:
    nothing is in it. ``axis_out_of_bounds``: a coordinate lies outside what the axes of
    the named system allow, as metres in a file that claims degrees do. ``swapped_axes``:
    the coordinates fit only with x and y exchanged.
    """
    named = collections.select(id_col, F.col(text).alias("_text"), crs_name(text).alias("_crs"))
    upper = F.upper("_crs")
    known = F.lit(False)
    for name in DEGREE_NAMES:
        known = known | upper.contains(name)
    code = F.coalesce(
        *[F.when(upper.contains(c), F.lit(c)) for c in AXIS_BOUNDS], F.lit("4326")
    )
    def axis(group: int) -> Column:
        found = F.regexp_extract_all(
            "_text",
            F.lit(r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"),
            F.lit(group),
        )
        return F.transform(found, lambda v: v.cast("double"))

    rows = named.withColumns({"_x": axis(1), "_y": axis(2)})
    limits = F.create_map(
        *[x for c, b in AXIS_BOUNDS.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in b]))]
    )
    b = F.element_at(limits, code)

    def fits(x: str, y: str) -> Column:
        return (
            (F.array_min(x) >= b[0]) & (F.array_max(x) <= b[1])
            & (F.array_min(y) >= b[2]) & (F.array_max(y) <= b[3])
        )

    problem = (
        F.when(~known, "crs_mismatch")
        .when(F.coalesce(F.get_json_object("_text", "$.features[0]"), F.lit("")) == "", "no_features")
        .when(~fits("_x", "_y") & fits("_y", "_x"), "swapped_axes")
        .when(~fits("_x", "_y"), "axis_out_of_bounds")
    )
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        id_col, F.col("_crs").alias("crs"), "problem"
    )
