"""Independent verification of saved results: a row for each violation, found by joins over all scenes at once.

Nothing that made a result is trusted: topology, flows, diameters, costs, sets of unconnected consumers and ranks
are computed again from the lines' ends and the map. Rules whose objects are sound only when others hold (flows of
a network with a cycle, say) are checked where those hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorgrid.functions import catalog, geometry, pricing
from calorgrid.operators import graph, spatial, tours, tree
from calorgrid.operators.lineage import cut
from calorgrid.sources import geojson

# Fixed values of the rules: how near ends are to their nodes, turns, rays of a node, radius of a chamber.
END, TURN, RAYS, RADIUS = 2e-6, 90.000001, 4, 10.0
LENGTH_SLACK = "0.000000002"
CELL = 100
BY = ["scene_id", "variant_id"]


@dataclass
class Result:
    """lines, nodes (chambers and technical nodes) and summaries of all variants."""

    lines: DataFrame
    nodes: DataFrame
    summaries: DataFrame


def result(rows: DataFrame) -> Result:
    """The typed tables of a saved result that `geojson.documents` or `lines` gave."""
    get = geojson.value
    kind = lambda c: F.schema_of_variant(F.try_variant_get("feature", f"$.properties.{c}", "variant"))
    text = lambda c: F.when(kind(c) == "STRING", get(f"$.properties.{c}")).otherwise(geojson.plain_id(get(f"$.properties.{c}")))
    f = rows.where("seq is not null").withColumns({"id": text("id"), "variant_id": get("$.properties.variant_id"), "object_type": get("$.properties.object_type")})
    money = lambda c: get(f"$.properties.{c}", "decimal(24,2)")
    points = geojson.metres(F.array(F.try_variant_get("feature", "$.geometry.coordinates", geojson.FLAT)))[0]
    lines = f.where("object_type = 'heat_network'").select(
        *BY, "id", text("start_node_id").alias("start"), kind("start_node_id").alias("start_type"), text("end_node_id").alias("end"),
        kind("end_node_id").alias("end_type"), get("$.properties.diameter", "int").alias("dn"), get("$.properties.flow_tph", "decimal(18,6)").alias("flow"),
        get("$.properties.length", "decimal(18,9)").alias("length"), money("cost").alias("cost"), get("$.properties.laying_method").alias("method"),
        get("$.properties.depth_start", "double").alias("depth_start"), get("$.properties.depth_end", "double").alias("depth_end"), points.alias("points"),
    )
    at = geojson.metres(F.array(F.array(F.try_variant_get("feature", "$.geometry.coordinates", "array<double>"))))[0][0]
    nodes = f.where("object_type in ('heat_chamber', 'technical_node')").select(*BY, "id", kind("id").alias("id_type"), "object_type", get("$.properties.diameter", "int").alias("dn"), money("cost").alias("cost"), at.alias("p"))
    names = ("construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost")
    summaries = f.where("object_type = 'variant_summary'").select(
        *BY, "id", get("$.properties.rank", "int").alias("rank"), *[money(c).alias(c) for c in names], get("$.properties.score", "decimal(28,12)").alias("score"),
        get("$.properties.new_network_length", "decimal(28,9)").alias("new_network_length"), get("$.properties.existing_chamber_tie_in_count", "long").alias("existing_chamber_tie_in_count"),
        F.transform(F.try_variant_get("feature", "$.properties.unconnected_oks_ids", "array<variant>"), lambda v: F.struct(geojson.plain_id(F.try_variant_get(v, "$", "string")).alias("id"), F.schema_of_variant(v).alias("kind"))).alias("unconnected"),
    )
    return Result(lines, nodes, summaries)


def _row(rows: DataFrame, code: str, said: Column | str = "", id_: str | None = "id") -> DataFrame:
    said = F.lit(said) if isinstance(said, str) else said.cast("string")
    return rows.select(*BY, (F.col(id_) if id_ else F.lit(None)).cast("string").alias("id"), F.lit(code).alias("code"), said.alias("said"))


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _written(found: list[DataFrame]) -> DataFrame:
    return cut(_union(found))


def identities(r: Result, objects: DataFrame) -> list[DataFrame]:
    """Ids met twice or taken by the map, the numbers of variants and of summaries, variants that are alike."""
    ids = _union([t.select(*BY, "id") for t in (r.lines, r.nodes, r.summaries)])
    twice = ids.groupBy("scene_id", "id").agg(F.count("*").alias("n"), F.min("variant_id").alias("variant_id"))
    taken = ids.join(objects.select("scene_id", "id").distinct(), ["scene_id", "id"], "left_semi")
    groups = ids.select(*BY).distinct()
    counts = groups.groupBy("scene_id").agg(F.count("*").alias("n"), F.min("variant_id").alias("variant_id"))
    summaries = groups.join(r.summaries.groupBy(*BY).agg(F.count("*").alias("n")), BY, "left")
    shape = F.concat(geojson.fingerprint(F.array("points"), 6), F.lit(":"), F.col("dn").cast("string"))
    shapes = r.lines.groupBy(*BY).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(shape)), ","), 256).alias("shape"))
    same = shapes.groupBy("scene_id", "shape").agg(F.count("*").alias("n"), F.max("variant_id").alias("variant_id"))
    return [
        _row(twice.where("n > 1"), "DUPLICATE_ID", "another object of the result"),
        _row(taken, "DUPLICATE_ID", "an object of the map"),
        _row(counts.where("n > 3"), "VARIANT_COUNT", F.col("n"), None),
        _row(summaries.where("coalesce(n, 0) <> 1"), "SUMMARY_COUNT", F.coalesce("n", F.lit(0)), None),
        _row(same.where("n > 1"), "DUPLICATE_VARIANT", "", None),
    ]


def ends(lines: DataFrame, places: DataFrame) -> list[DataFrame]:
    """References: to nothing, to a point elsewhere, or with another JSON type. places has scene_id, variant_id
    (null for the map's objects), id, id_type and p."""
    both = F.explode(F.array(
        F.struct(F.col("start").alias("ref"), F.col("start_type").alias("kind"), F.element_at("points", 1).alias("q")),
        F.struct(F.col("end").alias("ref"), F.col("end_type").alias("kind"), F.element_at("points", -1).alias("q")),
    ))
    refs = lines.select(*BY, "id", both.alias("_e")).select(*BY, "id", "_e.*")
    to = places.select("scene_id", F.col("variant_id").alias("_v"), F.col("id").alias("ref"), "id_type", "p")
    met = refs.join(to.where("_v is not null").withColumnRenamed("_v", "variant_id"), [*BY, "ref"], "left").withColumnsRenamed({"id_type": "own_type", "p": "own"})
    met = met.join(to.where("_v is null").drop("_v"), ["scene_id", "ref"], "left").withColumns({"p": F.coalesce("own", "p"), "id_type": F.coalesce("own_type", "id_type")})
    away = F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")) > END
    number = lambda c: F.col(c) != "STRING"
    return [
        _row(met.where("p is null"), "DANGLING_REFERENCE", F.col("ref")),
        _row(met.where(away), "ENDPOINT", F.col("ref")),
        _row(met.where(F.col("p").isNotNull() & (number("kind") != number("id_type"))), "REFERENCE_ID_TYPE", F.col("ref")),
    ]


def _length(points: str) -> Column:
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def measures(lines: DataFrame) -> list[DataFrame]:
    """Lengths of lines, diameters outside the catalogue, depths of some lines only, turns within lines."""
    staged = lines.groupBy(*BY).agg(F.max(F.col("depth_start").isNotNull()).alias("staged"))
    depth = lines.join(staged, BY).where("(depth_start is null) <> (depth_end is null) or (depth_start is null) = staged")
    off = F.abs(F.round(_length("points"), 9).cast("decimal(18,9)") - F.col("length")) > F.lit(LENGTH_SLACK).cast("decimal(18,9)")
    known = F.col("dn").isin(*[p[0] for p in catalog.PIPES])
    n = F.size("points")
    at = lambda i: F.element_at("points", i)
    sharp = F.exists(F.sequence(F.lit(2), n - 1), lambda i: turn(F.element_at("points", i - 1), F.element_at("points", i), F.element_at("points", i + 1)) > TURN)
    return [
        _row(lines.where(off | F.col("length").isNull()), "VALUE_MISMATCH", "length"),
        _row(lines.where(~known | F.col("dn").isNull()), "INVALID_ATTRIBUTE", "diameter"),
        _row(depth, "DEPTH"),
        _row(lines.where((n > 2) & sharp), "TURN_ANGLE", "within the line"),
    ]


def turn(a: Column, b: Column, c: Column) -> Column:
    """The angle by which a way turns at b, in degrees."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / (F.hypot(ux, uy) * F.hypot(vx, vy))))))


def oriented(lines: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Lines of sound trees, each with up and down, its nodes nearer to and farther from the root; and violations of
    networks that are no trees with one root: cycles, components without or with several roots."""
    name = lambda c: F.concat_ws("\u0001", *BY, c).alias(c)
    edges = lines.select(*BY, "id", name("start").alias("a"), name("end").alias("b"))
    nodes = edges.select(*BY, F.explode(F.array("a", "b")).alias("node")).distinct()
    label = cut(graph.components(edges, nodes))
    tops = roots.select(*BY, F.concat_ws("\u0001", *BY, "node").alias("node"), F.col("node").alias("root"))
    stats = label.join(tops.select("node", "root"), "node", "left").groupBy("label").agg(F.count("*").alias("nodes"), F.count("root").alias("roots"))
    stats = stats.join(edges.join(label.withColumnRenamed("node", "a"), "a").groupBy("label").agg(F.count("*").alias("edges"), F.min("id").alias("id"), F.first(F.struct(*BY)).alias("of")), "label")
    stats = cut(stats.select("label", "of.*", "id", "nodes", "roots", "edges"))
    found = [
        _row(stats.where("edges >= nodes"), "NEW_CYCLE", F.col("edges") - F.col("nodes") + 1),
        _row(stats.where("roots = 0"), "ORPHAN_EDGE", F.col("edges")),
        _row(stats.where("roots > 1"), "MULTIPLE_ROOTS", F.col("roots")),
    ]
    sound = stats.where("edges = nodes - 1 and roots = 1").select("label")
    good = label.join(sound, "label", "left_semi")
    trees = edges.join(good.select(F.col("node").alias("a")), "a", "left_semi").select(*BY, "id", "a", "b")
    return tours.orient(trees, good.join(tops.select("node"), "node", "left_semi")), found


def _key(*columns: str) -> Column:
    return F.concat_ws("\u0001", *columns)


def verify(scenes: geojson.Scenes, r: Result) -> DataFrame:
    """scene_id, variant_id, id, code and said of every violation of every variant.

    The rows of each set of rules are written as soon as they are found: one plan of all rules, with the tables that
    they share planned again in each, takes the driver's memory, however small the maps.
    """
    r = Result(cut(r.lines), cut(r.nodes), cut(r.summaries))
    scenes = geojson.Scenes(cut(scenes.objects), cut(scenes.parts), scenes.notes)
    one = F.element_at(F.element_at("rings", 1), 1)
    placed = cut(scenes.objects.join(scenes.parts.where("part = 0").select("scene_id", "id", "dim", "rings", one.alias("p")), ["scene_id", "id"]))
    points = placed.where("dim = 0").select("scene_id", F.lit(None).cast("string").alias("variant_id"), "id", "id_type", "p", "object_type", "dn")
    own = r.nodes.select(*BY, "id", "id_type", "p", "object_type", "dn")
    done = [_written(identities(r, scenes.objects))]
    done.append(_written(ends(r.lines, points.where("object_type in ('oks_connection_point', 'heat_chamber')").union(own))))
    done.append(_written(measures(r.lines)))

    variants = r.summaries.select(*BY).distinct()
    pipes = geojson.segments(scenes.parts.join(scenes.objects.where("object_type = 'heat_network'").select("scene_id", "id", F.col("dn").alias("pipe_dn")), ["scene_id", "id"], "left_semi"))
    pipes = pipes.join(scenes.objects.select("scene_id", "id", F.col("dn").alias("pipe_dn")), ["scene_id", "id"])
    chambers = own.where("object_type = 'heat_chamber'").select(*BY, F.col("id").alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    side = (F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    at = lambda m: (F.col("x") - m, F.col("y") - m, F.col("x") + m, F.col("y") + m)
    away = geometry.distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    ties = spatial.near(chambers, pipes, at(1e-6), side, CELL, ["scene_id"]).where(away <= 1e-6)
    inside = ((F.hypot(F.col("x") - F.col("x1"), F.col("y") - F.col("y1")) > 0.1) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) > 0.1))
    ties = cut(ties.groupBy(*BY, "node").agg(F.max("pipe_dn").alias("pipe_dn"), F.sum(F.when(inside, 2).otherwise(1)).alias("met"), F.first("x").alias("x"), F.first("y").alias("y")))
    old = points.where("object_type = 'heat_chamber'").select("scene_id", F.col("id").alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "dn")
    old_met = spatial.near(old, pipes, at(0.1), side, CELL, ["scene_id"]).where(away <= 0.1).groupBy("scene_id", "node").agg(F.sum(F.when(inside, 2).otherwise(1)).alias("met"), F.max("pipe_dn").alias("old_dn"))
    old = cut(old.join(old_met, ["scene_id", "node"], "left").withColumn("met", F.coalesce("met", F.lit(0))))
    ends_of = cut(r.lines.select(*BY, "id", "dn", F.explode(F.array("start", "end")).alias("node")))
    degree = cut(ends_of.groupBy(*BY, "node").agg(F.count("*").alias("rays"), F.max("dn").alias("top_dn")))
    roots = cut(ties.select(*BY, "node", "met", F.lit(False).alias("old")).union(degree.join(old.select("scene_id", "node", "met"), ["scene_id", "node"]).select(*BY, "node", "met", F.lit(True).alias("old"))))
    way, broken = oriented(r.lines, roots)
    way = cut(way)
    done.append(_written(broken))

    # flows and diameters of sound trees
    demands = scenes.objects.where("object_type = 'oks_connection_point'")
    valid = demands.where("valid").select("scene_id", F.col("id").alias("demand"), F.col("flow").alias("need"))
    spots = valid.join(points.select("scene_id", F.col("id").alias("demand"), F.col("p").alias("dp")), ["scene_id", "demand"])
    spot = F.struct(F.round("dp.x", 5).alias("x"), F.round("dp.y", 5).alias("y"))
    spots = cut(spots.withColumn("spot", spot))
    leaf = spots.groupBy("scene_id", "spot").agg(F.sum("need").alias("need"), F.collect_set("demand").alias("at"))  # consumers at one point
    leaf = cut(leaf)
    down = cut(way.withColumn("node", F.element_at(F.split("down", "\u0001"), -1)))
    leaves = cut(down.join(spots.select("scene_id", F.col("demand").alias("node"), "spot"), ["scene_id", "node"]).select(*BY, "id", "down", "spot"))
    carried = down.select(*BY, "id", "up", "down").join(leaves.join(leaf, ["scene_id", "spot"]).select(*BY, "id", "need"), [*BY, "id"], "left")
    above = way.select(F.col("down").alias("up"), F.col("id").alias("above"))
    tree_edges = cut(carried.join(above, "up", "left").join(r.lines.select(*BY, "id", "length"), [*BY, "id"]).select(_key(*BY, "id").alias("edge"), F.when(F.col("above").isNotNull(), _key(*BY, "above")).alias("parent"), "length", F.coalesce("need", F.lit(0)).cast("decimal(18,6)").alias("demand")))
    sized = cut(tree.path_diameters(tree_edges.withColumn("demand", F.col("demand").cast("decimal(18,2)"))).withColumnRenamed("flow", "_f"))
    flows = tree.climb(tree_edges, "edge", below={"demand": "sum"}).select(F.col("node").alias("edge"), F.col("demand").alias("sum"))
    checked = cut(r.lines.withColumn("edge", _key(*BY, "id")).join(flows, "edge").join(sized.select("edge", F.col("dn").alias("least")), "edge"))
    found = [
        _row(checked.where("flow is null or flow <> sum"), "VALUE_MISMATCH", F.concat(F.lit("flow_tph "), F.col("sum").cast("string"))),
        _row(checked.where("least is null"), "LENGTH_LIMIT"),
        _row(checked.where("dn <> least"), "DIAMETER", F.col("least")),
    ]
    shaped = way.join(r.lines.select(*BY, "id", "points", "start"), [*BY, "id"])
    forward = F.element_at(F.split("up", "\u0001"), -1) == F.col("start")
    shaped = shaped.withColumn("points", F.when(forward, F.col("points")).otherwise(F.reverse("points"))).select(*BY, "id", "up", "down", "points")
    pairs = shaped.select(F.col("up").alias("down"), *BY, "id", F.col("points").alias("q")).join(shaped.select("down", F.col("points").alias("p")), "down")
    found.append(_row(pairs.where(turn(F.element_at("p", -2), F.element_at("p", -1), F.element_at("q", 2)) > TURN), "TURN_ANGLE", "at its node"))
    done.append(_written(found))

    # nodes
    met = cut(roots.join(degree, [*BY, "node"], "left").withColumn("rays", F.coalesce("rays", F.lit(0))))
    found = [_row(met.where(F.col("rays") + F.col("met") > RAYS), "NODE_DEGREE", F.col("rays") + F.col("met"), "node")]
    free = old.where("met < 4 and met > 0").select("scene_id", F.col("node").alias("camera"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("met").alias("camera_met"))
    near = spatial.near(ties.select(*BY, "node", "x", "y"), free, at(RADIUS), tuple(F.col(c) for c in ("cx", "cy", "cx", "cy")), CELL, ["scene_id"])
    near = near.where(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= RADIUS + 1e-6).join(degree.select(*BY, "node", F.col("rays")), [*BY, "node"]).join(degree.select(*BY, F.col("node").alias("camera"), F.col("rays").alias("camera_rays")), [*BY, "camera"], "left")
    found.append(_row(near.where(F.col("camera_met") + F.coalesce("camera_rays", F.lit(0)) + F.col("rays") <= RAYS), "NEARBY_CHAMBER", F.col("camera"), "node"))
    own_nodes = cut(r.nodes.withColumnRenamed("id", "node").join(degree, [*BY, "node"], "left").join(ties.select(*BY, "node", "pipe_dn"), [*BY, "node"], "left").withColumn("rays", F.coalesce("rays", F.lit(0))))
    technical, chamber = own_nodes.where("object_type = 'technical_node'"), own_nodes.where("object_type = 'heat_chamber'")
    right = F.greatest(F.coalesce("top_dn", F.lit(50)), F.col("pipe_dn"))
    found += [
        _row(technical.where("rays <> 2"), "TECHNICAL_BRANCH", F.col("rays"), "node"),
        _row(chamber.where("rays < 1 or rays > 4 or (pipe_dn is null and rays < 3)"), "CHAMBER_DEGREE", F.col("rays"), "node"),
        _row(chamber.where(F.col("dn") != right), "CHAMBER_DN", right, "node"),
        _row(chamber.where(F.col("cost") != catalog.chamber_price(F.col("dn"))), "VALUE_MISMATCH", "cost", "node"),
    ]
    done.append(_written(found))

    # consumers
    linked = leaves.join(leaf.select("scene_id", "spot", F.explode("at").alias("demand")), ["scene_id", "spot"]).select(*BY, "demand").distinct()
    transit = down.select(*BY, "node", "down").join(way.select(F.col("up").alias("down")).distinct(), "down").join(valid.select("scene_id", F.col("demand").alias("node")), ["scene_id", "node"])
    found = [_row(transit, "DEMAND_TRANSIT", "", "node")]
    all_demands = variants.join(demands.select("scene_id", F.col("id").alias("demand"), "id_type", F.coalesce("flow", F.lit(0)).alias("need")), "scene_id")
    missed = cut(all_demands.join(linked, [*BY, "demand"], "left_anti"))
    said = r.summaries.select(*BY, F.explode("unconnected").alias("u")).select(*BY, F.col("u.id").alias("demand"), F.col("u.kind").alias("kind"))
    differ = missed.join(said, [*BY, "demand"], "full").where("kind is null or id_type is null or (kind = 'STRING') <> (id_type = 'STRING')")
    found.append(_row(differ, "UNCONNECTED_IDS", "", "demand"))
    done.append(_written(found))

    # totals
    money = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(24,2)")
    price = catalog.of_pipe(F.col("dn"), "new_price", "decimal(12,2)")
    factor = r.lines.where("depth_start is not null and method = 'base'")
    plain = r.lines.where((F.col("depth_start").isNull()) & (F.col("method") == "base") & (F.col("cost") != pricing.money(F.col("length") * price)))
    deep = factor.where(F.abs(F.col("cost") - pricing.money((F.col("length") * price).cast("double") * pricing.depth_factor(F.col("depth_start"), F.col("depth_end")))) > 0.01)
    found = [_row(plain, "VALUE_MISMATCH", "cost"), _row(deep, "VALUE_MISMATCH", "cost")]
    sums = variants.join(r.lines.groupBy(*BY).agg(F.sum("cost").alias("pipes"), F.sum("length").alias("length")), BY, "left")
    sums = sums.join(chamber.groupBy(*BY).agg(F.sum("cost").alias("chambers")), BY, "left").join(met.where("old").groupBy(*BY).agg(F.sum("rays").alias("ties")), BY, "left")
    sums = sums.join(missed.groupBy(*BY).agg(F.sum(pricing.penalty(F.col("need"))).alias("penalty")), BY, "left")
    ties_cost = F.coalesce("ties", F.lit(0)) * catalog.TIE_IN_PRICE
    sums = sums.withColumns({"_built": money("pipes") + money("chambers") + ties_cost, "_length": F.coalesce("length", F.lit(0)).cast("decimal(28,9)")})
    sums = sums.withColumn("_cost", (F.col("_built") + money("penalty")).cast("decimal(24,2)"))
    right_of = {
        "construction_cost": F.col("_built"), "chamber_construction_cost": money("chambers"), "existing_chamber_tie_in_cost": ties_cost,
        "unconnected_penalty": money("penalty"), "calculated_cost": F.col("_cost"), "new_network_length": F.col("_length"),
        "existing_chamber_tie_in_count": F.coalesce("ties", F.lit(0)), "score": pricing.score(F.col("_cost"), F.col("_length")),
    }
    sums = cut(sums.select(*BY, *[v.alias(f"_{k}") for k, v in right_of.items()]))
    wrong = [F.when(~F.coalesce(F.col(k) == F.col(f"_{k}"), F.lit(False)), F.concat(F.lit(f"{k} "), F.col(f"_{k}").cast("string"))) for k in right_of]
    told = r.summaries.join(sums, BY).select(*BY, "id", F.explode(F.array_compact(F.array(*wrong))).alias("said"))
    found.append(_row(told, "VALUE_MISMATCH", F.col("said")))
    order = Window.partitionBy("scene_id").orderBy("rank", "variant_id")
    ranks = r.summaries.withColumns({"_nth": F.row_number().over(order), "_before": F.lag("score").over(order)})
    found.append(_row(ranks.where("rank <> _nth or score < _before"), "RANK", F.col("_nth")))
    done.append(_written(found))

    done += [_written(clearances(r.lines, scenes)), _written(intersections(r.lines)), _written(depths(r.lines))]
    return _union(done)


def _sides(lines: DataFrame) -> DataFrame:
    side = F.transform(F.sequence(F.lit(2), F.size("points")), lambda i: F.struct(F.element_at("points", i - 1).alias("a"), F.element_at("points", i).alias("b")))
    rows = lines.select(*BY, "id", "dn", "start", "end", (F.size("points") - 2).alias("last"), F.posexplode(side).alias("seq", "_s"))
    return rows.select(*BY, "id", "dn", "start", "end", "seq", (F.col("seq") == F.col("last")).alias("last"), F.col("_s.a.x").alias("ax"), F.col("_s.a.y").alias("ay"), F.col("_s.b.x").alias("bx"), F.col("_s.b.y").alias("by"))


def _in_cells(sides: DataFrame, margin: float) -> tuple[DataFrame, int]:
    """Sides in the cells within `margin` of them, and the width of a cell: CELL, or more where sides are so long on
    the average that each would pass dozens of cells."""
    mean = sides.agg(F.avg(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay")))).first()[0]
    cell = max(CELL, int((mean or 0) / 16))
    return spatial.along(sides, cell, margin, "by"), cell


def clearances(lines: DataFrame, scenes: geojson.Scenes) -> list[DataFrame]:
    """Lines nearer to an object than it and their diameter ask for. Objects that may be crossed may be crossed, at
    45 degrees or more if they are a road or tracks; a consumer's own building may be entered by its last side."""
    widest = 9 + 1.725 + 0.2
    walls = geojson.segments(scenes.parts.join(scenes.objects.where("kind is not null").select("scene_id", "id"), ["scene_id", "id"], "left_semi"))
    walls = walls.join(scenes.objects.select("scene_id", "id", "kind", F.col("dn").alias("wall_dn")), ["scene_id", "id"]).withColumnRenamed("id", "wall").drop("part", "ring", "seq")
    # a pair that meets in several cells counts once, as below only maxima are taken of it
    at, cell = _in_cells(_sides(lines).drop("last"), widest)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell).cast("long"), F.floor(F.greatest(a, b) / cell).cast("long")))
    pairs = at.join(walls.withColumn("_cx", span("x1", "x2")).withColumn("_cy", span("y1", "y2")).hint("merge"), ["scene_id", "_cx", "_cy"]).drop("_cx", "_cy")
    p = lambda x, y: (F.col(x), F.col(y))
    quad = (p("ax", "ay"), p("bx", "by"), p("x1", "y1"), p("x2", "y2"))
    own = F.coalesce(catalog.of_pipe(F.col("wall_dn"), "width", "decimal(6,3)"), catalog.by_kind(F.col("kind"), catalog.OWN_WIDTH, "0"))
    required = catalog.required_distance(F.col("kind"), F.col("dn"), own).cast("double")
    pairs = pairs.withColumns({"gap": F.sqrt(geometry.gap2(*quad)), "required": required, "hit": geometry.crosses(*quad), "steep": geometry.steep(*quad)})
    special = F.col("kind").isin(*catalog.FACTOR)
    crossed = F.max(F.col("hit")).over(Window.partitionBy("scene_id", "variant_id", "id", "seq", "wall"))
    pairs = cut(pairs.withColumn("crossed", crossed).where(F.col("gap") < F.col("required") - 1e-6))
    ends_at = scenes.objects.where("object_type = 'oks_connection_point'").join(scenes.parts, ["scene_id", "id"])
    ends_at = ends_at.select("scene_id", F.col("id").alias("point"), F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][0]["y"].alias("y"))
    rings = walls.where("kind = 'building'").select("scene_id", F.col("wall").alias("ring"), "x1", "y1", "x2", "y2")
    hosts = spatial.inside(ends_at, rings, CELL, ["scene_id"]).select("scene_id", F.col("point").alias("end"), F.col("ring").alias("wall"))
    entries = _sides(lines).where("last").join(hosts, ["scene_id", "end"]).select(*BY, "id", "seq", "wall")
    pairs = pairs.join(entries, [*BY, "id", "seq", "wall"], "left_anti")
    found = pairs.groupBy(*BY, "id", "wall", "kind").agg(F.max(~special).alias("shut"), F.max(special & ~F.col("crossed")).alias("beside"), F.max(F.col("hit") & ~F.col("steep") & F.col("kind").isin("road", "tram_tracks")).alias("flat"))
    return [_row(found.where("shut"), "CLEARANCE", F.col("wall")), _row(found.where("beside"), "SPECIAL_CORRIDOR", F.col("wall")), _row(found.where("flat"), "CROSSING_ANGLE", F.col("wall"))]


def intersections(lines: DataFrame) -> list[DataFrame]:
    """New lines that cross each other, or that lie too near without a common node; lines that cross themselves.

    Sides that begin or end at one node, at the very same point, neither cross nor lie too near, however many a node
    has. So in each cell the node with most sides is its hub, and only pairs with a side that is not at the hub are
    formed: the pipes of a star, all within a few metres of each other around it, meet nothing.
    """
    end = lambda c, x, y: F.struct(F.col(c).alias("node"), F.col(x).alias("x"), F.col(y).alias("y"))
    ends = F.array_compact(F.array(F.when(F.col("seq") == 0, end("start", "ax", "ay")), F.when(F.col("last"), end("end", "bx", "by"))))
    sides = _sides(lines).withColumn("ends", ends).drop("last")
    half = max(float(p[7]) for p in catalog.PIPES) / 2 + 0.01  # what lies between two sides of too near pipes is this near to both
    at = cut(_in_cells(sides, half)[0])
    here = [*BY, "_cx", "_cy"]
    hub = at.select(*here, F.explode("ends").alias("hub")).where("hub.node is not null").groupBy(*here, "hub").agg(F.count("*").alias("n")).groupBy(*here).agg(F.max(F.struct("n", "hub"))["hub"].alias("hub"))
    at = cut(at.join(hub, here, "left").withColumn("at_hub", F.coalesce(F.array_contains("ends", F.col("hub")), F.lit(False))).drop("hub", "ends"))
    b = at.select(*here, *[F.col(c).alias(f"o_{c}") for c in ("id", "dn", "start", "end", "seq", "ax", "ay", "bx", "by", "at_hub")])
    pairs = at.where("not at_hub").drop("at_hub").join(b.hint("merge"), here).drop("_cx", "_cy")
    # of two sides not at the hub both orders occur
    pairs = pairs.where("case when o_at_hub then id <> o_id or abs(seq - o_seq) > 1 else id < o_id or (id = o_id and seq + 1 < o_seq) end")
    p = lambda x, y: (F.col(x), F.col(y))
    quad = (p("ax", "ay"), p("bx", "by"), p("o_ax", "o_ay"), p("o_bx", "o_by"))
    width = (catalog.of_pipe(F.col("dn"), "width", "double") + catalog.of_pipe(F.col("o_dn"), "width", "double")) / 2
    joint = (F.col("start") == F.col("o_start")) | (F.col("start") == F.col("o_end")) | (F.col("end") == F.col("o_start")) | (F.col("end") == F.col("o_end"))
    pairs = pairs.withColumns({"hit": geometry.crosses(*quad), "near": geometry.gap2(*quad) < width * width, "joint": joint}).where("hit or near")
    pairs = cut(pairs.select(*BY, F.least("id", "o_id").alias("id"), F.greatest("id", "o_id").alias("o_id"), "hit", "near", "joint"))
    other = F.col("o_id")
    return [
        _row(pairs.where("hit and id = o_id").dropDuplicates([*BY, "id"]), "SELF_INTERSECTION"),
        _row(pairs.where("hit and id <> o_id").dropDuplicates([*BY, "id", "o_id"]), "NEW_INTERSECTION", other),
        _row(pairs.where("near and not hit and not joint and id <> o_id").dropDuplicates([*BY, "id", "o_id"]), "NEW_GABARIT_OVERLAP", other),
    ]


def depths(lines: DataFrame, cover: float = 0.7, slope: float = 0.1, split: float = 3.0) -> list[DataFrame]:
    """Depths of a profile: cover, slope, ramps through the split depth, and one depth at a node."""
    d = lines.where("depth_start is not null and depth_end is not null")
    h = F.abs(F.col("depth_end") - F.col("depth_start"))
    both = F.explode(F.array(F.struct(F.col("start").alias("node"), F.col("depth_start").alias("h")), F.struct(F.col("end").alias("node"), F.col("depth_end").alias("h"))))
    at = d.select(*BY, both.alias("_e")).select(*BY, "_e.*").groupBy(*BY, "node").agg((F.max("h") - F.min("h")).alias("spread"))
    return [
        _row(d.where(F.least("depth_start", "depth_end") < cover - 1e-6), "DEPTH_COVER"),
        _row(d.where(h > slope * F.col("length").cast("double") + 1e-6), "DEPTH_SLOPE"),
        _row(d.where((F.col("depth_start") - split) * (F.col("depth_end") - split) < -1e-9), "DEPTH_SPLIT"),
        _row(at.where("spread > 1e-6"), "DEPTH_CONTINUITY", F.col("spread"), "node"),
    ]
