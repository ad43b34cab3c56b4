"""Evidence for incidents in a building: alarms, common shift, losses, suspect spans, timelines and nested packets.

Everything is a relation keyed by ``incident``, so all incidents of all scenarios are worked on at once. The building's graph is small (some
hundred assets); its closure is computed once and cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import clock
from rillflow.functions.lineage import cut
from rillflow.operators import graph

LINKS = ("pipe", "pump", "valve")
TANKS = ("roof_tank", "sump")


@dataclass(frozen=True)
class Retrieval:
    """Limits of an evidence packet; hops and caps are features of the packet, not of the search."""

    max_seeds: int = 25
    hops: int = 2
    max_normal_sensors: int = 30
    local_sigma: float = 4.0
    lookback_hours: int = 3
    minor_fraction: float = 0.25
    dry_expected: float = 2.0
    dry_share: float = 0.25
    dry_level: float = 1.0


class Building:
    """One supply network for all incidents (a ``PacketView`` has one for each, keyed by the columns ``by``).

    assets(asset_id, kind, role, label, room, flat, floor, and maybe diameter in m), feeds(child, parent) over nodes and links, sensors(sensor_id, asset_id, parameter)."""

    by: tuple[str, ...] = ()

    def __init__(self, assets: DataFrame, feeds: DataFrame, sensors: DataFrame, name: str = "building"):
        self.assets, self.feeds, self.sensors, self.name = assets, feeds, sensors, name

    @cached_property
    def closure(self) -> DataFrame:
        """(ancestor, descendant, distance), each asset with itself at 0, the source too."""
        roots = self.feeds.select("parent").distinct().join(self.feeds.select(F.col("child").alias("parent")), "parent", "left_anti")
        own = roots.select(F.col("parent").alias("ancestor"), F.col("parent").alias("descendant"), F.lit(0).alias("distance"))
        return cut(graph.supply_closure(self.feeds).union(own))

    @cached_property
    def depth(self) -> DataFrame:
        return self.closure.groupBy(F.col("descendant").alias("asset_id")).agg(F.max("distance").alias("depth"))

    @cached_property
    def line_pressure(self) -> DataFrame:
        """(asset_id): nodes with a pressure sensor that aren't tanks, whose pressure is a level."""
        on = self.sensors.where("parameter = 'pressure'").select("asset_id").distinct()
        return self.assets.where(~F.coalesce("role", F.lit("")).isin(*TANKS) & ~F.col("kind").isin(*LINKS)).select("asset_id").join(on, "asset_id", "left_semi")

    @cached_property
    def metered(self) -> DataFrame:
        return self.sensors.select("asset_id").distinct()


def alarms(candidates: DataFrame, building: Building, config: Retrieval = Retrieval()) -> DataFrame:
    """The strongest channel of each known asset of candidates(incident, position, asset_id, parameter, score, residual, first_seen_s, peak_at_s)."""
    known = candidates.join(building.assets.select("asset_id"), "asset_id", "left_semi")
    first = graph.ranked_first(known, ["incident", "asset_id"], "position")
    order = F.row_number().over(Window.partitionBy("incident").orderBy("position"))
    rows = first.withColumn("_n", order).where(F.col("_n") <= config.max_seeds)
    return rows.select("incident", "asset_id", "parameter", "score", "residual", "first_seen_s", "peak_at_s", F.lit(False).alias("early"))


def _within(events: DataFrame, heads: DataFrame, begin: Column, end: Column, width: int) -> DataFrame:
    """Events of each incident's scenario from begin to end, both included, with ``incident``: an equi-join on stretches of ``width`` seconds."""
    stretch = F.explode(F.sequence(F.floor(F.col("_begin") / width), F.floor(F.col("_end") / width)))
    spans = heads.select("incident", "scenario", begin.alias("_begin"), end.alias("_end")).withColumn("_stretch", stretch)
    rows = events.withColumn("_stretch", F.floor(F.col("timestamp_s") / width)).join(spans, ["scenario", "_stretch"])
    return rows.where(F.col("timestamp_s").between(F.col("_begin"), F.col("_end"))).drop("_stretch", "_begin", "_end")


def early_alarms(named: DataFrame, heads: DataFrame, events: DataFrame, building: Building, config: Retrieval = Retrieval()) -> DataFrame:
    """Flags shortly before an incident of assets that it does not name, the strongest of each; heads(incident, scenario, detected_at_s)."""
    back = config.lookback_hours * 3600
    rows = _within(events, heads, F.col("detected_at_s") - back, F.col("detected_at_s") - 1, back)
    rows = rows.join(building.assets.select("asset_id"), "asset_id", "left_semi").join(named.select("incident", "asset_id"), ["incident", "asset_id"], "left_anti")
    best = F.max_by(F.struct("parameter", "score", "residual", F.col("timestamp_s").alias("peak_at_s")), F.struct("score", -F.col("timestamp_s")))
    out = rows.groupBy("incident", "asset_id").agg(best.alias("b"), F.min("timestamp_s").alias("first_seen_s"))
    return out.select("incident", "asset_id", "b.parameter", "b.score", "b.residual", "first_seen_s", "b.peak_at_s", F.lit(True).alias("early"))


def common_shift(alarm_rows: DataFrame, building: Building) -> DataFrame:
    """(incident, shift): the median over all line-pressure sensors, with 0 for those without an alarm: zeros are counted, not joined."""
    lines = building.line_pressure
    pressure = alarm_rows.where("parameter = 'pressure'").join(lines, "asset_id", "left_semi")
    own = pressure.groupBy("incident").agg(F.collect_list("residual").alias("r"))
    every = alarm_rows.select("incident").distinct().join(own, "incident", "left").crossJoin(lines.agg(F.count(F.lit(1)).alias("n")))  # one row
    r = F.coalesce("r", F.array().cast("array<double>"))
    padded = F.array_sort(F.concat(r, F.array_repeat(F.lit(0.0), F.greatest(F.col("n") - F.size(r), F.lit(0)).cast("int"))))
    middle = (F.get(padded, F.floor((F.size(padded) - 1) / 2).cast("int")) + F.get(padded, F.floor(F.size(padded) / 2).cast("int"))) / 2
    return every.select("incident", F.when(F.size(padded) > 0, middle).alias("shift"))


def classified(alarm_rows: DataFrame, events: DataFrame, heads: DataFrame, building: Building, config: Retrieval = Retrieval()) -> DataFrame:
    """Alarms with role, whether they only follow the common shift, and whether they are extra flow, a tank's level, or a (major, dry) pressure loss."""
    rows = alarm_rows.join(common_shift(alarm_rows, building), "incident")
    rows = rows.join(building.assets.select("asset_id", "kind", "role", "flat", "room", "label"), "asset_id")
    rows = rows.join(building.line_pressure.withColumn("_line", F.lit(True)), "asset_id", "left")
    pressure = F.col("parameter") == "pressure"
    sigma = F.abs("residual") / F.greatest("score", F.lit(1e-9))
    common = F.coalesce("_line", F.lit(False)) & pressure & (F.abs(F.col("residual") - F.col("shift")) < config.local_sigma * sigma)
    rows = rows.withColumn("common", common).withColumn("tank", ~F.col("common") & pressure & F.coalesce(F.col("role").isin(*TANKS), F.lit(False)))
    rows = rows.withColumn("loss", ~F.col("common") & ~F.col("tank") & pressure & (F.col("residual") < 0))
    rows = rows.withColumn("extra", ~F.col("common") & (F.col("parameter") == "flowrate") & (F.col("residual") > 0))
    low = F.greatest(F.lit(config.dry_level), config.dry_share * F.col("expected"))
    dried = events.where(F.col("parameter") == "pressure").where((F.col("expected") > config.dry_expected) & (F.col("observed") <= low))
    dried = dried.select("scenario", "asset_id").distinct().join(heads.select("incident", "scenario"), "scenario").select("incident", "asset_id", F.lit(True).alias("_dry"))
    rows = rows.join(dried, ["incident", "asset_id"], "left").withColumn("dry", F.col("loss") & F.coalesce("_dry", F.lit(False)))
    largest = F.max(F.when(F.col("loss"), F.abs("residual"))).over(Window.partitionBy("incident"))
    rows = rows.withColumn("_largest", largest)
    major = F.col("loss") & (F.col("dry") | (F.abs("residual") >= config.minor_fraction * F.col("_largest")))
    # a row for each alarm of an incident: small, and the start of every fact and rule
    return cut(rows.withColumn("major", major).drop("_line", "_dry", "_largest"))


def _groups(rows: DataFrame, condition: str) -> DataFrame:
    return rows.where(condition).select(F.col("incident").alias("grp"), F.col("asset_id").alias("member"))


def _up(building: Building) -> tuple[DataFrame, list[str]]:
    """(member, ancestor, distance), with ``grp`` where each group has its own network, and the keys to join members on."""
    own = ["grp"] if building.by else []
    return building.closure.select(*(F.col(c).alias("grp") for c in building.by), F.col("descendant").alias("member"), "ancestor", "distance"), [*own, "member"]


def common_point(groups: DataFrame, building: Building) -> DataFrame:
    """(grp, common): the deepest asset on all members' ways up, from the closure; no row where the members share none."""
    members = groups.distinct()
    up, keys = _up(building)
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    shared = members.join(up, keys).groupBy("grp", "ancestor").agg(F.count(F.lit(1)).alias("met"), F.sum("distance").alias("total"))
    return shared.join(size, "grp").where("met = n").groupBy("grp").agg(F.min_by("ancestor", "total").alias("common"))


def deepest(groups: DataFrame, building: Building) -> DataFrame:
    members = groups.distinct()
    up, keys = _up(building)
    below = members.join(up.where("distance > 0"), keys).select("grp", F.col("ancestor").alias("member"))
    return members.join(below.distinct(), ["grp", "member"], "left_anti")


def low_tank_chains(rows: DataFrame, building: Building) -> DataFrame:
    """(incident, tank, asset_id, distance): from a low tank up to the first metered asset, or the source."""
    low = rows.where("tank AND residual < 0").select("incident", F.col("asset_id").alias("tank"))
    up = low.join(building.closure, F.col("tank") == F.col("descendant")).select("incident", "tank", F.col("ancestor").alias("asset_id"), "distance")
    up = up.join(building.metered.withColumn("_m", F.lit(True)), "asset_id", "left")
    stop = F.min(F.when(F.col("_m") & (F.col("distance") > 0), F.col("distance"))).over(Window.partitionBy("incident", "tank"))
    return up.withColumn("_stop", stop).where("_stop IS NULL OR distance <= _stop").select("incident", "tank", "asset_id", "distance")


def suspect_spans(rows: DataFrame, building: Building) -> tuple[DataFrame, DataFrame]:
    """(incident, asset_id, position) from the losses' common point upwards, and (incident, common, bound).

    The walk stops below the first node that also feeds a healthy sensor (the bound), or at the first metered asset; then only the
    next node above is looked at for a bound.
    """
    anchors = common_point(_groups(rows, "major"), building).select(F.col("grp").alias("incident"), F.col("common").alias("anchor"))
    anchors = cut(anchors)
    c = building.closure
    path = anchors.join(c, F.col("anchor") == F.col("descendant")).where("distance > 0").select("incident", "anchor", F.col("ancestor").alias("asset_id"), "distance")
    kind = building.assets.select("asset_id", F.col("kind").isin(*LINKS).alias("link"))
    path = path.join(kind, "asset_id").join(building.metered.withColumn("_m", F.lit(True)), "asset_id", "left")
    # an asset feeds a healthy sensor if more sensors are below it than those that lie below the anchor or lose pressure
    lines = building.line_pressure.withColumnRenamed("asset_id", "sensor")
    fed = c.where("distance > 0").select(F.col("descendant").alias("sensor"), F.col("ancestor").alias("asset_id")).join(lines, "sensor")
    below = anchors.join(c, F.col("anchor") == F.col("ancestor")).select("incident", F.col("descendant").alias("sensor"))
    bad = below.union(rows.where("major").select("incident", F.col("asset_id").alias("sensor"))).distinct()
    bad = bad.join(fed, "sensor").groupBy("incident", "asset_id").agg(F.count(F.lit(1)).alias("_bad"))
    path = path.join(fed.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_fed")), "asset_id", "left").join(bad, ["incident", "asset_id"], "left")
    path = path.withColumn("_h", F.coalesce("_fed", F.lit(0)) > F.coalesce("_bad", F.lit(0)))
    w = Window.partitionBy("incident")
    node_ok = ~F.col("link") & F.coalesce("_h", F.lit(False))
    path = path.withColumn("_b", F.min(F.when(node_ok, F.col("distance"))).over(w)).withColumn("_meter", F.min(F.when(F.col("_m"), F.col("distance"))).over(w))
    path = path.withColumn("_above", F.min(F.when(~F.col("link") & (F.col("distance") > F.col("_meter")), F.col("distance"))).over(w))
    stops = F.col("_b").isNotNull() & (F.col("_meter").isNull() | (F.col("_b") <= F.col("_meter")))
    inside = F.when(stops, F.col("distance") < F.col("_b")).when(F.col("_meter").isNotNull(), F.col("distance") <= F.col("_meter")).otherwise(F.lit(True))
    is_bound = F.when(stops, F.col("distance") == F.col("_b")).otherwise((F.col("distance") == F.col("_above")) & (F.col("_above") == F.col("_b")))
    path = cut(path.select("incident", "asset_id", "distance", inside.alias("inside"), F.coalesce(is_bound, F.lit(False)).alias("bound")))
    span = path.where("inside").select("incident", "asset_id", F.col("distance").alias("position")).union(
        anchors.select("incident", F.col("anchor"), F.lit(0)))
    found = path.where("bound").groupBy("incident").agg(F.min_by("asset_id", "distance").alias("bound"))
    return cut(span), cut(anchors.select("incident", F.col("anchor").alias("common")).join(found, "incident", "left"))


def timelines(alarm_rows: DataFrame, events: DataFrame, heads: DataFrame, config: Retrieval = Retrieval()) -> DataFrame:
    """The flagged readings of each alarm from the look-back to the incident's end: (incident, asset_id, timestamp_s, deviation, observed, expected)."""
    back = config.lookback_hours * 3600
    rows = _within(events, heads, F.col("detected_at_s") - back, F.col("last_seen_s"), back)
    keys = ["incident", "asset_id", "parameter"]
    return rows.join(alarm_rows.select(*keys), keys, "left_semi").select(*keys, "timestamp_s", F.col("residual").alias("deviation"), "observed", "expected")


def elided(points: Column, head: int = 5, tail: int = 2, most: int = 8) -> Column:
    """An array of texts with the middle of a long one left out."""
    short = F.concat(F.slice(points, 1, head), F.array(F.lit("...")), F.slice(points, F.greatest(F.size(points) - tail + 1, F.lit(1)), tail))
    return F.when(F.size(points) > most, short).otherwise(points)


def series_texts(series: DataFrame) -> DataFrame:
    """(incident, asset_id, series): each alarm's deviations by hour as texts, in L/s or m, long ones elided."""
    flow = F.col("parameter") == "flowrate"
    text = F.when(flow, F.format_string("%s %+.4f", clock(F.col("timestamp_s")), F.bround(F.col("deviation") * 1000, 4))).otherwise(
        F.format_string("%s %+.1f", clock(F.col("timestamp_s")), F.bround("deviation", 1)))
    rows = series.select("incident", "asset_id", F.struct("timestamp_s", text.alias("t")).alias("p"))
    return rows.groupBy("incident", "asset_id").agg(elided(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"])).alias("series"))


def first_alarm_sequence(rows: DataFrame) -> DataFrame:
    """(incident, sequence): hour by hour, the assets that went off first, with quantity and direction."""
    quantity = F.when(F.coalesce(F.col("role").isin(*TANKS), F.lit(False)), "level").otherwise(F.col("parameter"))
    text = F.concat_ws(" ", "asset_id", quantity, F.when(F.col("residual") > 0, "up").otherwise("down"))
    hours = rows.groupBy("incident", "first_seen_s").agg(F.array_sort(F.collect_list(text)).alias("t"))
    line = F.concat(clock(F.col("first_seen_s")), F.lit(": "), F.array_join("t", ", "))
    return hours.groupBy("incident").agg(F.array_sort(F.collect_list(F.struct("first_seen_s", line.alias("line")))).alias("s")).select("incident", F.col("s.line").alias("sequence"))


def context(rows: DataFrame, span: DataFrame, bounds: DataFrame, chains: DataFrame, building: Building, config: Retrieval = Retrieval()) -> DataFrame:
    """(incident, asset_id): alarms, anchors with their ways up and surroundings, and the rest of the anchors' flats."""
    leaves = deepest(_groups(rows, "extra"), building).select(F.col("grp").alias("incident"), F.col("member").alias("asset_id"))
    taps = leaves.join(building.feeds, F.col("asset_id") == F.col("parent")).select("incident", F.col("child").alias("asset_id"))
    anchors = leaves.union(taps).union(span.select("incident", "asset_id")).union(chains.select("incident", "asset_id"))
    anchors = anchors.union(bounds.where("bound IS NOT NULL").select("incident", F.col("bound").alias("asset_id"))).distinct()
    # with nothing localised, the common point of the deepest alarms is the anchor
    lost = rows.select("incident").distinct().join(anchors.select("incident").distinct(), "incident", "left_anti")
    rest = rows.join(lost, "incident", "left_semi").select(F.col("incident").alias("grp"), F.col("asset_id").alias("member"))
    fallback = common_point(deepest(rest, building), building).select(F.col("grp").alias("incident"), F.col("common").alias("asset_id"))
    anchors = cut(anchors.union(fallback))
    ways = anchors.join(building.closure, F.col("asset_id") == F.col("descendant")).select("incident", F.col("ancestor").alias("asset_id"))
    arcs = building.feeds.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    arcs = arcs.union(arcs.select("dst", "src"))
    near = graph.reach(arcs, anchors.select(F.col("asset_id").alias("node")), config.hops).select(F.col("seed").alias("asset_id"), "node")
    around = anchors.join(near, "asset_id").select("incident", F.col("node").alias("asset_id"))
    flats = anchors.join(building.assets.select("asset_id", "flat"), "asset_id").where("flat IS NOT NULL").select("incident", "flat").distinct()
    home = flats.join(building.assets.select("asset_id", "flat"), "flat").select("incident", "asset_id")
    return cut(rows.select("incident", "asset_id").union(ways).union(around).union(home).distinct())


def focus(rows: DataFrame, span: DataFrame, chains: DataFrame, building: Building) -> DataFrame:
    """(incident, asset_id): where the topology points: the deepest assets with extra flow and what they feed, the suspect span, the ways up from low tanks."""
    leaves = deepest(_groups(rows, "extra"), building).select(F.col("grp").alias("incident"), F.col("member").alias("asset_id"))
    taps = leaves.join(building.feeds, F.col("asset_id") == F.col("parent")).select("incident", F.col("child").alias("asset_id"))
    return leaves.union(taps).union(span.select("incident", "asset_id")).union(chains.select("incident", "asset_id")).distinct()


def facts(rows: DataFrame, span: DataFrame, bounds: DataFrame, chains: DataFrame, building: Building) -> DataFrame:
    """(incident, facts): what the topology says of each incident's alarms; a part without alarms is null.

    Levels of tanks and the chains up from low ones, extra flow, pressure loss with its common point, span and bound, and the building-wide shift.
    """
    def names(condition: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.expr(condition), F.col("asset_id"))))

    leaves = deepest(_groups(rows, "extra"), building).select(F.col("grp").alias("incident"), F.col("member").alias("asset_id"))
    taps = building.feeds.join(building.assets.where(F.col("kind").isin(*LINKS)).select(F.col("asset_id").alias("parent")), "parent")
    below = leaves.join(taps, F.col("asset_id") == F.col("parent"), "left").groupBy("incident").agg(
        F.array_sort(F.collect_set("asset_id")).alias("leaves"), F.array_sort(F.collect_set("child")).alias("taps"))
    spans = span.groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "asset_id"))), lambda x: x["asset_id"]).alias("span"))
    ways = chains.groupBy("incident", "tank").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "asset_id"))), lambda x: x["asset_id"]).alias("way"))
    ways = ways.groupBy("incident").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tank", "way")))).alias("ways"))
    lines = building.line_pressure.agg(F.count(F.lit(1)).alias("lines"))
    level = F.format_string("%.2f m %s expectation", F.abs("residual"), F.when(F.col("residual") > 0, "above").otherwise("below"))
    about = rows.groupBy("incident").agg(
        names("major").alias("lost"), names("loss AND NOT major").alias("minor"), F.count_if("common").alias("shifted"), F.first("shift").alias("shift"),
        F.min(F.when(F.col("common"), F.col("residual"))).alias("least"), F.max(F.when(F.col("common"), F.col("residual"))).alias("most"),
        F.array_sort(F.collect_set(F.when(F.col("tank"), F.struct("asset_id", level.alias("level"))))).alias("levels"))
    out = about.crossJoin(F.broadcast(lines))  # one row
    for part in (below, spans, ways, bounds):
        out = out.join(part, "incident", "left")
    return out.select("incident", F.struct(
        F.when(F.size("levels") > 0, F.map_from_entries("levels")).alias("tank_level_change"), F.col("ways").alias("low_tank_supply_chain"),
        F.when(F.col("leaves").isNotNull(), F.struct(F.col("leaves").alias("deepest_assets_with_extra_flow"), F.col("taps").alias("supplied_through_them"))).alias("extra_flow"),
        F.when(F.size("lost") > 0, F.struct(
            F.col("lost").alias("assets_with_pressure_loss"), F.col("common").alias("common_supply_point"), F.col("span").alias("suspect_span_upward"),
            F.col("bound").alias("nearest_upstream_point_still_feeding_a_healthy_sensor"), F.col("minor").alias("minor_pressure_loss_not_used_for_localisation"))).alias("pressure_loss"),
        F.when(F.col("shifted") > 0, F.struct(
            F.col("shifted").alias("sensors_shifted"), F.col("lines").alias("of_line_pressure_sensors"), F.bround("shift", 2).alias("median_shift_m"),
            F.array(F.bround("least", 2), F.bround("most", 2)).alias("range_m"))).alias("building_wide_pressure_shift")).alias("facts"))


def packets(rows: DataFrame, near: DataFrame, series: DataFrame, heads: DataFrame, building: Building, config: Retrieval = Retrieval(),
            topology: DataFrame | None = None) -> DataFrame:
    """(incident, packet, allowed_ids, tokens): the nested evidence as JSON, the ids that a diagnosis may cite, and a size estimate.

    ``topology`` are the rows of ``facts``. Heads may carry a ``label``, which then names the incident in the packet instead of its key.
    """
    hourly = series.groupBy("incident", "asset_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_s", "deviation", "observed", "expected"))).alias("h"))
    scale = F.when(F.col("parameter") == "flowrate", 1000.0).otherwise(1.0)
    digits = lambda c: F.when(F.col("parameter") == "flowrate", F.bround(c * 1000.0, 4)).otherwise(F.bround(c, 1))
    fine = lambda c: F.bround(c * scale, 4)
    points = F.transform("h", lambda x: F.struct(clock(x["timestamp_s"]).alias("at"), (x["deviation"] * scale).alias("deviation"), fine(x["observed"]).alias("observed"), fine(x["expected"]).alias("expected")))
    top = F.get(F.filter("h", lambda x: x["timestamp_s"] == F.col("peak_at_s")), F.lit(0))
    unit = F.when(F.col("parameter") == "flowrate", "L/s").otherwise("m")
    size = F.when(F.col("parameter") == "flowrate", F.format_string("%.3f", F.abs("residual") * 1000)).otherwise(F.format_string("%.2f", F.abs("residual")))
    reading = F.concat_ws(" ", F.lit("peak"), size, unit, F.when(F.col("residual") > 0, "above").otherwise("below"), F.lit("expectation at"), clock(F.col("peak_at_s")))
    meter = building.sensors.groupBy("asset_id").agg(F.concat(F.lit("sensor:"), F.min("sensor_id")).alias("sensor"))
    status = F.when(F.col("common"), "alarm (building-wide shift)").when(F.col("early"), "alarm (before the incident)").otherwise("alarm")
    seen = rows.join(hourly, ["incident", "asset_id"], "left").join(meter, "asset_id", "left").select(
        "incident", "sensor", F.col("asset_id").alias("asset"), "parameter", status.alias("status"), reading.alias("reading"), F.bround("score", 1).alias("score"),
        digits(F.col("residual")).alias("peak_deviation"), unit.alias("unit"), clock(F.col("first_seen_s")).alias("first_seen"), clock(F.col("peak_at_s")).alias("peak_at"),
        fine(top["observed"]).alias("observed_at_peak"), fine(top["expected"]).alias("expected_at_peak"), points.alias("hourly"), F.lit(0).alias("_o"))
    quiet = near.join(rows.select("incident", "asset_id"), ["incident", "asset_id"], "left_anti").join(building.sensors, "asset_id").join(building.depth, "asset_id")
    n = F.row_number().over(Window.partitionBy("incident").orderBy("depth", "asset_id", "sensor_id"))
    quiet = quiet.withColumn("_o", n).where(F.col("_o") <= config.max_normal_sensors)
    seen = seen.unionByName(quiet.select("incident", F.concat(F.lit("sensor:"), "sensor_id").alias("sensor"), F.col("asset_id").alias("asset"), "parameter", F.lit("normal").alias("status"), "_o"),
                            allowMissingColumns=True)
    observations = seen.groupBy("incident").agg(F.array_sort(F.collect_list(F.struct("_o", *(c for c in seen.columns if c not in ("incident", "_o"))))).alias("observations"))
    known = building.assets.join(building.metered.withColumn("metered", F.lit(True)), "asset_id", "left").withColumn("metered", F.coalesce("metered", F.lit(False)))
    record = ["depth", "asset_id", "kind", "role", "label", "flat", "room", *(c for c in ("floor",) if c in known.columns), "metered"]
    if "diameter" in known.columns:
        known = known.withColumn("diameter_mm", F.when(F.col("kind").isin(*LINKS), F.bround(F.col("diameter") * 1000).cast("long")))
        record.append("diameter_mm")
    assets = near.join(known, "asset_id").join(building.depth, "asset_id").groupBy("incident").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*record))), lambda a: a.dropFields("depth")).alias("assets"),
        F.array_sort(F.collect_set("asset_id")).alias("_ids"))
    arcs = near.select("incident", F.col("asset_id").alias("parent")).join(building.feeds, "parent").join(near.select("incident", F.col("asset_id").alias("child")), ["incident", "child"])
    relations = arcs.groupBy("incident").agg(F.array_sort(F.collect_list(F.array("parent", F.lit("FEEDS"), "child"))).alias("relations"))
    sensors = near.join(building.sensors, "asset_id").groupBy("incident").agg(F.collect_set(F.concat(F.lit("sensor:"), "sensor_id")).alias("_sensors"))
    out = heads.join(observations, "incident").join(assets, "incident").join(relations, "incident", "left").join(sensors, "incident", "left").join(first_alarm_sequence(rows), "incident", "left")
    ids = F.array_sort(F.array_union("_ids", F.coalesce("_sensors", F.array().cast("array<string>"))))
    told = [] if topology is None else [F.col("facts").alias("topology_facts")]
    out = out if topology is None else out.join(topology, "incident", "left")
    body = F.to_json(F.struct(
        F.lit(building.name).alias("building"), F.struct(F.col("label" if "label" in heads.columns else "incident").alias("id"), clock(F.col("detected_at_s")).alias("first_alarm"), clock(F.col("last_seen_s")).alias("last_alarm"), "sequence").alias("incident"),
        F.transform("observations", lambda o: o.dropFields("_o")).alias("observations"), "assets", "relations", *told, ids.alias("allowed_ids")))
    return out.select("incident", body.alias("packet"), ids.alias("allowed_ids")).withColumn("tokens", F.floor(F.length("packet") / 4))


def truth_tokens(column: Column, tokens: list[str]) -> Column:
    """Whether a text names any of the tokens, in any case."""
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(column), F.lower(t)))
