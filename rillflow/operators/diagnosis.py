"""Rule-based diagnosis: five kinds of hypothesis as relations of one shape, a choice by window, and a check of every cited id."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import clock
from rillflow.functions.lineage import cut
from rillflow.operators import graph
from rillflow.operators.retrieval import LINKS, Building, _groups, common_point, deepest

# Fixed values of the rules.
DRY_M, MAJOR_LOSS_M, CORROBORATE, STOPPED, CREDIBLE, BURST_LPS = 1.0, 3.0, 0.5, 0.2, 0.5, 0.1
FAULT_TYPES = ("leak", "blockage", "pump_failure", "other")

SHAPE = ["incident", "generator", "fault_type", "kind", "root", "start_hour", "confidence", "affected", "step", "amount"]


def signs(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Alarms with their first hours up, down and at all, and their extremes in each direction; from the peak where there is no series."""
    hour = F.floor(F.col("timestamp_s") / 3600).cast("int")
    up = F.col("deviation") > 0
    point = F.struct("deviation", "observed", "expected")

    def furthest(side: Column) -> Column:  # the first of equals
        return F.max_by(F.when(side, point), F.when(side, F.struct(F.abs("deviation"), -F.col("timestamp_s"))))

    s = series.groupBy("incident", "asset_id").agg(
        F.min(F.when(up, hour)).alias("first_up"), F.min(F.when(~up, hour)).alias("first_down"), F.min(hour).alias("first_any"),
        furthest(up).alias("high"), furthest(~up).alias("low"), F.count_if(~up).alias("hours_down"))
    out = rows.join(s, ["incident", "asset_id"], "left")
    none, peak = F.col("first_any").isNull(), F.floor(F.col("first_seen_s") / 3600).cast("int")
    own = F.struct(F.col("residual").alias("deviation"), F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("expected"))
    positive = F.col("residual") > 0
    return out.withColumns({
        "first_up": F.when(none & positive, peak).otherwise(F.col("first_up")), "first_down": F.when(none & ~positive, peak).otherwise(F.col("first_down")),
        "high": F.when(none & positive, own).otherwise(F.col("high")), "low": F.when(none & ~positive, own).otherwise(F.col("low")),
        "first_any": F.coalesce("first_any", peak), "hours_down": F.coalesce("hours_down", F.lit(0)),
    })


def _hypothesis(df: DataFrame, generator: int, fault: str, kind: str, root, start, confidence, affected, step, amount=None) -> DataFrame:
    """``amount``: L/s of a leak, metres of a pressure loss."""
    return df.select(
        "incident", F.lit(generator).alias("generator"), F.lit(fault).alias("fault_type"), F.lit(kind).alias("kind"), root.alias("root"), start.cast("int").alias("start_hour"),
        F.least(confidence, F.lit(0.95)).alias("confidence"), F.array_sort(F.array_distinct(F.array_compact(affected))).alias("affected"), step.alias("step"),
        (F.lit(None) if amount is None else amount).cast("double").alias("amount"))


def leaks(rows: DataFrame, building: Building) -> DataFrame:
    """One for each deepest asset with extra flow that is no pump: 0.6, more if the flow shows further up and if a tap is below."""
    leaf = deepest(_groups(rows, "extra"), building).select(F.col("grp").alias("incident"), F.col("member").alias("asset_id"))
    leaf = rows.join(leaf, ["incident", "asset_id"], "left_semi").where("kind <> 'pump' AND residual > 0")
    by = list(building.by)
    up = building.closure.where("distance > 0").select(*by, F.col("descendant").alias("asset_id"), F.col("ancestor").alias("above"))
    above = rows.where("parameter = 'flowrate' AND kind <> 'pump'").select("incident", F.col("asset_id").alias("above"), F.col("residual").alias("more"))
    seen = leaf.join(up, [*by, "asset_id"]).join(above, ["incident", "above"]).where(F.col("more") >= CORROBORATE * F.col("residual"))
    seen = seen.groupBy("incident", "asset_id").agg(F.array_sort(F.collect_set("above")).alias("corroborating"))
    taps = building.feeds.join(building.assets.where("role = 'fixture'").select(*by, F.col("asset_id").alias("child")), [*by, "child"], "left_semi")
    taps = taps.groupBy(*by, F.col("parent").alias("asset_id")).agg(F.min("child").alias("tap"))
    df = leaf.join(seen, ["incident", "asset_id"], "left").join(taps, [*by, "asset_id"], "left")
    start = F.coalesce(F.nullif(F.col("first_up"), F.lit(0)), F.col("first_any"))  # hour 0 falls back to the first hour of any sign
    confidence = F.lit(0.6) + F.when(F.col("corroborating").isNotNull(), 0.25).otherwise(0.0) + F.when(F.col("tap").isNotNull(), 0.05).otherwise(0.0)
    affected = F.concat(F.array("tap", "asset_id"), F.coalesce("corroborating", F.array().cast("array<string>")))
    step = F.format_string("%s carries %.3f L/s more than expected, and nothing below it does", "asset_id", F.col("residual") * 1000)
    return _hypothesis(df, 0, "leak", "leak", F.coalesce("tap", "asset_id"), start, confidence, affected, step, F.col("residual") * 1000)


def pressure_blockages(rows: DataFrame, span: DataFrame, bounds: DataFrame, heads: DataFrame, building: Building) -> DataFrame:
    """The first link of the suspect span: 0.55, more with a healthy bound and with dry sensors; weak for a small loss, and for a tank that ran low."""
    by = list(building.by)
    links = span.join(building.assets.where(F.col("kind").isin(*LINKS)).select(*by, "asset_id"), [*by, "asset_id"], "left_semi")
    root = links.groupBy("incident").agg(F.min_by("asset_id", "position").alias("link"))
    loss = rows.where("major").groupBy("incident").agg(
        F.array_sort(F.collect_set("asset_id")).alias("lost"), F.max(F.abs("residual")).alias("worst"), F.min("first_down").alias("first"),
        F.max(F.coalesce(F.col("low.observed") <= DRY_M, F.lit(False))).alias("dry"))
    outlet = rows.where("role = 'tank_outlet'").groupBy("incident").agg(F.min_by("first_down", "asset_id").alias("outlet_down"))
    role = building.assets.select(*by, F.col("asset_id").alias("common"), F.col("role").alias("common_role"))
    df = loss.join(bounds, "incident").join(root, "incident", "left").join(outlet, "incident", "left").join(role, [*by, "common"], "left").join(heads.select("incident", "detected_at_s"), "incident")
    start = F.coalesce("first", F.floor(F.col("detected_at_s") / 3600).cast("int"))
    c = F.lit(0.55) + F.when(F.col("bound").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("dry"), 0.15).otherwise(0.0)
    c = F.when((F.col("worst") < MAJOR_LOSS_M) & ~F.col("dry"), 0.3).otherwise(c)
    drained = F.col("bound").isNull() & F.coalesce(F.col("common_role").isin("roof_manifold", "roof_tank", "pump_delivery"), F.lit(False))
    drained = drained & (F.col("outlet_down").isNull() | (F.col("outlet_down") > start))
    c = F.when(drained, F.least(c, F.lit(0.4))).otherwise(c)
    root_col = F.coalesce("link", "common")
    step = F.format_string("%d sensors below %s lost up to %.1f m", F.size("lost"), "common", "worst")
    return _hypothesis(df, 1, "blockage", "no_water", root_col, start, c, F.concat("lost", F.array(root_col)), step, F.col("worst"))


def flow_blockages(rows: DataFrame, heads: DataFrame, building: Building) -> DataFrame:
    """Room branches whose flow stopped: the link that they share, 0.6 for several and 0.5 for one."""
    low = F.col("low")
    stopped = rows.where("parameter = 'flowrate' AND role = 'room_branch'").where((low["expected"] > 0) & (low["observed"] <= STOPPED * low["expected"]))
    by = list(building.by)
    point = common_point(_groups(stopped, "true"), building).select(F.col("grp").alias("incident"), "common")
    kinds = building.assets.select(*by, F.col("asset_id").alias("common"), F.col("kind").isin(*LINKS).alias("_link"))
    point = point.join(kinds, [*by, "common"]).join(building.feeds.select(*by, F.col("child").alias("common"), "parent"), [*by, "common"], "left")
    root = F.when(F.col("_link"), F.col("common")).otherwise(F.coalesce("parent", "common"))
    all_of = stopped.groupBy("incident").agg(F.array_sort(F.collect_set("asset_id")).alias("all"), F.min("first_down").alias("first"))
    df = all_of.join(point.select("incident", root.alias("root")), "incident").join(heads.select("incident", "detected_at_s"), "incident")
    start = F.coalesce("first", F.floor(F.col("detected_at_s") / 3600).cast("int"))
    step = F.concat(F.lit("flow stopped in "), F.array_join("all", ", "))
    return _hypothesis(df, 2, "blockage", "no_flow", F.col("root"), start, F.when(F.size("all") > 1, 0.6).otherwise(0.5), F.concat("all", F.array("root")), step)


def pump_failures(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """A pump below its expected flow: 0.5, more with a low tank and a broad loss; 0.35 if the signs don't last."""
    about = rows.groupBy("incident").agg(
        F.collect_set(F.when(F.expr("tank AND residual < 0"), F.col("asset_id"))).alias("tanks"), F.max(F.when(F.expr("tank AND residual < 0"), F.col("hours_down"))).alias("tank_hours"),
        F.max("common").alias("shifted"), F.count_distinct(F.when(F.col("major"), F.coalesce("flat", F.lit("")))).alias("flats"))
    df = rows.where("kind = 'pump' AND low IS NOT NULL AND first_down IS NOT NULL").join(about, "incident").join(heads.select("incident", "detected_at_s", "last_seen_s"), "incident")
    broad = F.col("shifted") | (F.col("flats") >= 4)
    hours = F.floor(F.col("last_seen_s") / 3600) - F.floor(F.col("detected_at_s") / 3600) + 1
    lasts = (F.coalesce("tank_hours", F.lit(0)) >= 2) | (broad & (hours >= 2))
    c = F.lit(0.5) + F.when(F.size("tanks") > 0, 0.2).otherwise(0.0) + F.when(broad, 0.1).otherwise(0.0)
    step = F.format_string("%s delivered %.2f L/s less than expected", "asset_id", F.abs(F.col("low.deviation")) * 1000)
    return _hypothesis(df, 3, "pump_failure", "pump", F.col("asset_id"), F.col("first_down"), F.when(lasts, c).otherwise(0.35), F.concat(F.array("asset_id"), "tanks"), step)


def street_supplies(rows: DataFrame) -> DataFrame:
    """Sump and municipal inlet both low: 0.7, no fault of the building."""
    low = rows.where("residual < 0").groupBy("incident").agg(
        F.min(F.when(F.col("role") == "sump", F.col("asset_id"))).alias("sump"), F.min(F.when(F.col("role") == "municipal_inlet", F.col("asset_id"))).alias("inlet"),
        F.min(F.when(F.col("role").isin("sump", "municipal_inlet"), F.col("first_down"))).alias("first"))
    df = low.where("sump IS NOT NULL AND inlet IS NOT NULL")
    return _hypothesis(df, 4, "other", "street_supply", F.col("inlet"), F.col("first"), F.lit(0.7), F.array("inlet", "sump"), F.concat_ws(" and ", "inlet", "sump"))


#: What the rules read of a packet.
PACKET = (
    "incident struct<first_alarm:string,last_alarm:string>, observations array<struct<asset:string,parameter:string,status:string,score:double,peak_deviation:double,unit:string,first_seen:string,"
    "hourly:array<struct<at:string,deviation:double,observed:double,expected:double>>>>, assets array<struct<asset_id:string,kind:string,role:string,label:string,flat:string,room:string>>, "
    "relations array<array<string>>, topology_facts struct<tank_level_change:map<string,string>,extra_flow:struct<deepest_assets_with_extra_flow:array<string>>,pressure_loss:struct<"
    "assets_with_pressure_loss:array<string>,common_supply_point:string,suspect_span_upward:array<string>,nearest_upstream_point_still_feeding_a_healthy_sensor:string>>")


class PacketView:
    """What packets(incident, packet) say by themselves, as relations keyed by incident: assets, feeds and the closure of each incident's own network.

    A packet holds a part of a building, and the part may fall apart: ways up, sets below and common points end where the packet ends. Values are those of the
    packet: rounded, flows in L/s (here in m3/s again), alarms without a deviation are left out.
    """

    by = ("incident",)

    def __init__(self, packets: DataFrame):
        p = cut(packets.select("incident", F.from_json("packet", PACKET).alias("p")).select("incident", *(F.col(f"p.{c}").alias("head" if c == "incident" else c) for c in ("incident", "observations", "assets", "relations", "topology_facts"))))
        second = lambda c: F.split(c, ":")[0].cast("long") * 3600
        self.heads = p.select("incident", second(F.col("head.first_alarm")).alias("detected_at_s"), second(F.col("head.last_alarm")).alias("last_seen_s"))
        self.assets = p.select("incident", F.inline("assets"))
        arcs = p.select("incident", F.explode("relations").alias("r")).where(F.col("r")[1] == "FEEDS")
        self.feeds = arcs.select("incident", F.col("r")[2].alias("child"), F.col("r")[0].alias("parent"))
        facts = F.col("topology_facts")
        loss, none = facts["pressure_loss"], F.array().cast("array<string>")
        self.span = p.select("incident", F.posexplode(loss["suspect_span_upward"]).alias("position", "asset_id"))
        self.bounds = p.where(loss["common_supply_point"].isNotNull()).select("incident", loss["common_supply_point"].alias("common"), loss["nearest_upstream_point_still_feeding_a_healthy_sensor"].alias("bound"))
        alarm = F.filter("observations", lambda o: F.startswith(o["status"], F.lit("alarm")) & o["peak_deviation"].isNotNull())
        seen = p.select("incident", F.explode(alarm).alias("o"), *(F.coalesce(c, none).alias(n) for c, n in (
            (F.map_keys(facts["tank_level_change"]), "_tanks"), (facts["extra_flow"]["deepest_assets_with_extra_flow"], "_leaves"), (loss["assets_with_pressure_loss"], "_lost"))))
        asset, scale = F.col("o.asset"), F.when(F.col("o.unit") == "L/s", 1000.0).otherwise(1.0)
        rows = seen.select(
            "incident", asset.alias("asset_id"), F.col("o.parameter").alias("parameter"), F.col("o.score").alias("score"), (F.col("o.peak_deviation") / scale).alias("residual"), second(F.col("o.first_seen")).alias("first_seen_s"),
            (F.col("o.status") == "alarm (building-wide shift)").alias("common"), (F.col("o.status") == "alarm (before the incident)").alias("early"),
            F.array_contains("_tanks", asset).alias("tank"), F.array_contains("_leaves", asset).alias("extra"), F.array_contains("_lost", asset).alias("major"))
        self.rows = cut(rows.join(self.assets.select("incident", "asset_id", "kind", "role", "flat"), ["incident", "asset_id"], "left"))
        hours = seen.select("incident", asset.alias("asset_id"), scale.alias("scale"), F.inline("o.hourly"))
        self.series = hours.select("incident", "asset_id", second(F.col("at")).alias("timestamp_s"), *((F.col(c) / F.col("scale")).alias(c) for c in ("deviation", "observed", "expected")))

    @cached_property
    def closure(self) -> DataFrame:
        """(incident, ancestor, descendant, distance) inside each packet, each asset with itself at 0."""
        tops = self.assets.select("incident", "asset_id").join(self.feeds.select("incident", F.col("child").alias("asset_id")), ["incident", "asset_id"], "left_anti")
        return graph.supply_closure(self.feeds, by=self.by).union(tops.select("incident", "asset_id", "asset_id", F.lit(0)))


def from_packets(packets: DataFrame) -> DataFrame:
    """All hypotheses that packets(incident, packet) give by themselves."""
    view = PacketView(packets)
    return hypotheses(view.rows, view.series, view.span, view.bounds, view.heads, view)


def hypotheses(rows: DataFrame, series: DataFrame, span: DataFrame, bounds: DataFrame, heads: DataFrame, building: Building | PacketView) -> DataFrame:
    """All hypotheses of all incidents; rows are classified alarms."""
    marked = cut(signs(rows, series))
    parts = [leaks(marked, building), pressure_blockages(marked, span, bounds, heads, building), flow_blockages(marked, heads, building), pump_failures(marked, heads), street_supplies(marked)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out)


#: kind -> severity, title and action; %s is the root
MESSAGES = {
    "leak": ("warning", "Possible leak at %s", "Inspect the fixtures and joints at %s; close its inlet to confirm."),
    "no_water": ("critical", "Supply cut below %s", "Open or clear %s."),
    "no_flow": ("warning", "Flow stopped below %s", "Look for a closed valve or an obstruction at %s."),
    "pump": ("critical", "Transfer pump %s is not filling the tank", "Check power, starter and level switch of %s."),
    "street_supply": ("critical", "Street supply interrupted at %s", "Check the connection at %s and ask the utility."),
}

#: kind -> what a consequence of it looks like
EFFECTS = {"leak": "extra flow", "no_water": "pressure loss", "no_flow": "stopped flow", "pump": "run off its schedule", "street_supply": "changed street supply"}


def _summary() -> Column:
    """A sentence or two for people: what happens where, since when."""
    root, since = F.col("root_cause_asset"), clock(F.col("start_hour") * 3600)
    burst = F.when(F.col("amount") >= BURST_LPS, "A burst or an open fixture is likely.").otherwise("A running cistern, a dripping tap or a small leak is likely.")
    text = F.when(F.col("kind") == "leak", F.concat(F.format_string("Since %s about %.0f litres an hour more than expected flow at %s. ", since, F.col("amount") * 3600, root), burst))
    text = text.when(F.col("kind") == "no_water", F.format_string("Since %s up to %.1f m of pressure are lost below %s.", since, F.col("amount"), root))
    text = text.when(F.col("kind") == "no_flow", F.format_string("Since %s no water flows below %s.", since, root))
    text = text.when(F.col("kind") == "pump", F.format_string("At %s pump %s did not deliver as it normally does.", since, root))
    text = text.otherwise(F.format_string("Since %s less water comes in at %s and the sump falls.", since, root))
    return F.when(F.col("confidence") < CREDIBLE, F.concat(text, F.lit(" The signs are too brief or too weak to confirm this."))).otherwise(text)


def diagnose(found: DataFrame) -> DataFrame:
    """The most credible hypothesis of each incident: the earliest of those of at least 0.5 (else of all), the surest first, generators in order.

    A rival with another root in the same hour takes 0.1 of the confidence; the other hypotheses are listed, four at most.
    """
    credible = (F.col("confidence") >= CREDIBLE).cast("int")
    tie = [F.asc("start_hour"), F.desc("confidence"), F.asc("generator"), F.asc("root")]
    rows = found.withColumn("credible", credible).withColumn("_n", F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("credible"), *tie)))
    best = rows.where("_n = 1").select("incident", *(F.col(c).alias(f"b_{c}") for c in SHAPE[2:] + ["credible"]))
    others = rows.where("_n > 1").join(best, "incident")
    rival = (F.col("credible") == F.col("b_credible")) & (F.col("start_hour") == F.col("b_start_hour")) & (F.col("root") != F.col("b_root"))
    why = F.when(F.col("start_hour") > F.col("b_start_hour"), "starts later, as a consequence would").otherwise("weaker evidence")
    listed = F.array_sort(F.collect_list(F.struct("start_hour", (-F.col("confidence")).alias("_c"), "generator", F.col("root").alias("asset"), why.alias("why_less_likely"), "kind", (F.col("start_hour") >= F.col("b_start_hour")).alias("_later"))))
    listed = F.slice(listed, 1, 4)
    effects = F.create_map(*(F.lit(x) for pair in EFFECTS.items() for x in pair))
    after = F.transform(F.filter(listed, lambda x: x["_later"]), lambda x: F.concat(x["asset"], F.lit(": "), F.element_at(effects, x["kind"]), F.lit(" from "), clock(x["start_hour"] * 3600)))
    listed = F.transform(listed, lambda x: F.struct(x["asset"].alias("asset"), x["why_less_likely"].alias("why_less_likely")))
    rest = others.groupBy("incident").agg(F.max(rival).alias("rivalled"), listed.alias("alternatives"), after.alias("consequences"))
    confidence = F.when(F.coalesce("rivalled", F.lit(False)), F.greatest(F.col("b_confidence") - 0.1, F.lit(0.1))).otherwise(F.col("b_confidence"))
    out = best.join(rest, "incident", "left").select(
        "incident", F.col("b_root").alias("root_cause_asset"), F.col("b_fault_type").alias("fault_type"), F.col("b_kind").alias("kind"), F.col("b_start_hour").alias("start_hour"),
        F.bround(confidence, 2).alias("confidence"), F.col("b_affected").alias("affected_assets"), F.col("b_step").alias("reasoning"),
        F.coalesce("alternatives", F.array().cast("array<struct<asset:string,why_less_likely:string>>")).alias("alternatives"),
        F.coalesce("consequences", F.array().cast("array<string>")).alias("consequences"), F.col("b_amount").alias("amount"))
    level, title, action = (F.lit(None).cast("string") for _ in range(3))
    for kind, (a, b, c) in MESSAGES.items():
        here = F.col("kind") == kind
        level, title, action = F.when(here, a).otherwise(level), F.when(here, F.format_string(b, "root_cause_asset")).otherwise(title), F.when(here, F.format_string(c, "root_cause_asset")).otherwise(action)
    level = F.when((F.col("kind") == "leak") & (F.col("amount") >= BURST_LPS), "critical").otherwise(level)
    weak = F.col("confidence") < CREDIBLE
    return out.withColumns({"summary": _summary(), "severity": F.when(weak, "review").otherwise(level), "title": F.when(weak, F.concat(F.lit("Unconfirmed: "), title)).otherwise(title), "recommended_action": action})


def flats_text(diagnoses: DataFrame, building: Building) -> DataFrame:
    """(incident, flats): the flats of the affected assets in words, such as ``Flats 1A, 2B``; no row where none is in a flat."""
    rows = diagnoses.select("incident", F.explode("affected_assets").alias("asset_id")).join(building.assets.select("asset_id", "flat"), "asset_id")
    rows = rows.where("nullif(flat, '') IS NOT NULL").groupBy("incident").agg(F.array_sort(F.collect_set(F.regexp_replace("flat", "^F(?=.)", ""))).alias("f"))
    return rows.select("incident", F.concat(F.when(F.size("f") == 1, "Flat ").otherwise("Flats "), F.array_join("f", ", ")).alias("flats"))


def message_text(diagnoses: DataFrame) -> DataFrame:
    """(incident, message): a diagnosis as plain text for logs."""
    others = F.array_join(F.transform("alternatives", lambda a: F.concat_ws(": ", a["asset"], a["why_less_likely"])), "; ")
    text = F.concat_ws("\n", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title"), *(c for c in ("summary",) if c in diagnoses.columns), F.concat(F.lit("Why: "), "reasoning"),
                       F.when(F.size("alternatives") > 0, F.concat(F.lit("Less likely: "), others)), F.concat(F.lit("Action: "), "recommended_action"),
                       F.format_string("Confidence: %d%%", F.bround(F.col("confidence") * 100).cast("int")))
    return diagnoses.select("incident", text.alias("message"))


def grounding(diagnoses: DataFrame, allowed: DataFrame) -> DataFrame:
    """Diagnoses beside allowed(incident, allowed_ids) with what is wrong: ids not allowed, an unknown fault type, a confidence out of range."""
    cited = F.array_distinct(F.concat(F.array("root_cause_asset"), "affected_assets", F.col("alternatives.asset")))
    rows = diagnoses.join(allowed.select("incident", "allowed_ids"), "incident", "left").withColumn("_bad", F.array_except(cited, F.coalesce("allowed_ids", F.array().cast("array<string>"))))
    problems = F.array_compact(F.array(
        F.when(F.size("_bad") > 0, F.concat(F.lit("unknown ids: "), F.array_join("_bad", ", "))),
        F.when(~F.col("fault_type").isin(*FAULT_TYPES), F.concat(F.lit("unknown fault type: "), "fault_type")),
        F.when(~F.col("confidence").between(0, 1), F.lit("confidence out of range"))))
    return rows.withColumn("violations", problems).withColumn("grounded", F.size("violations") == 0).drop("_bad", "allowed_ids")


def scores(diagnoses: DataFrame, truth: DataFrame, building: Building) -> DataFrame:
    """Exact root, same room, one link away, and right type, against truth(incident, target_id, fault_type)."""
    place = building.assets.select("asset_id", "room")
    rows = diagnoses.select("incident", "root_cause_asset", "fault_type").join(truth.select("incident", "target_id", F.col("fault_type").alias("true_type")), "incident")
    rows = rows.join(place.select(F.col("asset_id").alias("root_cause_asset"), F.col("room").alias("_a")), "root_cause_asset", "left")
    rows = rows.join(place.select(F.col("asset_id").alias("target_id"), F.col("room").alias("_b")), "target_id", "left")
    arcs = building.feeds.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    near = graph.reach(arcs.union(arcs.select("dst", "src")), rows.select(F.col("target_id").alias("node")), 1)
    near = near.select(F.col("seed").alias("target_id"), F.col("node").alias("root_cause_asset"), F.lit(True).alias("_near"))
    rows = rows.join(near, ["target_id", "root_cause_asset"], "left")
    return rows.select("incident", (F.col("root_cause_asset") == F.col("target_id")).alias("exact"), F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("room"),
                       F.coalesce("_near", F.lit(False)).alias("near"), (F.col("fault_type") == F.col("true_type")).alias("type"))
