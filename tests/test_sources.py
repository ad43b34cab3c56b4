import pytest

from rillflow.operators import graph
from rillflow.operators.contracts import ContractError
from rillflow.sources import config, network, tables

HEAD = "timestamp_s,asset_id,asset_type,parameter,value,scenario,state\n"
INP = """[JUNCTIONS]
; id elevation demand
101 10 5 P1
102 20
[RESERVOIRS]
R 100
[TANKS]
T 50 5 1 9 40
[PIPES]
101 R 101 1000 12 100 0 Open
p2 101 102 500 8 100 ; comment
[PUMPS]
PU 102 T HEAD C1
[STATUS]
p2 Closed
[OPTIONS]
UNITS GPM
[COORDINATES]
101 3 4
"""


def test_csv_readings(spark, tmp_path):
    f = tmp_path / "base.csv"
    f.write_text(HEAD + "0,101,node,pressure,50.0,normal,normal\n0,101,link,flowrate,0.5,normal,normal\n")
    rows = tables.read_baseline(spark, str(f)).collect()
    assert {r.asset_id for r in rows} == {"101"} and len(rows) == 2
    for bad, rule in [
        (HEAD, "empty"), ("a,b\n1,2\n", "columns"), (HEAD + "0,101,node,pressure,,normal,normal\n", "nulls"), (HEAD + "0,101,node,pressure,nan,normal,normal\n", "nulls"),
        (HEAD + 2 * "0,101,node,pressure,1,normal,normal\n", "duplicates"), (HEAD + "0,101,node,colour,1,normal,normal\n", "parameters"),
        (HEAD + "0,101,node,pressure,1,leak,fault_active\n", "baseline"),
    ]:
        f.write_text(bad)
        with pytest.raises(ContractError) as e:
            tables.read_baseline(spark, str(f))
        assert e.value.rule == rule
    with pytest.raises(ContractError):
        tables.read_baseline(spark, str(tmp_path / "x.txt"))


def test_manifest_and_datasets(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/s1.csv").write_text(HEAD + "0,1,node,pressure,1,s1,normal\n")
    m = tmp_path / "manifest.csv"
    head = "scenario,fault_type,target_id,severity,start_hour,end_hour,dataset_file\n"
    m.write_text(head + "s1,leak,101,0.5,8,14,old\\d\\s1.csv\n")
    manifest = tables.read_manifest(spark, str(m))
    assert manifest.first().target_id == "101" and manifest.first().dataset_file == "old/d/s1.csv"
    paths = tables.resolve(spark, manifest, str(tmp_path / "d"))
    assert tables.read_scenarios(spark, paths).first().scenario == "s1"
    m.write_text(head + 2 * "s1,leak,101,0.5,8,14,a.csv\n")
    with pytest.raises(ContractError, match="unique"):
        tables.read_manifest(spark, str(m))


def test_network_in_si_units(spark, tmp_path):
    (tmp_path / "n.inp").write_text(INP)
    v, e = network.read_network(spark, str(tmp_path / "n.inp"))
    r = {x.asset_id: x for x in v.collect()}
    assert r["101"].elevation == pytest.approx(3.048) and r["101"].base_demand == pytest.approx(5 * 6.30901964e-05) and (r["101"].x, r["101"].y) == (3, 4)
    assert r["R"].base_head == pytest.approx(30.48) and r["T"].max_level == pytest.approx(9 * 0.3048)
    links = {x.asset_id: x for x in e.collect()}
    assert links["101"].diameter == pytest.approx(0.3048) and links["p2"].status == "CLOSED" and links["PU"].kind == "pump"
    assert network.network_summary(v, e).first().asDict() == dict(junctions=2, tanks=1, reservoirs=1, pipes=2, pumps=1, valves=0)
    graph.check_topology(v, e)
    assert graph.topology_summary(v, e).first().asDict() == dict(nodes=4, components=1, links=3, connected=True)


def test_experiment(spark):
    raw = {"network_file": "a\\b.inp", "faults": [{"type": "leak", "target_id": 101, "severity": 0.5, "start_hour": 8, "end_hour": 14}],
           "scenario_generation": {"enabled": True, "blockage": {"target_ids": [107], "severities": [1.0], "start_hours": [6], "duration_hours": 6},
                                   "leak": {"target_ids": [101, 103], "severities": [0.25, 0.125], "start_hours": [2, 8], "duration_hours": 6}}}
    e = config.experiment(raw)
    assert e.network_file == "a/b.inp" and e.faults[0].target_id == "101"
    names = [r.scenario for r in e.scenario_matrix(spark).orderBy("scenario_id").collect()]
    assert len(names) == 9 and names[0] == "leak_101_sev25_t02_08" and names[2] == "leak_101_sev12_t02_08" and names[-1] == "blockage_107_sev100_t06_12"
    for bad in ({"severity": 0}, {"severity": 1.5}, {"start_hour": -1}, {"end_hour": 8}):
        with pytest.raises(ValueError):
            config.experiment({"network_file": "x", "faults": [{"type": "leak", "target_id": "1", "severity": 0.5, "start_hour": 8, "end_hour": 9} | bad]})
    assert config.load_env("A=1\n# c\nB='x y'\n", {"A": "0"}) == {"A": "0", "B": "x y"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(3600, "1", "node", "pressure", 2.0, "s", "normal"), (0, "1", "node", "pressure", 1.0, "s", "normal")], "timestamp_s long, asset_id string, asset_type string, parameter string, value double, scenario string, state string")
    tables.write_scenarios(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("scenario = 's'").count() == 2
    assert tables.series_payload(rows).first().payload == '{"pressure":"{\\"1\\":[1.0,2.0]}"}'
    tables.write_json(rows, str(tmp_path / "j"), "scenario")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    tables.write_report(rows, str(tmp_path / "r"), "timestamp_s")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().timestamp_s == "0"
