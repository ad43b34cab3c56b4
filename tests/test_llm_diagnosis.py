import json

import pytest
from pyspark.sql import functions as F

from rillflow.operators import faults, llm_diagnosis as m

GOOD = {"root_cause_asset": "VA", "fault_type": "blockage", "affected_assets": ["IA"], "reasoning": [{"step": "x", "evidence": ["IA"]}], "confidence": 0.8, "recommended_action": "open"}


class Fake:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def chat(self, messages):
        self.seen.append(messages)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_json_is_found():
    assert m.extract_json('so:\n```json\n{"a": {"b": 1}}\n```\nend') == {"a": {"b": 1}} == m.extract_json('x {"a": {"b": 1}} y')
    with pytest.raises(ValueError):
        m.extract_json("none")


def test_repair_turn_lists_the_problems():
    bad = json.dumps(GOOD | {"affected_assets": ["ZZ"], "fault_type": "fire", "confidence": 2})
    c = Fake(bad, json.dumps(GOOD))
    answer, grounded, attempts, wrong, error = m.diagnose_one(c, "{}", {"VA", "IA"})
    assert grounded and attempts == 2 and not wrong and error is None and json.loads(answer) == GOOD
    assert all(x in c.seen[1][-1]["content"] for x in ("ZZ", "fire", "confidence"))
    assert m.diagnose_one(Fake(bad, bad), "{}", {"VA", "IA"})[1:3] == (False, 2)
    assert m.diagnose_one(Fake("no", "still no"), "{}", set())[4]
    assert m.diagnose_one(Fake(m.ChatError("HTTP 400")), "{}", set())[4] == "ChatError: HTTP 400"


def test_in_tasks(spark):
    packets = spark.createDataFrame([("1", "{}", ["VA", "IA"]), ("2", "{}", ["IA"])], "incident string, packet string, allowed_ids array<string>")
    text = json.dumps(GOOD)

    class Same:
        def chat(self, messages):
            return text

    got = {r.incident: (r.grounded, r.attempts) for r in m.diagnose(packets, Same).collect()}
    assert got == {"1": (True, 1), "2": (False, 2)}


def test_prompt_and_ablation(spark):
    p = {"incident": {"id": "I", "first_alarm": "06:00", "last_alarm": "07:00", "sequence": ["06:00: IA down"]},
         "observations": [{"asset": "IA", "parameter": "pressure", "status": "alarm", "peak_deviation": -3.0, "unit": "m"}, {"asset": "IB", "parameter": "pressure", "status": "normal"}],
         "relations": [["VA", "FEEDS", "IA"]], "allowed_ids": ["IA", "VA"]}
    text, bare = spark.createDataFrame([(json.dumps(p),)], "p string").select(m.render(F.col("p")), m.without_graph(F.col("p"))).first()
    assert text == "Incident I 06:00 07:00\n06:00: IA down\nIA pressure alarm -3.0 m\nIB pressure normal\nVA FEEDS IA\nIds: IA, VA"
    assert [o["asset"] for o in json.loads(bare)["observations"]] == ["IA"] and "relations" not in bare


def test_faults(spark):
    key = faults.answer_key(spark, [faults.create_fault("leak", 101, 0.125, 8, 14, max_leak_demand=0.02), faults.create_fault("pump_failure", "10", 1.0, 2), faults.create_fault("blockage", "F_A", 0.5, 1, 3)])
    rows = {r.scenario: r for r in faults.parse_name(key.select("scenario")).collect()}
    assert set(rows) == {"leak_101_sev12_t08_14", "pump_failure_10_sev100_t02_end", "blockage_F_A_sev50_t01_03"}
    r = rows["blockage_F_A_sev50_t01_03"]
    assert (r.fault_type, r.target_id, r.severity, r.start_hour, r.end_hour) == ("blockage", "F_A", 0.5, 1.0, 3.0) and rows["pump_failure_10_sev100_t02_end"].end_hour is None
    assert key.where("fault_type = 'leak'").first().extra_demand == pytest.approx(0.0025)
    for bad in (("fire", "1", 0.5, 1, 2), ("leak", "1", 0, 1, 2), ("leak", "1", 0.5, 3, 2), ("blockage", "1", 0.5, 1)):
        with pytest.raises(ValueError):
            faults.create_fault(*bad)
    with pytest.raises(ValueError):
        faults.create_fault("leak", "1", 0.5, 1, 2, speed=3)
