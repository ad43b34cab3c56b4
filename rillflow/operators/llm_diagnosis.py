"""Optional diagnosis by a language model behind a ``chat`` client: prompt, parsing, grounding check, one repair turn.

Off by default: the rules in ``diagnosis`` are the primary way. A client is any object with ``chat(messages) -> str``; it runs in the tasks.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.shipping import ship
from rillflow.operators.diagnosis import FAULT_TYPES

REQUIRED = ("root_cause_asset", "fault_type", "affected_assets", "reasoning", "confidence", "recommended_action")
SYSTEM = (
    "You find the cause of an incident in a building's water supply. Use only ids that the evidence lists. Answer with one JSON object with the fields "
    + ", ".join(REQUIRED) + f"; fault_type is one of {', '.join(FAULT_TYPES)}; confidence is from 0 to 1; reasoning is a list of steps, each with its evidence ids."
)


class Client(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class ChatError(RuntimeError):
    pass


class HttpClient:
    """A chat-completions endpoint. 429 waits on a budget of its own, 5xx is tried again, other 4xx are errors."""

    def __init__(self, url: str, model: str, key: str = "", retries: int = 3, waits: int = 8, pause: float = 2.0):
        self.url, self.model, self.key, self.retries, self.waits, self.pause = url, model, key, retries, waits, pause

    def chat(self, messages: list[dict[str, str]]) -> str:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": 0}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        failed = waited = 0
        while True:
            try:
                with urllib.request.urlopen(request, timeout=120) as r:
                    return json.load(r)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if e.code == 429 and waited < self.waits:
                    waited += 1
                elif e.code >= 500 and failed < self.retries:
                    failed += 1
                else:
                    raise ChatError(f"HTTP {e.code}") from e
            time.sleep(self.pause * (1 + failed + waited))


def extract_json(text: str) -> dict:
    """The object in a fenced block, or between the outermost braces."""
    fenced = re.search(r"```(?:json)?\s*(\{.*\})\s*```", text, re.S)
    bare = re.search(r"\{.*\}", text, re.S)
    if not (found := fenced or bare):
        raise ValueError("no JSON object in the answer")
    out = json.loads(found[1] if fenced else found[0])
    if not isinstance(out, dict):
        raise ValueError("the answer is no JSON object")
    return out


def cited_ids(answer: dict) -> set[str]:
    ids = {answer.get("root_cause_asset"), *answer.get("affected_assets", [])}
    ids |= {x for s in answer.get("reasoning", []) if isinstance(s, dict) for x in s.get("evidence", [])}
    ids |= {a.get("asset") for a in answer.get("alternatives", []) if isinstance(a, dict)}
    return {str(x) for x in ids if x}


def problems(answer: dict, allowed: set[str]) -> list[str]:
    out = [f"missing field: {k}" for k in REQUIRED if k not in answer]
    out += [f"unknown id: {x}" for x in sorted(cited_ids(answer) - allowed)]
    if "fault_type" in answer and answer["fault_type"] not in FAULT_TYPES:
        out.append(f"unknown fault type: {answer['fault_type']}")
    if not isinstance(c := answer.get("confidence", 0), int | float) or not 0 <= c <= 1:
        out.append("confidence is not from 0 to 1")
    return out


def diagnose_one(client: Client, packet: str, allowed: set[str]) -> tuple[str | None, bool, int, list[str], str | None]:
    """(answer, grounded, attempts, problems, error) after one answer and, if it has problems, one repair turn that lists them."""
    messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": packet}]
    answer, wrong, error = None, [], None
    for attempt in (1, 2):
        try:
            text = client.chat(messages)
        except Exception as e:  # noqa: BLE001  (a client's failure is a result of this incident, not of the job)
            return None, False, attempt, [], f"{type(e).__name__}: {e}"
        try:
            answer, error = extract_json(text), None
            wrong = problems(answer, allowed)
        except ValueError as e:
            answer, wrong, error = None, [str(e)], str(e)
        if not wrong:
            break
        messages += [{"role": "assistant", "content": text}, {"role": "user", "content": "Correct these problems and answer again: " + "; ".join(wrong)}]
    return json.dumps(answer) if answer is not None else None, not wrong, attempt, wrong, error


RESULT = "incident string, diagnosis string, grounded boolean, attempts int, violations array<string>, error string"


def diagnose(packets: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """One result for each of packets(incident, packet, allowed_ids); ``client`` makes a client in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = client()
        for b in batches:
            rows = [(i, *diagnose_one(c, p, set(a))) for i, p, a in zip(b["incident"], b["packet"], b["allowed_ids"])]
            yield pd.DataFrame(rows, columns=["incident", "diagnosis", "grounded", "attempts", "violations", "error"])

    ship(packets.sparkSession)
    return packets.select("incident", "packet", "allowed_ids").mapInPandas(run, RESULT)


def render(packet: Column) -> Column:
    """A packet as compact text for a prompt: first alarms, observations, relations, ids."""
    t = "struct<incident:struct<id:string,first_alarm:string,last_alarm:string,sequence:array<string>>,observations:array<struct<asset:string,parameter:string,status:string,peak_deviation:double,unit:string>>,relations:array<array<string>>,allowed_ids:array<string>>"
    p = F.from_json(packet, t)
    line = lambda o: F.concat_ws(" ", o["asset"], o["parameter"], o["status"], o["peak_deviation"].cast("string"), o["unit"])
    return F.concat_ws("\n", F.concat_ws(" ", F.lit("Incident"), p["incident"]["id"], p["incident"]["first_alarm"], p["incident"]["last_alarm"]), F.array_join(p["incident"]["sequence"], "\n"),
                       F.array_join(F.transform(p["observations"], line), "\n"), F.array_join(F.transform(p["relations"], lambda r: F.array_join(r, " ")), "\n"),
                       F.concat(F.lit("Ids: "), F.array_join(p["allowed_ids"], ", ")))


def without_graph(packet: Column) -> Column:
    """The packet with alarms only, for comparison: no relations, assets or quiet sensors."""
    t = "struct<incident:struct<id:string,first_alarm:string,last_alarm:string>,observations:array<struct<asset:string,parameter:string,status:string,peak_deviation:double,unit:string>>>"
    p = F.from_json(packet, t)
    return F.to_json(F.struct(p["incident"].alias("incident"), F.filter(p["observations"], lambda o: F.startswith(o["status"], F.lit("alarm"))).alias("observations")))
