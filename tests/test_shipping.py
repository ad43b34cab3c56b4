import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from rillflow.session import local_session
from rillflow.operators import llm_diagnosis
spark = local_session(2, 2)
class Quiet:
    def chat(self, messages):
        return "none"
packets = spark.createDataFrame([("1", "{{}}", ["a"])], "incident string, packet string, allowed_ids array<string>")
print("GROUNDED", llm_diagnosis.diagnose(packets, Quiet).first().grounded)
"""


def test_workers_need_no_search_path(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "GROUNDED False" in run.stdout, run.stderr[-2000:]
