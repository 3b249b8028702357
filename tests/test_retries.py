import os
import subprocess
import sys


def test_results_survive_task_retries():
    script = os.path.join(os.path.dirname(__file__), "scripts", "retry_check.py")
    r = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=600)
    assert "IDENTICAL" in r.stdout, r.stdout[-2000:] + r.stderr[-2000:]
