"""The documented command collects every test file, whatever other test folders there are."""

import subprocess
import sys
from pathlib import Path

TESTS = Path(__file__).resolve().parent


def test_every_file_is_collected():
    command = [sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"]
    run = subprocess.run(command, cwd=TESTS.parent, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout[-3000:]
    missing = [f.name for f in TESTS.rglob("test_*.py") if f"{f.relative_to(TESTS.parent)}::" not in run.stdout]
    assert not missing
