"""The record of a test run, for reports that say what was verified."""

from __future__ import annotations

import subprocess
import sys
import xml.etree.ElementTree as ET


def read_junit(text: str) -> dict[str, int]:
    """Counts of a JUnit file: total, passed, failed, skipped, and test files."""
    suites = [s for s in ET.fromstring(text).iter("testsuite")]
    cases = [c for s in suites for c in s.findall("testcase")]
    outcome = lambda c: next((k for k in ("failure", "error", "skipped") if c.find(k) is not None), "passed")
    got = [outcome(c) for c in cases]
    bad = sum(x in ("failure", "error") for x in got)
    return {"total": len(got), "passed": got.count("passed"), "failed": bad, "skipped": got.count("skipped"), "files": len({c.get("classname") for c in cases})}


def run_tests(folder: str, xml: str, *options: str, seconds: int = 3600) -> dict[str, int]:
    """Run pytest over a folder and read its record; its exit code is part of it."""
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", f"--junitxml={xml}", *options, folder], capture_output=True, timeout=seconds, check=False)
    with open(xml, encoding="utf-8") as f:
        return read_junit(f.read()) | {"exit_code": done.returncode}
