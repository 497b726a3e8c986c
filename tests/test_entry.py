"""The driver contract, with and without the training-data operators."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(map(callable, contract.queries().values()))


def test_entry(spark):
    assert contract.entry(spark).columns == ["query_id", "name_id", "sim"]


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in ("sieveline", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "sieveline" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'screen' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_outside_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "sieveline")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read(), re.MULTILINE), name
