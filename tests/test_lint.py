"""Determinism and structure: banned calls, and a core that stands without the llm subpackage."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
FILES = sorted((ROOT / "palabre").rglob("*.py")) + [ROOT / "__spark_entry__.py"]
BANNED = {"rand", "randn", "monotonically_increasing_id", "toPandas", "localCheckpoint", "collect_list_unordered"}


def test_no_banned_calls():
    bad = []
    for f in FILES:
        for node in ast.walk(ast.parse(f.read_text())):
            if isinstance(node, ast.Call):
                name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
                if name in BANNED:
                    bad.append(f"{f.name}:{node.lineno} {name}")
    assert not bad


def test_core_does_not_import_llm():
    for f in FILES:
        if "llm" not in f.parts and f.name != "__spark_entry__.py":
            assert ".llm" not in f.read_text(), f


def test_entry_without_llm():
    code = "import sys; sys.modules['palabre.llm'] = None; import __spark_entry__ as e; assert 'p6_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
