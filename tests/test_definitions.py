"""No module defines a name twice: a second definition hides the first one silently."""

import ast
from collections import Counter
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent


def test_names_are_defined_once():
    twice = {}
    for file in [*TOP.glob("*.py"), *TOP.glob("claimsweep/**/*.py"), *TOP.glob("oracle/*.py"), *TOP.glob("tests/**/*.py")]:
        body = ast.parse(file.read_text(encoding="utf-8")).body
        counts = Counter(n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        if any(n > 1 for n in counts.values()):
            twice[str(file)] = [k for k, n in counts.items() if n > 1]
    assert not twice
