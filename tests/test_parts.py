import itertools
import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import optimize as o
from quillspark.functions import text_json

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_removable_part():
    for p in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(isinstance(x, str) for x in e.oracle_sql().values())


def test_json_is_strict(spark):
    cases = {"{}": "object", "{} x": None, "[1] [2]": None, "1, 2": None, "1": "long", '{"a": 1}': "object", '1} , {"b": 2': None, "": None, "null": "null", None: None}
    rows = spark.createDataFrame([(c,) for c in cases], "j string").select("j", text_json.kind(F.col("j")).alias("k")).collect()
    assert {r.j: r.k for r in rows} == cases


def test_simplex_against_corners():
    """Two variables: the optimum is at a crossing of two constraints."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        c, a, b = rng.integers(1, 9, 2), rng.integers(1, 9, (3, 2)), rng.integers(1, 20, 3)
        lines = [(a[i], b[i]) for i in range(3)] + [(np.array([1, 0]), 0), (np.array([0, 1]), 0)]
        for sense, relation, best in (("maximize", "<=", max), ("minimize", ">=", min)):
            lp = o.LinearProgram(2)
            getattr(lp, sense)(c)
            for x, y in zip(a, b, strict=True):
                lp.subject_to(x, relation, y)
            values = []
            for (p, u), (q, v) in itertools.combinations(lines, 2):
                m = np.array([p, q], float)
                if abs(np.linalg.det(m)) > 1e-9:
                    x = np.linalg.solve(m, [u, v])
                    side = a @ x - b
                    if (x >= -1e-9).all() and ((side <= 1e-9) if relation == "<=" else (side >= -1e-9)).all():
                        values.append(c @ x)
            r = o.simplex(lp)
            assert r.status == "OPTIMAL"
            assert abs(r.value - best(values)) < 1e-6
