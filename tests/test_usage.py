"""Usage operators on small match rows."""

import contextlib
import io
import re

from pkgscope.operators import usage as U


def test_lines_of_a_violation_are_merged_by_file(spark):
    rows = [("a", "p", "f.py", "p.x(1)", [9, 2], "MISMATCH", "m"), ("a", "p", "f.py", "p.x(2)", [2, 4], "MISMATCH", "m"),
            ("a", "p", "g.py", "p.x(1)", [10, 9], "MISMATCH", "m"), ("a", "p", "f.py", "p.y", [1], "MISSING", "n"),
            ("a", "p", "f.py", "p.z", [3], "MATCH", ""), ("b", "p", "f.py", "p.x(1)", [], "MISMATCH", "m")]
    df = spark.createDataFrame(rows, "c_pkg string, u_pkg string, src_file string, chain string, lines array<int>, status string, message string")
    got = {(r["c_pkg"], r["message"], r["src_file"]): r["lines"] for r in U.violation_lines(df, ["c_pkg", "u_pkg"]).collect()}
    assert got == {("a", "m", "f.py"): [2, 4, 9], ("a", "m", "g.py"): [9, 10], ("a", "n", "f.py"): [1]}


def test_results_meet_only_the_specifiers_of_their_client(spark):
    """Ninety-nine other clients ask for the same versions with specifiers of their own."""
    reqs = spark.createDataFrame([("a", "1", "dep", ">=1"), ("a", "1", "dep", "<2")] + [(f"o{i}", "1", "dep", f">=0.{i}") for i in range(99)], "c_pkg string, c_ver string, dep string, spec string")
    releases = spark.createDataFrame([("dep", v) for v in ("1.0", "2.0", "3.0")], "pkg string, ver string")
    results = spark.createDataFrame([("a", "1", "dep", v, "f.py", c, 1, "MATCH", "") for v in ("1.0.0", "2.0") for c in ("dep.f", "dep.g")],
                                    "c_pkg string, c_ver string, u_pkg string, u_ver string, src_file string, chain string, n_lines int, status string, message string")
    got = U.dependency_checks(reqs, releases, results)
    assert {(r.spec, r.dep_ver, r.chain, r.vers_with_apis) for r in got.collect()} == {
        (s, v, c, n) for c in ("dep.f", "dep.g") for s, v, n in ((">=1", "1.0", 3), (">=1", "2.0", 3), ("<2", "1.0", 1))}
    assert got.count() == 6
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain()
    assert not re.search(r"Join \[dep#\d+, u_ver#\d+\]", out.getvalue())  # that pairs a result with every client's specifiers
