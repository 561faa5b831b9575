"""The parse stage walks statements only, and the status of versions reads parsed rows once without keeping them."""

import ast
import contextlib
import io

from pkgscope.operators import parse as P
from pkgscope.plans import q_tree as T
from tests.conftest import SF

ODD = """match x:
    case 1:
        import a
    case _:
        from . import b
try:
    import c
except* E:
    import d
else:
    import e
finally:
    import g
async def h():
    import i
    async with k:
        import l
    async for m in n:
        x = [lambda: y for y in z if (w := y)]
    else:
        import o
class S:
    import t
    def __init__(self):
        if 1:
            self.u = 1
        else:
            with v:
                self.w: int = 2
"""


def test_statements_are_those_of_the_whole_walk():
    tree = ast.parse(ODD)
    seen = list(P.statements(tree))
    assert [n for n in seen if isinstance(n, ast.stmt)] == [n for n in ast.walk(tree) if isinstance(n, ast.stmt)]
    assert not any(isinstance(n, ast.expr) for n in seen)


def test_status_neither_keeps_nor_doubles_rows(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        T.q_tree_status(spark, SF).explain()
    assert "InMemoryTableScan" not in out.getvalue() and "Expand" not in out.getvalue()
