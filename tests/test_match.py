import pytest

from pkgscope.operators.match import call_verdict

ARGS = "array<struct<name:string,has_default:boolean,pos_only:boolean,kw_only:boolean,vararg:boolean,kwarg:boolean>>"


def a(name, default=False, po=False, ko=False, va=False, kw=False):
    return (name, default, po, ko, va, kw)


SIGS = {
    "f()": [],
    "f(**kwargs)": [a("kwargs", kw=True)],
    "f(a, b, c, d=3, e=4, f=6)": [a("a"), a("b"), a("c"), a("d", True), a("e", True), a("f", True)],
    "f(a, /, b=1, c=2, *d, e, f=k, **g)": [a("a", po=True), a("b", True), a("c", True), a("d", va=True),
                                           a("e", ko=True), a("f", True, ko=True), a("g", kw=True)],
}


def call(text):
    inner = text[text.index("(") + 1:-1]
    toks = [t for t in inner.split(",") if t]
    return (sum(1 for t in toks if t == "*"), sorted(t.split("=")[0] for t in toks if "=" in t), "^^^" in toks, "**" in toks)


CASES = [
    ("f()", ["f()", "f(**)", "f(^^^)"], ["f(*)", "f(a=*)"]),
    ("f(**kwargs)", ["f()", "f(a=*)", "f(**)", "f(^^^)"], ["f(*)"]),
    ("f(a, b, c, d=3, e=4, f=6)", ["f(*,*,*)", "f(*,*,*,*,*,*)", "f(*,^^^)", "f(**)", "f(a=*,b=*,c=*)"],
     ["f(*)", "f(*,*,*,*,*,*,*)", "f(*,*,a=*,**)", "f(k=*)"]),
    ("f(a, /, b=1, c=2, *d, e, f=k, **g)", ["f(*,*,*,e=*)", "f(*,*,*,*,e=*)", "f(*,*,^^^,e=*)"], ["f(*)"]),
]


@pytest.mark.parametrize("sig,good,bad", CASES)
def test_call_match_golden(spark, sig, good, bad):
    rows = [(c, SIGS[sig]) + call(c) for c in good + bad]
    df = spark.createDataFrame(rows, f"c string, args {ARGS}, n int, kwargs array<string>, star boolean, addl boolean")
    v = call_verdict("c", "args", "n", "kwargs", "star", "addl")
    got = {r.c: r.ok for r in df.select("c", v["ok"].alias("ok")).collect()}
    assert all(got[c] for c in good), got
    assert not any(got[c] for c in bad), got
