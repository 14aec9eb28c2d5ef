import math
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.functions import links
from tidemark.operators import fuzzy

BASES = ["http://a/b/c/d;p?q", "https://x.org", "https://x.org/f.html?k=1#top", "https://x.org/a/b/"]
#: The examples of RFC 3986, 5.4.
REFERENCES = "g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g#s/../x mailto:a@b http://z/../q".split()


def test_resolve(spark):
    d = spark.createDataFrame([(b, r) for b in BASES for r in [*REFERENCES, "", None]] + [(None, "g")], "b string, r string")
    for x in d.select("b", "r", links.resolve(F.col("b"), F.col("r")).alias("u")).collect():
        if x.r is None or x.b is None:
            assert x.u is None
        elif x.r == "":
            assert x.u == x.b.partition("#")[0]
        elif x.r == "http://z/../q":
            assert x.u == "http://z/q"
        else:
            assert x.u == urljoin(x.b, x.r), (x.b, x.r)


def test_xml_documents(spark):
    url = "https://www.sec.gov/Archives/edgar/data/320193/0000320193-24-000001.txt"
    folder = url[:-4] + "/"
    rows = [
        ("<a href='f.XML'><a href=\"/r/g.xml\"><a HREF=\"http://q/h.xml\"><a href='f.XML'><a href='x.html'>", url, [folder + "f.XML", "https://www.sec.gov/r/g.xml", "http://q/h.xml"]),
        ("none", url, [folder + n for n in ("0000320193-24-000001.xml", "000032019324000001.xml", "primary_doc.xml", "form4.xml")]),
        (None, "https://x/y.txt", []),
        ("", None, []),
    ]
    d = spark.createDataFrame([r[:2] for r in rows], "html string, url string")
    assert [r.x for r in d.select(links.xml_documents(F.col("html"), F.col("url")).alias("x")).collect()] == [r[2] for r in rows]


TERMS = {"low": ("triangle", 0, 0, 50), "high": ("triangle", 50, 100, 100), "mid": ("trapezoid", 10, 40, 60, 90)}
OUT = {"sell": ("z", 0.1, 0.5), "hold": ("bell", 0.5, 2, 0.2), "buy": ("s", 0.5, 0.9)}


def test_shapes(spark):
    want = {
        ("triangle", 0, 10, 20): {0: 0, 5: 0.5, 10: 1, 15: 0.5, 20: 0, 30: 0}, ("triangle", 0, 0, 50): {0: 1, 25: 0.5, 50: 0}, ("trapezoid", 0, 10, 20, 40): {5: 0.5, 15: 1, 30: 0.5, 41: 0},
        ("normal", 3, 2): {3: 1, 5: math.exp(-0.5)}, ("bell", 5, 2, 3): {5: 1, 8: 0.5}, ("s", 0, 10): {-1: 0, 5: 0.5, 10: 1, 2: 0.08}, ("z", 0, 10): {-1: 1, 5: 0.5, 2: 0.92},
        ("p", 0, 4, 6, 10): {2: 0.5, 5: 1, 8: 0.5, 12: 0}, ("sigmoid", 1, 2): {2: 0.5}, ("two_sigmoids", 1, 2, 1, 2): {2: 0.25}, ("sigmoid_difference", 1, 2, 1, 2): {7: 0}, ("constant", 0.3): {9: 0.3},
        ("two_normals", 2, 1, 4, 2): {3: 1, 1: math.exp(-0.5), 6: math.exp(-0.5)},
    }
    one = spark.range(1)
    for (shape, *p), points in want.items():
        for x, y in points.items():
            assert one.select(fuzzy.SHAPES[shape](F.lit(float(x)), *map(float, p))).first()[0] == pytest.approx(y), (shape, x)
    assert set(fuzzy.SHAPES) == {k[0] for k in want}


def plain(x, shape, *p):
    tri = lambda a, b, c: (x - a) / (b - a) if a < x < b else (c - x) / (c - b) if b < x < c else float(x == b)
    s = lambda a, b: 0 if x <= a else 2 * ((x - a) / (b - a)) ** 2 if x <= (a + b) / 2 else 1 - 2 * ((b - x) / (b - a)) ** 2 if x < b else 1
    return {"triangle": lambda: tri(*p), "trapezoid": lambda: min(1, max(0, min((x - p[0]) / (p[1] - p[0]), (p[3] - x) / (p[3] - p[2])))), "s": lambda: s(*p), "z": lambda: 1 - s(*p), "bell": lambda: 1 / (1 + abs((x - p[0]) / p[2]) ** (2 * p[1]))}[shape]()


def test_mamdani_and_sugeno(spark):
    t = spark.createDataFrame([(1, "u", "low", False, "buy", 1.0), (2, "u", "high", True, "sell", 1.0), (2, "v", "high", True, "sell", 1.0), (3, "u", "mid", False, "hold", 0.5), (3, "v", "mid", False, "hold", 0.5)], "rule int, variable string, term string, any_of boolean, conclusion string, weight double")
    rules = fuzzy.rules_of(t)
    inputs = {"u": TERMS, "v": TERMS}
    rows = [(float(u), float(v)) for u in (0, 5, 20, 50, 77, 100) for v in (0, 30, 50, 95)]
    d = spark.createDataFrame(rows + [(None, 3.0)], "u double, v double")
    made = fuzzy.mamdani(d, inputs, OUT, 0.0, 1.0, rules, "y")
    lin = [fuzzy.Rule(r.when, (float(k), {"u": 0.5, "v": -0.25}), r.any, r.weight) for k, r in enumerate(rules)]
    got = fuzzy.sugeno(made, inputs, lin, "z").collect()
    m = lambda x, name: plain(x, *TERMS[name])
    for r in got[:-1]:
        w = [m(r.u, "low"), max(m(r.u, "high"), m(r.v, "high")), 0.5 * min(m(r.u, "mid"), m(r.v, "mid"))]
        num = den = 0.0
        for k in range(101):
            x = k / 100
            mu = max(min(a, plain(x, *OUT[o])) for a, o in zip(w, ("buy", "sell", "hold")))
            f = 1 if k in (0, 100) else 4 if k % 2 else 2
            num, den = num + f * mu * x, den + f * mu
        assert r.y == (pytest.approx(num / den) if den > 0 else None)
        z = [k + 0.5 * r.u - 0.25 * r.v for k in range(3)]
        assert r.z == (pytest.approx(sum(a * b for a, b in zip(w, z)) / sum(w)) if sum(w) else None)
    assert got[-1].y is None and got[-1].z is None
