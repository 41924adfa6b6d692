"""The main text of pages: menus and footers go, the run equals enumeration of all runs."""

import random

from pyspark.sql import functions as F

from turnscope.functions import maintext


def test_boilerplate_goes(spark):
    menu = "<nav><ul>" + "".join(f'<li><a href="/{i}">Section number {i} of this site, which is long</a></li>' for i in range(6)) + "</ul></nav>"
    body = "<article><h2>Heading</h2>" + "".join(f"<p>Paragraph {i} says <a href='x'>something</a> worth reading &amp; keeping, at some length.</p>" for i in range(3)) + "</article>"
    page = f"<html><head><title>Site</title><style>p {{}}</style></head><body>{menu}<script>var a = '<p>no</p>'</script>{body}<!-- <p>{'x' * 200}</p> --><footer>Legal &copy; 2024</footer></body></html>"
    rows = [(0, page), (1, None), (2, ""), (3, menu), (4, "no tags here, but one block of text that is long enough to count"), (5, "<p>short</p>" * 50), (6, "<p>" + "word " * 200_000 + "</p>")]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, html string").select("i", maintext.main_text(F.col("html")).alias("m")).collect()}
    assert got[0] == "\n".join(f"Paragraph {i} says something worth reading & keeping, at some length." for i in range(3))
    assert [got[i] for i in (1, 2, 3, 5)] == [""] * 4 and got[4] == rows[4][1] and len(got[6]) == 999_999


def test_run_equals_enumeration(spark, monkeypatch):
    monkeypatch.setattr(maintext, "COST", 5)
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        rows.append((i, "".join(f"<p>{'a' * rnd.randrange(12)}{'<a>bb</a>' * rnd.randrange(3)}</p>" for _ in range(rnd.randrange(9)))))
    d = spark.createDataFrame(rows, "i int, html string").select("i", maintext.blocks(F.col("html")).alias("b"), maintext.main_text(F.col("html")).alias("m"))
    some = 0
    for r in d.collect():
        runs = [(sum(x.score for x in r.b[s : e + 1]), -e, s) for e in range(len(r.b)) for s in range(e + 1)]
        total, e, s = max(runs, default=(0, 0, 0))
        assert r.m == ("\n".join(x.text for x in r.b[s : -e + 1]) if total > 0 else "")
        some += total > 0
    assert some > 50
