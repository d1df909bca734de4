"""Every query with SQL against DuckDB at the smallest scale, and the others for rows."""

import decimal
import os
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import layout
from gaugeline.plans import drawings, files, registry
from gaugeline.sources.fixtures import view

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "null" if v != v else repr(round(float(v), 6) + 0.0)
    if isinstance(v, (bool, int)):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted([plain(v) for v in r] for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted([plain(r[i]) for i in order] for r in found.fetchall())


def test_readings_hold_every_callout(spark):
    every = drawings.chars(spark, FOLDER)
    assert every.where("id > 6").count() > 0
    first = drawings._readings(spark, FOLDER).where("run = 0")
    assert first.count() == every.count()
    places = registry.queries()["dedupe_readings"](spark, FOLDER).groupBy("drawing_id").agg(F.max("place").alias("m"))
    sizes = drawings._readings(spark, FOLDER).where("run < 2").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))
    assert places.join(sizes, "drawing_id").where("m >= n").count() == 0 and places.where("m >= 6").count() > 0


def test_votes_reach_every_callout(spark):
    """Callouts past the sixth can win a vote."""
    rows = drawings._readings(spark, FOLDER).collect()
    of = {}
    for r in sorted(rows, key=lambda r: (r.drawing_id, r.run, r.id)):
        of.setdefault(r.drawing_id, []).append(r)
    large = {d: v for d, v in of.items() if any(r.id > 6 for r in v)}
    voted = {(r.drawing_id, r.place) for r in registry.queries()["merge_by_vote"](spark, FOLDER).collect()}
    assert large and any(v[place].id > 6 for d, v in large.items() for place in range(len(v)) if (d, place) in voted)


def test_every_truth_has_its_image(spark):
    paths = [r.path for r in files.listing(spark, FOLDER).collect()]
    images = {}
    for p in sorted(paths, reverse=True):
        if p.endswith(".png") and not p.endswith("_overlay.png"):
            images[p.split("_")[0]] = p
    want = {p: images.get(p.removesuffix(".json")) for p in paths if p.endswith(".json")}
    got = {r.path: r.image for r in registry.queries()["image_for_truth"](spark, FOLDER).collect()}
    assert got == want and len({p.split("/")[2] for p in got}) == 10


def differs(a, b):
    return 0.0 if a == b else 1.0


def relative(a, b):
    if a is None or b is None:
        return differs(a, b)
    return min(1.0, abs(a - b) / max(abs(a), abs(b), 1e-6))


def cost(a, b):
    """Half of meaning, half of place, of two callouts of one sheet, spelled out."""
    if a.kind != b.kind:
        return 1.0
    wide = max(0.0, min(a.bbox.x1, b.bbox.x1) - max(a.bbox.x0, b.bbox.x0))
    high = max(0.0, min(a.bbox.y1, b.bbox.y1) - max(a.bbox.y0, b.bbox.y0))
    both = wide * high
    union = sum((r.bbox.x1 - r.bbox.x0) * (r.bbox.y1 - r.bbox.y0) for r in (a, b)) - both
    overlap = both / union if union > 0 else 0.0
    view = differs(a.view, b.view)
    if a.kind == "dimension":
        meaning = 0.6 * relative(a.nominal, b.nominal) + 0.25 * differs(a.dim_type, b.dim_type) + 0.15 * view
    elif a.kind == "geometric_tolerance":
        x, y = a.datum_refs, b.datum_refs
        span = max(len(x), len(y))
        off = sum(1.0 if k >= len(x) or k >= len(y) or x[k].label != y[k].label else 0.5 * differs(x[k].modifier, y[k].modifier) for k in range(span))
        meaning = 0.5 * differs(a.gtol_symbol, b.gtol_symbol) + 0.2 * relative(a.gtol_value, b.gtol_value) + 0.2 * (off / span if span else 0.0) + 0.1 * view
    else:
        s, t = a.raw_text or "", b.raw_text or ""
        text = 1.0 - SequenceMatcher(None, s, t).ratio() if s and t else differs(s, t)
        meaning = 0.85 * text + 0.15 * view
    return 0.5 * (1 - overlap) + 0.5 * meaning if overlap >= 0.05 else 1.0


def by_drawing(rows, order):
    out = {}
    for r in sorted(rows, key=lambda r: (r.drawing_id, *order(r))):
        out.setdefault(r.drawing_id, []).append(r)
    return out


def test_votes_equal_brute_force(spark):
    want = set()
    for d, rows in by_drawing(drawings._readings(spark, FOLDER).collect(), lambda r: (r.run, r.id)).items():
        pools = []
        for place, r in enumerate(rows):
            pool = next((p for p in pools if r.run not in p[1] and cost(rows[p[0]], r) <= 0.35), None)
            if pool:
                pool[1].add(r.run)
            else:
                pools.append((place, {r.run}))
        needed = max(1, -(-len({r.run for r in rows}) // 2))
        won = [(p, len(runs)) for p, runs in pools if len(runs) >= needed]
        want |= {(d, p, n, k) for k, (p, n) in enumerate(won, 1)}
    got = {(r.drawing_id, r.place, r.votes, r.id) for r in registry.queries()["merge_by_vote"](spark, FOLDER).collect()}
    assert got == want


def test_dedupe_equals_brute_force(spark):
    want = set()
    for d, rows in by_drawing(drawings._readings(spark, FOLDER).where("run < 2").collect(), lambda r: (r.run, r.id)).items():
        kept = []
        for place, r in enumerate(rows):
            if all(cost(rows[k], r) > 0.35 for k in kept):
                kept.append(place)
        want |= {(d, k) for k in kept}
    got = {(r.drawing_id, r.place) for r in registry.queries()["dedupe_readings"](spark, FOLDER).collect()}
    assert got == want


def stacked(lines):
    """Lines joined one by one, in order, to the first callout that they stand on: (text, x0, y0, x1, y1)."""
    made = []
    for n in sorted(lines, key=lambda r: r.run):
        b, h = n.box, n.height
        for m in made:
            shared = min(m[3], b.x1) - max(m[1], b.x0)
            widths = (m[3] - m[1], b.x1 - b.x0)
            level = abs((m[1] + m[3]) / 2 - (b.x0 + b.x1) / 2) <= 0.6 * max(widths)
            gap = b.y0 - m[4] if b.y0 >= m[4] else m[2] - b.y1
            if shared > 0 and shared >= 0.5 * min(widths) and level and -0.3 * max(m[5], h) <= gap <= 0.8 * max(m[5], h):
                m[:] = [f"{m[0]} {n.text}", min(m[1], b.x0), min(m[2], b.y0), max(m[3], b.x1), max(m[4], b.y1), max(m[5], h)]
                break
        else:
            made.append([n.text, b.x0, b.y0, b.x1, b.y1, h])
    return [m[:5] for m in made]


def test_stacks_equal_brute_force(spark):
    dice = random.Random(5)
    words = []
    for page in range(20):
        for k in range(60):
            x, y, wide = dice.randrange(0, 300) * 1.0, dice.randrange(0, 40) * 12.0, dice.randrange(20, 90) * 1.0
            words.append((page, k, f"w{k}", x, y, x + wide, y + 10.0, True))
    crowded = layout.cluster_lines(spark.createDataFrame(words, "page_id int, ord int, text string, x0 double, top double, x1 double, bottom double, upright boolean"))
    supplied = layout.cluster_lines(view(spark, FOLDER, "pdf_word"))
    for lines in (crowded, supplied):
        pages = by_page(lines.collect())
        want = {(page, pos, *m) for page, rows in pages.items() for pos, m in enumerate(stacked(rows))}
        got = {tuple(r) for r in layout.merge_stacks(lines).select("page_id", "pos", "text", "x0", "y0", "x1", "y1").collect()}
        assert got == want
        assert lines is supplied or len(want) < 0.8 * sum(map(len, pages.values()))


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r.page_id, []).append(r)
    return out
