import pytest

from gaugeline.functions import grammar


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("⌀44 H7", {"dim_type": "diameter", "nominal": 44.0, "fit_class": "H7", "tol_style": "fit"}),
        ("12,5 ±0.1", {"nominal": 12.5, "upper_tol": 0.1, "lower_tol": -0.1, "tol_style": "bilateral"}),
        ("44.05/43.95", {"nominal": 44.0, "upper_tol": 0.05, "lower_tol": -0.05, "tol_style": "limit"}),
        ("10 -0.1/+0.3", {"upper_tol": 0.3, "lower_tol": -0.1, "tol_style": "unilateral"}),
        ("4X %%c6 THRU", {"count": 4, "dim_type": "diameter", "notes": "through"}),
        ("(44)", {"is_reference": True, "nominal": 44.0}),
        ("1-1/2", {"nominal": 1.5}),
        ("30 ±0.5°", {"dim_type": "angular"}),
        ("R5 TYP", {"dim_type": "radius", "notes": "typical"}),
        ("⌀6 ↧12 ⌴ ⌀11", {"notes": "depth 12, counterbore, ⌀11"}),
        ("M12x1.75-6H", {"kind": "thread", "nominal": 12.0, "notes": "pitch 1.75, class 6H"}),
        ("1/4-20 UNC-2B", {"kind": "thread", "nominal": 0.25, "notes": "20 tpi, UNC, class 2B"}),
        ("Ra 1,6", {"kind": "surface_finish", "notes": "Ra 1.6"}),
        ("| ⌖ | ⌀0.05 (M) | A | B(M) |", {"gtol_symbol": "position", "gtol_value": 0.05, "gtol_zone": "diametral", "material_modifier": "MMC", "datum_refs": [{"label": "A", "modifier": None}, {"label": "B", "modifier": "MMC"}]}),
        ("TOTAL RUNOUT 0.02 A", {"gtol_symbol": "total_runout"}),
    ],
)
def test_reads(text, want):
    got = grammar.parse(text)
    assert {k: got.get(k) for k in want} == want


@pytest.mark.parametrize("text", ["", "  ", None, "NOTE", "⌀44 ⌀44", "44 ±", "⌖ 0 A", "⌖ 0.1 A B C D", "POSITIONAL", "44 ?", "10 +0.1"])
def test_refuses(text):
    with pytest.raises(grammar.Refused):
        grammar.parse(text)


def test_a_hint_narrows(spark):
    assert grammar.parse("12", hint="dimension")["nominal"] == 12
    with pytest.raises(grammar.Refused):
        grammar.parse("12", hint="thread")
    df = spark.createDataFrame([("⌀5",), ("?",), (None,)], "t string").select(grammar.parse_callout("t").alias("c"))
    assert [(r.c.nominal, r.c.error is None) for r in df.collect()] == [(5.0, True), (None, False), (None, False)]
