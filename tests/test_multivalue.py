from hypothesis import given, settings
from hypothesis import strategies as st

from ruamesh.operators.multivalue import bare, lattice, scan, split_values


def values(spark, texts, field="maxspeed", multi_only=False, **how):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"row_id bigint, {field} string")
    out = {}
    for r in split_values(df, "row_id", [field], multi_only=multi_only, **how).collect():
        out.setdefault(r["row_id"], []).append((r["pos"], r["val"]))
    return {k: sorted(v) for k, v in out.items()}


def test_scan_keeps_quotes_and_remarks_whole():
    assert scan("['a, b', 'c']")[0] == ["'a, b'", " 'c'"]
    assert scan("{1 (ida, pico);2}")[0] == ["1 (ida, pico)", "2"]
    assert scan("50 @ (22:00-05:00);60")[0] == ["50 @ (22:00-05:00)", "60"]
    assert scan("43 @ (22:00-05:00) / 19")[0] == ["43 @ (22:00-05:00) ", " 19"]
    assert scan("50 @ 22:00-05:00, seg/ter; 60")[0] == ["50 @ 22:00-05:00, seg/ter", " 60"]
    assert scan("")[0] == [""]
    assert bare(" '60' ") == "60"


def test_quoted_pieces_are_arcs_of_their_own():
    assert [a[:2] for a in lattice(*scan("'a','b'"))] == [(0, 1), (1, 2)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="12;|,/ '\"[]{}()@x\t", max_size=30))
def test_scan_loses_no_piece(text):
    pieces, forms = scan(text)
    assert len(pieces) == len(forms) + 1
    assert all(j <= len(pieces) for _, j, _ in lattice(pieces, forms))


def test_frequent_values_decide(spark):
    common = ["30", "40", "50", "60"] * 30 + ["['11,1', '40']", '["11,1","13,9"]'] * 5
    got = values(spark, [*common, "11,1", "30,40", "30;;50", "40;60;", "20 km/h", "19;12", "s/ placa", "40|12|37"])
    n = len(common)
    assert got[n] == [(1, "11,1")]
    assert got[n + 1] == [(1, "30"), (2, "40")]
    assert got[n + 2] == [(1, "30"), (3, "50")]
    assert got[n + 3] == [(1, "40"), (2, "60")]
    assert got[n + 4] == [(1, "20 km/h")]
    assert got[n + 5] == [(1, "19"), (2, "12")]
    assert got[n + 6] == [(1, "s/ placa")]
    assert got[n + 7] == [(1, "40"), (2, "12"), (3, "37")]


def test_whole_numbers_have_no_decimals(spark):
    got = values(spark, ["1", "2", "5"] * 20 + ["1,5", "2, 5"], field="lanes")
    assert got[60] == [(1, "1"), (2, "5")]
    assert got[61] == [(1, "2"), (2, "5")]


def test_nulls_blanks_repeats_and_multi_only(spark):
    got = values(spark, [None, "", "  ", "40", "40;50", "40;50", "['60']", ";;"], multi_only=True)
    assert got == {4: [(1, "40"), (2, "50")], 5: [(1, "40"), (2, "50")]}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "row_id bigint, maxspeed string")
    assert split_values(empty, "row_id", ["maxspeed"]).count() == 0
    df = spark.createDataFrame([(1, "40;50", "x", "y", 3)], "row_id bigint, maxspeed string, field string, val string, pos int")
    assert {(r["pos"], r["val"]) for r in split_values(df, "row_id", ["maxspeed"]).collect()} == {(1, "40"), (2, "50")}


def test_very_long_text(spark):
    text = ";".join(["30", "40"] * 3000)
    got = values(spark, ["30", "40"] * 10 + [text])
    assert len(got[20]) == 6000 and got[20][-1] == (6000, "40")


def test_a_frequent_value_may_hold_many_delimiters(spark):
    many, more = "a/b/c/d/e/f/g", "/".join("pqrstuvwxyzabcdefghij")
    texts = ["a", "b"] + [f"'{many}'", f"'{more}'"] * 40 + [f"a;{many}", f"{more};b", "a/b"]
    got = values(spark, texts, field="kind")
    assert [v for _, v in got[len(texts) - 3]] == ["a", many] and [v for _, v in got[len(texts) - 2]] == [more, "b"]
    assert [v for _, v in got[len(texts) - 1]] == ["a", "b"]


def test_long_unseen_values_differ_by_length(spark):
    from ruamesh.operators.multivalue import _log_theta

    assert _log_theta("x" * 400, None, 10.0, False) < _log_theta("x" * 300, None, 10.0, False) < _log_theta("x" * 200, 0.0, 10.0, False)
