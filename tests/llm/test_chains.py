from ruamesh.llm import names as N


def test_chains_of_any_length_and_circles_end(spark):
    chain = [(f"s{k:02d}", f"s{k + 1:02d}") for k in range(20)]
    got = {r["sid"]: r["to"] for r in N._follow(spark.createDataFrame(chain, "sid string, to string")).collect()}
    assert got == {f"s{k:02d}": "s20" for k in range(20)}
    assert N._follow(spark.createDataFrame([("a", "b"), ("b", "a")], "sid string, to string")).count() == 2
    assert N._follow(spark.createDataFrame([], "sid string, to string")).count() == 0
