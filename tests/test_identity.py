from lacewing.operators import identity


def test_equal_sets_with_nulls(spark):
    """Rows with a null in a key joined with nothing, so each side was said to lack them."""
    left = spark.createDataFrame([(1, None), (1, None), (2, 5), (3, 6)], "cid long, rid long")
    right = spark.createDataFrame([(1, None), (3, 6), (3, 6), (None, None)], "cid long, rid long")
    got = identity.set_difference(left, right, ("l", "r"))
    assert got.columns == ["cid", "rid", "only_in"] and sorted(map(tuple, got.collect()), key=repr) == [(2, 5, "l"), (None, None, "r")]
    assert not got.join(left, ["cid"], "left_semi").where("only_in = 'r'").count()
