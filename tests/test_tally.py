"""Tallies of items of several words."""

from cairn.operators import claims


def test_item_tally_of_several_words(spark):
    items = [(1, "blue kettle"), (1, "kettles blue"), (1, "lamp"), (1, "red kettle"), (2, "lamp"), (2, "rope"), (3, "measured measures"), (3, "rope")]
    lines = [("1:0", "The blue kettle cost 4."), ("2:0", "The blue kettle cost 4."), ("3:0", "A lamp. A rope of red silk"), ("4:0", "One measure")]
    got = claims.item_tally(spark.createDataFrame(items, "query_id int, item string"), spark.createDataFrame(lines, "sid string, sentence string"))
    # one word may carry two words of an item
    assert sorted(map(tuple, got.collect())) == [(1, 3, "blue kettle; kettles blue; lamp"), (2, 2, "lamp; rope"), (3, 2, "measured measures; rope")]
