"""The lookup builds no table of all names or records in the driver."""

from cairn.operators import records


def test_lookup_broadcasts_no_table_of_names(spark):
    cells = spark.createDataFrame([("valve nine", "pressure", "12 bar"), ("valve ten", "pressure", "9 bar")], "entity string, field string, value string")
    asked = spark.createDataFrame([(1, "Which pressure has valve nine?")], "question_id int, question string")
    got = records.lookup(cells, cells.select("entity").distinct(), asked)
    assert [tuple(r) for r in got.collect()] == [(1, "12 bar")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
