"""Names found once per distinct text against names found row by row."""

import pytest

from faultline.operators import joins


@pytest.mark.parametrize("limit", [50_000, 3])
def test_repeated_texts_find_the_same_names(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    names = spark.createDataFrame([("s", "ab", 1), ("s", "b", 0), ("q", "c", 0)], "system string, name string, idx bigint")
    texts = [("s", "xabx", "b"), ("s", "xabx", "ab"), ("s", "xabx", None), ("s", None, "b"), ("s", "zz", "b"), ("q", "abc", "c"), ("q", "abc", "x"), (None, "ab", "x")]
    rows = spark.createDataFrame([(i, *texts[i % len(texts)]) for i in range(40)], "i int, system string, text string, own string")
    for exclude in (None, "own"):
        asked = [joins.first_containing(rows, "text", names, "hit", exclude, repeated=r) for r in (False, True)]
        one, two = [sorted((r.i, r.hit) for r in df.select("i", "hit").collect()) for df in asked]
        assert one == two and len(two) == 40 and set(asked[1].columns) == {*rows.columns, "hit"}
    assert {r.hit for r in asked[1].where("i = 0").collect()} == {"ab"}
