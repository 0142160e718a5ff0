"""Records in which faults cover every window: stored datasets without rows."""

from faultline.sources import dataset


def test_a_split_without_windows_reads_as_empty(spark, tmp_path):
    row = [("train", "s", 0, 1, 2, "a", 1.5)]
    rows = spark.createDataFrame(row, "split string, system string, window_start bigint, offset bigint, t_idx bigint, entity string, x double")
    root = str(tmp_path / "d")
    dataset.write_windows(root, "nodes", rows.where("false"))
    dataset.write_windows(root, "edges", rows)
    for kind in ("nodes", "edges"):
        got = dataset.read_split(spark, root, "val", kind)
        assert got.count() == 0 and set(got.columns) == set(rows.columns)
    assert [r.x for r in dataset.read_split(spark, root, "train", "edges").collect()] == [1.5]


def test_episodes_without_rows_read_as_empty(spark, tmp_path):
    labels = spark.createDataFrame([], "system string, ts bigint, fault_id bigint, episode string")
    nodes = spark.createDataFrame([("s", 1, "a", 2.0, None)], "system string, ts bigint, entity string, x double, episode string")
    root = str(tmp_path / "e")
    dataset.write_episodes(root, labels, nodes=nodes)
    rows, found = dataset.read_episode(spark, root)
    assert [(r.ts, r.x, r.episode) for r in rows.collect()] == [(1, 2.0, None)]
    assert found.count() == 0 and found.columns[-1] == "episode"
