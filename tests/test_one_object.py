"""A fault file of one JSON object is read by several tasks, and equals what a JSON reader gives."""

import json
import random
from collections import Counter

import pytest

from faultline.sources import files


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(seed, n_hours=9, per_hour=40):
    r = random.Random(seed)
    odd = ['x', 'a"b', "c\\", "}{", '"}, {"', "é中😀", "\\\"}]", "\n\t", "", "[{]", '{"k": "v"}']
    entry = lambda: {
        "inject_time": r.choice(odd),
        "inject_timestamp": r.choice([r.randint(0, 10**9), str(r.randint(0, 99)), None]),
        "inject_pod": r.choice(["cartservice-1-2", "a-b", "x"]) + r.choice(["", "}", '"']),
        "inject_type": r.choice(odd),
        "more": {"deep": [{"inject_type": "no"}, {}]},
    }
    hours = {f"{h:02d}": [entry() for _ in range(r.choice([0, 1, per_hour]))] for h in range(n_hours)}
    hours['q"}\\h'] = [entry()]
    hours["last"] = []
    return hours


def want(objects):
    return Counter((h, e["inject_time"], e["inject_pod"], e["inject_type"], None if e["inject_timestamp"] is None else int(e["inject_timestamp"])) for o in objects for h, es in o.items() for e in es)


@pytest.mark.parametrize("indent, end", [(None, ""), (2, "\n"), (None, " \n\n")])
def test_one_object_in_byte_ranges(spark, tmp_path, small_splits, indent, end):
    objects = [made(1), made(2, 3, 5), {}, {"00": []}]
    for i, o in enumerate(objects):
        (tmp_path / f"f{i}.json").write_text(json.dumps(o, indent=indent, ensure_ascii=i % 2 == 0) + end, encoding="utf-8")
    paths = [str(tmp_path / f"f{i}.json") for i in range(len(objects))]
    got = files.fault_file(spark, paths, "s")
    assert Counter((r.hour, r.inject_time, r.pod, r.type, r.ts) for r in got.collect()) == want(objects)
    raw = spark.read.option("lineSep", "}").text(paths[0])
    assert raw.rdd.getNumPartitions() > 4


def test_hours_are_carried_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HOUR_BLOCK", 3)
    one = made(3)
    (tmp_path / "f.json").write_text(json.dumps(one))
    got = files.fault_file(spark, str(tmp_path / "f.json"), "s")
    assert Counter((r.hour, r.inject_time, r.pod, r.type, r.ts) for r in got.collect()) == want([one])


def test_no_faults(spark, tmp_path):
    for i, text in enumerate(["", "{}", "\n", '{"1": [], "2": []}\n']):
        (tmp_path / f"e{i}.json").write_text(text)
        assert files.fault_file(spark, str(tmp_path / f"e{i}.json"), "s").count() == 0
