"""Readers on files as they come."""

import json

import pytest

from faultline.operators import graph
from faultline.sources import files


def test_fault_file_with_several_hours(spark, tmp_path):
    path = tmp_path / "2022-08-22-fault_list.json"
    entry = lambda t, pod, kind: {"inject_time": "x", "inject_timestamp": t, "inject_pod": pod, "inject_type": kind}
    path.write_text(json.dumps({"01": [entry(5, "cartservice-1-2", "cpu"), entry("7", "a-b", "net")], "02": [entry(9, "x", "oom")]}, indent=1))
    got = sorted(tuple(r) for r in files.fault_file(spark, str(path), "s").select("ts", "entity", "type", "hour").collect())
    assert got == [(5, "cartservice", "cpu", "01"), (7, "a", "net", "01"), (9, "x", "oom", "02")]


def test_metric_files_by_position(spark, tmp_path):
    header = ",".join(f"h{i}" for i in range(20))
    line = lambda ts, cpu: ",".join({1: ts, 2: "Frontend-a-b", 4: cpu}.get(i, str(i)) for i in range(20))
    (tmp_path / "frontend-a-b_metric.csv").write_text("\n".join([header, line("10", "0.5"), line("x", "1"), line("20", "bad")]))
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    rows = files.metric_files(spark, str(tmp_path), "s").collect()
    assert sorted((r.ts, r.entity, r.cpu, r.success, r.file_pod) for r in rows) == [
        (10, "frontend", "0.5", "18", "frontend"),
        (20, "frontend", "bad", "18", "frontend"),
    ]


def test_trace_files_takes_the_first_in_name_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}_trace.csv").write_text(f"StartTimeUnixNano,Duration,PodName,OperationName,ParentID\n{i},1,p,op,root\n")
    got = sorted(r.start_ns for r in files.trace_files(spark, str(tmp_path), "s", max_files=2).collect())
    assert got == [0, 1]


def test_dependency_file_drops_addresses(spark, tmp_path):
    path = tmp_path / "dependency.csv"
    path.write_text("source,target\n Front ,Cart\nFront,10.0.0.1\nCart,redis.a.b\nCart,Redis\n")
    edges = graph.clean_dependencies(files.dependency_file(spark, str(path), "s"))
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("cart", "redis"), ("front", "cart")]
    nodes = graph.graph_nodes(edges)
    assert [r.entity for r in nodes.orderBy("entity_idx").collect()] == ["front", "cart", "redis"]


def test_record_file_without_level(spark, tmp_path):
    path = tmp_path / "record.csv"
    path.write_text("component,reason,timestamp\nMysql02,high cpu,5.5\n")
    assert [tuple(r) for r in files.record_file(spark, str(path), "s").collect()] == [("s", "Mysql02", "high cpu", 5.5, "pod")]


def test_service_metrics_of_both_kinds(spark, tmp_path):
    for day, name, text in (
        ("2021_03_04", "metric_service.csv", "service,timestamp,rr,sr,mrt\na,1,2,99,4\n"),
        ("2021_03_05", "metric_app.csv", "tc,startTime,num,avg_time\nb,5999,7,10\n"),
        ("2021_03_06", "metric_app.csv", "tc,startTime,num,avg_time\nc,1,1,1\n"),
    ):
        folder = tmp_path / "telemetry" / day / "metric"
        folder.mkdir(parents=True)
        (folder / name).write_text(text)
    rows = files.service_metric_files(spark, str(tmp_path), "s", max_days=2).collect()
    got = sorted((r.day, r.ts, r.entity, r.workload_ops, r.success_rate, r.latency_p90_ms, r.latency_p99_ms) for r in rows)
    assert got == [("2021_03_04", 1, "a", 2.0, 99.0, 4.0, 6.0), ("2021_03_05", 5, "b", 7.0, 100.0, 10.0, 15.0)]
    with pytest.raises(FileNotFoundError):
        files.service_metric_files(spark, str(tmp_path / "telemetry"), "s")


def test_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "a_trace.csv").write_text("StartTimeUnixNano,Duration,PodName,OperationName,ParentID\n10.0,1,p,op,root\n")
    (tmp_path / "b_trace.csv").write_text("ParentID,OperationName,StartTimeUnixNano,Duration\nx,get,1.6e9,2.9\n")
    (tmp_path / "c_trace.csv").write_text("")
    got = sorted((r.start_ns, r.duration_ns, r.pod, r.operation, r.parent) for r in files.trace_files(spark, str(tmp_path), "s").collect())
    assert got == [(10, 1, "p", "op", "root"), (1_600_000_000, 2, "", "get", "x")]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.csv").write_text('TimeUnixNano,PodName,Log\n5.0,p,"{""a"": 1}"\n')
    (logs / "b.csv").write_text("Log,TimeUnixNano,PodName\nhello,6,q\n")
    got = sorted((r.time_ns, r.pod, r.log) for r in files.log_files(spark, str(logs), "s").collect())
    assert got == [(5, "p", '{"a": 1}'), (6, "q", "hello")]
    kpis = tmp_path / "kpis"
    kpis.mkdir()
    (kpis / "a.csv").write_text("timestamp,cmdb_id,kpi_name,value\n7.0,e,k,1.5\n")
    (kpis / "b.csv").write_text("Value,NAME,cmdb_id,TimeStamp\n2,k,f,8\n")
    got = sorted((r.ts, r.entity, r.kpi_name, r.value) for r in files.kpi_file(spark, str(kpis), "s").collect())
    assert got == [(7, "e", "k", 1.5), (8, "f", "k", 2.0)]
    with pytest.raises(FileNotFoundError):
        files.trace_files(spark, str(logs), "s")


def test_days_of_one_kind_with_different_columns(spark, tmp_path):
    for day, text in (("20a", "service,timestamp,rr,sr,mrt\na,1.0,2,99,4\n"), ("20b", "mrt,sr,rr,timestamp,service\n8,98,3,2,b\n")):
        folder = tmp_path / "telemetry" / day / "metric"
        folder.mkdir(parents=True)
        (folder / "metric_service.csv").write_text(text)
    rows = files.service_metric_files(spark, str(tmp_path), "s").collect()
    got = sorted((r.day, r.ts, r.entity, r.workload_ops, r.success_rate, r.latency_p90_ms) for r in rows)
    assert got == [("20a", 1, "a", 2.0, 99.0, 4.0), ("20b", 2, "b", 3.0, 98.0, 8.0)]


def test_dependency_list_of_several_files_keeps_its_order(spark, tmp_path):
    (tmp_path / "0.csv").write_text("source,target\na,b\n")
    (tmp_path / "1.csv").write_text("source,target\n" + "".join(f"s{i:03},t\n" for i in range(300)))
    (tmp_path / "2.csv").write_text("source,target\n" + "".join(f"u{i:03},t\n" for i in range(40)))
    rows = files.dependency_file(spark, str(tmp_path), "s").orderBy("pos").collect()
    assert [r.source for r in rows] == ["a"] + [f"s{i:03}" for i in range(300)] + [f"u{i:03}" for i in range(40)]
