from dataclasses import replace

from fluxweave.config import EVENTS, GROUPS, FlowConfig
from fluxweave.plans.engine import flow_features
from fluxweave.sources import packets, sinks
from fluxweave.sources.raw import opened
from fluxweave.streaming.flows import write_features

SF = "/root/testdata/sf0.001"
CFG = replace(EVENTS, off=frozenset({*GROUPS} - {"sequence", "fft"} | {"sequence_stats", "raw_sequences", "rate_sequences", "fft_fwd", "fft_bwd"}))


def test_stream_equals_batch(spark, tmp_path):
    """Flows of two files; a last packet far ahead lets the idle time of all others pass."""
    pk = packets.from_events(spark, SF).drop("pkt_no").where("flow_id % 5 = 0")
    end = pk.selectExpr("-1L AS flow_id", "ts_us + 400 * 86400 * 1000000L AS ts_us", "direction", "payload_len", "pkt_len", "proto").limit(1)
    path = str(tmp_path / "in")
    pk.where("ts_us % 2 = 0").coalesce(1).write.parquet(path)
    pk.where("ts_us % 2 = 1").coalesce(1).write.mode("append").parquet(path)
    got = {}

    def sink(features, _):
        for r in features.select("flow_id", "total_bytes", "dl_chunk_seq", "all_fft_mag_0").collect():
            assert r.flow_id not in got
            got[r.flow_id] = r

    for _ in range(2):
        write_features(spark.readStream.schema(pk.schema).option("maxFilesPerTrigger", 1).parquet(path), sink, str(tmp_path / "state"), CFG, idle="100 days", delay="60 days").awaitTermination()
        end.write.mode("append").parquet(path)
        write_features(spark.readStream.schema(pk.schema).parquet(path), sink, str(tmp_path / "state"), CFG, idle="100 days", delay="60 days").awaitTermination()
    want = {r.flow_id: r for r in flow_features(packets.numbered(pk, "ts_us"), CFG).select("flow_id", "total_bytes", "dl_chunk_seq", "all_fft_mag_0").collect()}
    got.pop(-1, None)
    assert got == want


def test_long_flow_equals_batch(spark, tmp_path):
    """A flow of more packets than the sequence groups keep, in two files: all other groups count every packet."""
    flags = "IF(id = 11999, 1, IF(id % 7 = 0, 24, 16)) AS tcp_flags"
    pk = spark.range(12000).selectExpr("id DIV 6000 AS flow_id", "id % 6000 * 1000 + id % 13 AS ts_us", "CAST(id % 3 = 0 AS INT) AS direction", "CAST(id * id % 1400 AS INT) AS payload_len", "CAST(id * id % 1400 + 40 AS INT) AS pkt_len", "6 AS proto", flags)
    pk = pk.where("flow_id = 1")
    path = str(tmp_path / "in")
    pk.where("ts_us < 2500000").coalesce(1).write.parquet(path)
    pk.where("ts_us >= 2500000").coalesce(1).write.mode("append").parquet(path)
    cfg, got = replace(FlowConfig(), off=frozenset({"payload", "fft", "sequence", "udp", "port", "ip", "tcp_window"})), []
    write_features(spark.readStream.schema(pk.schema).option("maxFilesPerTrigger", 1).parquet(path), lambda f, _: got.extend(f.collect()), str(tmp_path / "state"), cfg).awaitTermination()
    want = flow_features(packets.numbered(pk, "ts_us"), cfg).collect()
    assert len(got) == 1 and got == want and got[0].total_packets == 6000


def test_twenty_thousand_packets_in_many_batches(spark, tmp_path):
    """A flow that grows over five batches equals the table; a flow without SYN is left out where opening is required, in both."""
    flags = "CASE WHEN id = 19999 THEN 1 WHEN id % 5000 = 7 THEN 2 ELSE 16 END AS tcp_flags"
    pk = spark.range(20000).selectExpr("1L AS flow_id", "id * 1000 AS ts_us", "CAST(id % 3 - 1 AS INT) AS direction", "id * 31 % 1400 AS payload_len", "id * 31 % 1400 + 40 AS pkt_len", "0 AS proto", flags)
    other = pk.where("ts_us < 50000").selectExpr("2L AS flow_id", "ts_us", "direction", "payload_len", "pkt_len", "proto", "IF(ts_us = 49000, 4, 16) AS tcp_flags")
    path = str(tmp_path / "in")
    for k in range(5):
        (pk.unionByName(other) if k == 0 else pk).where(f"ts_us >= {k} * 4000000 AND ts_us < {k + 1} * 4000000").coalesce(1).write.mode("append").parquet(path)
    cfg, got = replace(FlowConfig(), off=frozenset({"payload", "fft", "sequence", "udp", "ip", "tcp_window"})), []
    write_features(spark.readStream.schema(pk.schema).option("maxFilesPerTrigger", 1).parquet(path), lambda f, _: got.extend(f.collect()), str(tmp_path / "state"), cfg, require_open=True, delay="1 hour").awaitTermination()
    want = flow_features(opened(packets.numbered(pk.unionByName(other), "ts_us")), cfg).collect()
    assert got == want and [(r.flow_id, r.total_packets) for r in got] == [(1, 19993)]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    pk = packets.from_events(spark, SF).where("flow_id < 20")
    features = flow_features(pk, replace(EVENTS, off=frozenset({*GROUPS} - {"basic"})))
    write = sinks.fan_out(sinks.files(str(tmp_path / "a")), sinks.files(str(tmp_path / "b"), "parquet"))
    for batch in (0, 1, 1, 0, 1):
        write(features, batch)
    n = features.count()
    assert spark.read.text(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 2 * n
    keys = [r.key for r in sinks.keyed(features, 7).collect()]
    assert len(set(keys)) == n and all(k.endswith(":7") for k in keys)
    assert any("kafka" in str(e).lower() for e in [_error(lambda: sinks.kafka("localhost:1", "t")(features, 0))])


def _error(call):
    try:
        call()
    except Exception as e:
        return e
