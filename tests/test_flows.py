"""Hand-computed fixtures, properties, and parity with SQL on the smallest tables."""

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxweave.config import EVENTS, GROUPS, FlowConfig
from fluxweave.operators import headers as H
from fluxweave.operators import sequences as S
from fluxweave.operators import timing as T
from fluxweave.plans import engine, oracles
from fluxweave.plans import queries as Q
from fluxweave.functions import recipe, udfs
from fluxweave.sources import packets, raw

SF = "/root/testdata/sf0.001"
F1 = [(1000000, 1, 60, 0), (1000400, -1, 60, 0), (1000900, 1, 52, 0), (1001500, 1, 569, 517), (1041500, -1, 1500, 1448), (1041900, -1, 1500, 1448), (1042300, -1, 700, 648), (1192300, 1, 52, 0), (2292300, 1, 252, 200), (2342300, -1, 52, 0)]


EDGES = {2: [(5, 1, 100, 60)], 3: [(5, 1, 100, 60), (9, 1, 100, 60)], 4: [(k * 10, 1, 77, 0) for k in range(40)], 5: [(1, 0, 50, 10), (2, 1, 50, 10)]}


def flow(spark, flows):
    rows = [(i, n, *r, 0) for i, rows in flows.items() for n, r in enumerate(rows, 1)]
    return spark.createDataFrame(rows, "flow_id long, pkt_no int, ts_us long, direction int, pkt_len long, payload_len long, proto int")


@pytest.fixture(scope="module")
def records(spark):
    return {r.flow_id: r.asDict() for r in engine.flow_features(flow(spark, {1: F1} | EDGES)).collect()}


@pytest.fixture(scope="module")
def first(records):
    return records[1]


def test_all_columns(first):
    assert len(first) == 521  # flow_id and 520 features


@pytest.mark.parametrize("name, value", {
    "total_packets": 10, "fwd_packets": 5, "total_bytes": 4797, "fwd_bytes": 985, "flow_duration": 1.3423, "avg_bitrate": 28589.734, "avg_packet_rate": 7.449899, "avg_throughput": 3.489958,
    "flow_asymmetry_ratio": 0.258395, "fwd_packet_length_std": 224.848838, "fwd_packet_length_median": 60, "fwd_packet_length_skew": 0.756119, "fwd_packet_length_kurt": -1.404102, "bwd_packet_length_q1": 60,
    "iat_mean": 149144.444444, "iat_std": 359931.330642, "iat_skew": 1.407964, "iat_kurt": -0.483924, "iat_sequence_skew": 2.003947, "iat_sequence_kurt": 2.429499, "iat_autocorr_lag_1": 0.005043, "iat_autocorr_lag_5": -1.386550,
    "fwd_iat_mean": (600 + 190800 + 1100000) / 3, "active_time": 0.0023, "idle_time": 1.34, "response_delay_mean": 30.133333, "response_delay_q1": 20.2, "response_delay_skew": -0.322928, "response_delay_kurt": 0,
    "burst_count": 2, "avg_burst_size": 2220.5, "traffic_entropy_ts_mean": 0.170346, "traffic_entropy_ts_peak": 0.252224, "window_packet_count_mean": 5, "window_byte_count_max": 4493, "length_run_mean": 1.25, "length_run_skew": 0.945108,
    "length_autocorr_lag_1": 0.610243, "length_autocorr_lag_5": -0.501492, "lz78_complexity_index": 7, "packet_length_entropy": 2.446439, "length_sequence_unique_ratio": 0.6, "direction_change_frequency": 0.555556, "direction_sequence_entropy": 1.0,
    "length_direction_correlation": -0.508445, "length_iat_correlation": -0.294109, "packet_length_percentile_10": 52, "packet_length_percentile_90": 1500, "all_fft_freq_0_idx": 1, "all_fft_mag_0": 4102.1126, "all_fft_mag_4": 621.9457,
    "all_fft_magnitude_std": 1752.275, "all_fft_magnitude_skew": 0.357748, "psd_peak": 16827328.0585, "periodic_dominant_freq_ratio": 20.944152, "has_strong_periodicity": 1, "hurst_exponent_estimate": 0.5, "top_1_bigram_ss_freq": 3,
}.items())
def test_fixture(first, name, value):
    assert math.isclose(first[name], value, rel_tol=1e-5, abs_tol=1e-5)


def test_fixture_texts(first):
    assert first["flow_pattern"] == "download_heavy" and first["dl_chunk_seq"] == "60,60,621,3700,52,252,52" and first["packet_iat_seq"] == "400,500,600,40000,400,400,150000,1100000,50000"


def test_payload_fixture(spark):
    pk = engine.complete(packets.from_texts(spark.createDataFrame([(1, "GET / HTTP/1.1\r\n\r\n")], "id long, text string"), "id", "text"))
    f = {k: v for group in ("payload_stats", "payload_content", "payload_magic", "payload_hist") for k, v in engine.GROUP_OF[group](pk, FlowConfig()).head().asDict().items()}
    want = {"payload_entropy": 3.350209, "payload_markov_entropy": 0.632640, "payload_autocorrelation_lag1": 0.697780, "payload_compression_ratio": 1.444444, "payload_printable_ratio": 14 / 18, "payload_alnum_ratio": 9 / 18, "payload_chi_square": 44.222222, "payload_magic_http_get": 1, "payload_looks_like_http": 1, "payload_hist_bin_2": 5 / 18}
    assert all(math.isclose(f[k], v, rel_tol=1e-5) for k, v in want.items())


def test_edges(records):
    one, up, same, unknown = (records[k] for k in (2, 3, 4, 5))
    assert one["flow_duration"] == 0 and one["avg_bitrate"] is None and one["all_fft_mag_0"] is None and one["length_run_mean"] == 1 and one["length_autocorr_lag_1"] == 0 and one["iat_min"] is None
    assert up["fwd_bwd_packet_ratio"] == math.inf and up["flow_pattern"] == "upload_heavy" and up["bwd_packet_length_mean"] is None and up["direction_sequence_entropy"] == 0 and up["all_fft_freq_0_idx"] == 0
    assert same["fwd_packet_length_std"] == 0 and same["fwd_packet_length_skew"] == 0 and same["length_run_max"] == 40 and same["fwd_packet_length_median"] == 77
    assert (unknown["total_packets"], unknown["fwd_packets"], unknown["bwd_packets"]) == (2, 1, 0)


def test_switches_and_config(spark):
    cfg = FlowConfig.load("[FEATURE]\nfirst_n_packets=0\nburst_iat_threshold_us=7\n[FEATURES]\n" + "".join(f"enable_{m}=0\n" for m in ("payload", "protocol", "sequence", "iat", "behavior", "fft_fwd")))
    assert cfg.first_n_packets == 10 and cfg.burst_iat_threshold_us == 7 and not cfg.on("payload_hist") and not cfg.on("fft_fwd") and cfg.on("fft_bwd")
    rows = spark.createDataFrame([(1, 5, "a" * 200), (1, 9, "later.example"), (2, 1, "")], "flow_id long, ts_us long, server_name string")
    f = engine.flow_features(flow(spark, {1: EDGES[2]}), cfg, packets.server_names(rows, rows.limit(0)))
    assert "payload_entropy" not in f.columns and "fwd_fft_mag_0" not in f.columns and "bwd_fft_mag_0" in f.columns
    text = engine.as_json(f).head().value
    assert '"sni":"later.example"' in text and "Infinity" not in text and "fwd_bwd_packet_ratio" not in text
    assert sum(len(v) for v in GROUPS.values()) == 31


def test_order_of_rows_is_nothing(spark):
    pk = packets.from_events(spark, SF)
    a, b = (sorted(map(tuple, Q.plain(S.chunk_sequences(x, EVENTS).join(T.iat_stats(x, EVENTS), "flow_id"), 3).collect())) for x in (pk, pk.orderBy(F.rand(3))))
    assert a == b
    totals = {r.flow_id: r.n for r in pk.groupBy("flow_id").agg(F.sum("pkt_len").alias("n")).collect()}
    assert all(sum(map(int, r.dl_chunk_seq.split(","))) == totals[r.flow_id] for r in S.chunk_sequences(pk, EVENTS).collect())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_parity_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "conversations", "pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = Q.queries()[name](spark, SF)
    theirs = con.sql(oracles.oracle_sql()[name])
    keys, order = [c for c in ("flow_id", "pkt_no") if c in ours.columns], list(theirs.columns)
    names = keys + sorted({*ours.columns} - {*keys})
    assert sorted(order) == sorted(names)
    first = lambda r: r[: len(keys)]
    rows = sorted((tuple(r) for r in ours.select(*names).collect()), key=first)
    at = [order.index(c) for c in names]
    for x, y in zip(rows, sorted((tuple(r[k] for k in at) for r in theirs.fetchall()), key=first), strict=True):
        assert x == y


def test_packets_are_dealt_out_once(spark):
    """Flows of at most one segment need no exchange but the one that numbers them, however many readers and quantiles there are."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is reused
    try:
        for name in ("length_runs", "iat_stats"):
            plan = Q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"- Exchange ", plan)) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_long_and_short_flows_together(spark):
    """Each flow is dealt out by its own length: beside one of several segments, short ones have the features they have alone, numbered by a window or not."""
    rng = random.Random(7)
    pk = flow(spark, {f: [(k * 1000 + rng.randrange(900), rng.choice((1, -1, 0)), rng.randrange(40, 1500), 0) for k in range(n)] for f, n in enumerate((300, 40, 41, 1, 7))})
    groups = [T.iat_stats, T.burst, S.sequence_stats]
    found = [{x.flow_id: x.asDict() for x in engine.features(pk, FlowConfig(segment=n), groups, together).collect()} for n, together in ((1 << 16, False), (40, False), (40, True))]
    for other in found[1:]:
        assert other.keys() == found[0].keys() == set(range(5))
        for f, row in found[0].items():
            assert all(v == other[f][k] or isinstance(v, float) and math.isclose(v, other[f][k], rel_tol=1e-9, abs_tol=1e-9) for k, v in row.items())


def test_statistics_of_short_flows_from_arrays(spark, monkeypatch):
    """They are those of aggregates and counts by value; and the plan has no moments and no counts by value."""
    pk = packets.from_lines(spark, SF).union(packets.from_lines(spark, SF).limit(0))
    ask = [T.basic_payload_dir, T.iat_stats, T.iat_response, T.burst, T.window_byte, T.behavior_bitrate, H.payload_stats, S.sequence_stats]
    short = engine.features(pk, Q.DAYS, ask)
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert "skewness" not in plan and "which" not in plan and "of_arrays" in plan
    monkeypatch.setattr(recipe, "SHORT", 3)  # flows of more packets are computed without arrays then
    mixed = engine.features(pk, Q.DAYS, ask)
    assert "skewness" in mixed._jdf.queryExecution().optimizedPlan().toString()
    a, b = ({x.flow_id: x.asDict() for x in df.collect()} for df in (short, mixed))
    assert a.keys() == b.keys() and len(a) > 1000
    for f, row in a.items():
        assert all(v == b[f][k] or isinstance(v, float) and math.isclose(v, b[f][k], rel_tol=1e-9, abs_tol=1e-9) for k, v in row.items())


def test_record_of_some_columns(spark):
    """It has the values of the whole record, and asks for nothing else of the packets."""
    pk, columns = flow(spark, {1: F1} | EDGES), ["length_run_median", "total_packets", "fwd_iat_skew", "burst_count", "iat_autocorr_lag_2"]
    some = engine.flow_features(pk, FlowConfig(), columns=columns)
    assert some.columns == ["flow_id", *columns, "sni"]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "spectrum" not in plan and "_values" in plan and "response_delay" not in plan and "_window_sizes" not in plan and len(plan) < 60_000
    whole = engine.flow_features(pk, FlowConfig())
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(some.columns).collect()))


def test_spectra_together(spark):
    """Sequences of unlike lengths in one batch have the spectra they have alone."""
    r = random.Random(2)
    rows = [[r.randrange(1500) for _ in range(r.choice((0, 1, 2, 3, 7, 40)))] for _ in range(60)]
    together, alone = (spark.createDataFrame(list(enumerate(rows)), "id int, xs array<long>").coalesce(1).withColumn("f", udfs.spectrum("xs")) for _ in range(2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        one = sorted(map(str, alone.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == sorted(map(str, together.collect()))


def test_segments_of_a_long_flow_are_nothing(spark):
    """Dealt out in segments of 40 packets, a flow has the features it has as one; so has a tail of 130 packets."""
    r = random.Random(5)
    rows, t = [], 0
    for n in range(1, 1001):
        t += r.choice([3, 400, 1500, 200_000])
        size = r.choice([0, 0, 10, 500, 1448])
        rows.append((n % 2 and 1, n // 2 + 1 if n % 2 else n // 2, t, r.choice([1, -1, 1, 0]), size + 52, size, 0, r.choice([2, 16, 18, 24, 4]), r.randrange(5000), r.randrange(900), bytes(r.randrange(256) for _ in range(size))))
    pk = spark.createDataFrame(rows, "flow_id long, pkt_no int, ts_us long, direction int, pkt_len long, payload_len long, proto int, tcp_flags int, tcp_window int, tcp_seq long, payload binary")
    cfg = FlowConfig(max_sequence=130)
    whole, parts = ({x.flow_id: x.asDict() for x in engine.flow_features(pk, c).collect()} for c in (cfg, replace(cfg, segment=40)))
    assert set(whole) == set(parts) == {0, 1}
    for k in whole:
        for name, v in whole[k].items():
            w = parts[k][name]
            assert v == w or (isinstance(v, float) and math.isclose(v, w, rel_tol=1e-7, abs_tol=1e-9)), (name, v, w)


def test_numbering_by_spans(spark):
    pk = packets.raw_events(spark, SF)
    a = raw.numbered(raw.derived(pk), "event_id", span_us=3600 * 10**6).select("flow_id", "event_id", "pkt_no")
    b = packets.numbered(raw.derived(pk), "ts_us", "event_id").select("flow_id", "event_id", "pkt_no")
    assert a.count() > 100 and a.exceptAll(b).count() == 0
    assert raw.derived(pk, "arrival").where("ts_us % 1000 = 0").count() == pk.count()
    assert raw.derived(pk.withColumn("arrived_ms", F.lit(7)), "arrival").agg(F.min("ts_us"), F.max("ts_us")).head() == (7000, 7000)


def phrases(xs):
    seen, word, n = set(), (), 0
    for x in xs:
        word += (x,)
        if word not in seen:
            seen.add(word)
            word, n = (), n + 1
    return n if len(xs) > 1 else 0


def test_vectorised_functions_from_sql(spark):
    """Registered, by name, against plain versions."""
    udfs.register(spark)
    r = random.Random(3)
    rows = [(k, [r.randrange(3) for _ in range(r.randrange(0, 80))], bytes(r.randrange(4) for _ in range(r.randrange(0, 60)))) for k in range(40)] + [(40, None, None)]
    spark.createDataFrame(rows, "id int, xs array<int>, b binary").createOrReplaceTempView("things")
    got = {x.id: x for x in spark.sql("SELECT id, lz78_phrases(xs) AS n, compressed_share(b) AS z, byte_counts(b) AS c, byte_order(b) AS o FROM things").collect()}
    for k, xs, b in rows:
        assert got[k].n == (phrases(xs) if xs else 0)
        assert got[k].z == (len(zlib.compress(b)) / len(b) if b else None) and got[k].c == ([b.count(v) for v in range(256)] if b else None)
        if b:
            pairs, firsts = Counter(zip(b, b[1:])), Counter(b[:-1])
            want = -sum(n / (len(b) - 1) * math.log2(n / firsts[x]) for (x, _), n in pairs.items())
            assert math.isclose(got[k].o.markov, want, abs_tol=1e-9)
