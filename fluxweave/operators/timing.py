"""Groups about sizes and times: basic, inter-arrival, bursts, windows, behavior."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kernels import Lagged, RunningStats, Stats, entropy, flag
from ..functions.recipe import Recipe, feature_group

LAGS = (1, 2, 3, 4, 5)


def forward() -> Column:
    return F.col("direction") == 1


def backward() -> Column:
    return F.col("direction") == -1


def ways() -> tuple[tuple[str, Column], ...]:
    return ("fwd", forward()), ("bwd", backward())


def counts(r: Recipe) -> None:
    """Counts, bytes and times of a flow."""
    r.agg("_n", F.count(F.lit(1)))
    r.agg("_bytes", F.sum("pkt_len"))
    for w, c in ways():
        r.agg(f"_{w}_n", F.count_if(c))
        r.agg(f"_{w}_bytes", F.coalesce(F.sum(F.when(c, F.col("pkt_len"))), F.lit(0)))
    r.agg("_duration", (F.max("ts_us") - F.min("ts_us")) / 1e6)


@feature_group
def counters(r: Recipe) -> None:
    """What a flow shows without order, combined before the shuffle."""
    counts(r)
    first, proto = r.agg("_first", F.min("ts_us")), r.agg("_proto", F.min("proto"))
    r.out(
        total_packets=F.col("_n"), fwd_packets=F.col("_fwd_n"), bwd_packets=F.col("_bwd_n"), total_bytes=F.col("_bytes"), fwd_bytes=F.col("_fwd_bytes"), bwd_bytes=F.col("_bwd_bytes"),
        stream_dir=r.agg("_last_direction", F.max_by("direction", "pkt_no")), createtime=F.when(proto == 0, first).otherwise(0), trans_proto=proto,
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) == 0, F.lit(float("inf"))).otherwise(F.col(a) / F.col(b))


@feature_group
def basic_ratios(r: Recipe) -> None:
    counts(r)
    part = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    r.out(fwd_bwd_packet_ratio=_ratio("_fwd_n", "_bwd_n"), fwd_bwd_byte_ratio=_ratio("_fwd_bytes", "_bwd_bytes"), avg_packet_length=part("_bytes", "_n"), fwd_avg_packet_length=part("_fwd_bytes", "_fwd_n"), bwd_avg_packet_length=part("_bwd_bytes", "_bwd_n"))


@feature_group
def basic_payload_dir(r: Recipe) -> None:
    counts(r)
    size = F.col("payload_len")
    for w, c in ways():
        total, n, p = r.agg(f"_{w}_total", F.coalesce(F.sum(F.when(c, size)), F.lit(0))), F.col(f"_{w}_n"), f"{w}_payload"
        some = Stats(r, p, F.when(c & (size > 0), size), True).columns()
        r.out(**some | {f"{w}_total_payload": total, f"{p}_mean": F.when(n > 0, total / n), **{f"{p}_{s}": F.when(n > 0, F.coalesce(some[f"{p}_{s}"], F.lit(0.0))) for s in ("std", "min", "max")}})


@feature_group
def basic_first_n(r: Recipe) -> None:
    r.out(**Stats(r, "first_n_packets_length", F.when(F.col("pkt_no") <= r.cfg.first_n_packets, F.col("pkt_len")), True).columns())


@feature_group
def basic_pkt_length(r: Recipe) -> None:
    size = F.col("pkt_len")
    for w, c in ways():
        s = Stats(r, f"{w}_packet_length", F.when(c, size), True)
        r.out(**s.columns(), **{f"{w}_packet_length_cv": s.cv()})
    r.out(small_packet_ratio=r.agg("_small", F.avg(flag(size <= r.cfg.small_pkt_threshold))), large_packet_ratio=r.agg("_large", F.avg(flag(size >= r.cfg.large_pkt_threshold))))


@feature_group
def iat_stats(r: Recipe) -> None:
    iat, before = r.iat(), r.lag("iat", 1, 1)
    ratio = r.agg("_iat_ratio", F.avg(F.when(before > 0, iat / before)))
    run, seq, log = RunningStats(r, "iat", iat, False), Stats(r, "iat_sequence", iat, False), Stats(r, "log_iat_sequence", F.log1p("iat"), False)
    lo, hi = r.total("_iat_lo", "min", iat, 1), r.total("_iat_hi", "max", iat, 1)
    r.cell("iat", F.when(hi > lo, F.floor((iat - lo) / (hi - lo) * 31)).otherwise(F.when(iat.isNotNull(), 0)), n=F.lit(1))
    lagged = Lagged(r, "iat_lag", iat - lo, {k: r.lag("iat", k, 1) - lo for k in LAGS})
    columns = {**run.columns(), **seq.columns(), **log.columns(), "interval_coefficient_of_variation": run.cv(), "interval_ratio_mean": ratio, "iat_entropy": entropy(r, "iat", "iat_entropy"), **lagged.correlations("iat_autocorr_lag")}
    r.out(**{name: c if name in ("iat_min", "iat_max") else F.coalesce(c, F.lit(0.0)) for name, c in columns.items()})


@feature_group
def iat_fwd_bwd(r: Recipe) -> None:
    """Gaps between packets of one direction; the flow's first packet starts none."""
    for w, c in ways():
        mine = (F.col("pkt_no") > 1) & c
        gap = r.column(f"_{w}_gap", F.when(mine, F.col("ts_us") - r.last(f"_{w}_ts", F.when(mine, F.col("ts_us")))))
        s = RunningStats(r, f"{w}_iat", gap, False)
        r.out(**s.columns(), **{f"{w}_iat_cv": s.cv()})


@feature_group
def iat_active(r: Recipe) -> None:
    thr, iat = r.cfg.active_iat_threshold_us, r.iat()
    active, idle = (r.agg(name, F.coalesce(F.sum(F.when(c, iat)), F.lit(0)) / 1e6) for name, c in (("_active", iat <= thr), ("_idle", iat > thr)))
    r.out(active_time=active, idle_time=idle, active_time_ratio=F.when(active + idle > 0, active / (active + idle)))


@feature_group
def iat_response(r: Recipe) -> None:
    """Delays (ms) of a backward packet since the forward one that is the last with a direction before it."""
    before = r.last("_with_direction", F.when(F.col("direction") != 0, F.struct("direction", "ts_us")))
    delay = r.column("_delay", F.when(backward() & (before["direction"] == 1), (F.col("ts_us") - before["ts_us"]) / 1000))
    s = Stats(r, "response_delay", delay, False)
    r.out(**s.columns(), is_interactive_session=flag(s.mean < r.cfg.interactive_threshold_ms))


@feature_group
def burst(r: Recipe) -> None:
    """Packets without a larger gap between them, closed by a later packet, of two at least; a burst lasts to the packet that closes it."""
    new = r.column("_new_burst", flag(F.coalesce(r.iat(), F.lit(0)) > r.cfg.burst_iat_threshold_us), 0, 1)
    number, ts = r.so_far("_burst", new), F.col("ts_us")
    r.cell("burst", number, n=F.lit(1), size=F.col("pkt_len"), begin=F.when((new == 1) | (F.col("pkt_no") == 1), ts))
    r.cell("burst", F.when(new == 1, number - 1), close=ts, gap=F.col("iat"))  # the packet that closes a burst
    n, size, gap = F.col("n"), F.col("size"), F.col("gap")
    closed = (F.col("grain") == "burst") & F.col("close").isNotNull() & (n >= 2)
    lasts = F.when(closed, F.col("close") - F.col("begin"))
    add = r.cell_agg
    count, first = add("_bursts", F.count_if(closed)), add("_first_gap", F.min_by(gap, F.when(closed, F.col("key"))))
    mean, variance = add("_gap_avg", F.avg(F.when(closed, gap.cast("double")))), add("_gap_var", F.var_samp(F.when(closed, gap.cast("double"))))
    rest = count - 1  # gaps but the first, which no burst of two comes before
    rest_mean = F.when(rest > 0, (mean * count - first) / rest)
    squares = F.greatest(F.lit(0.0), variance * rest - (first - mean) * (first - mean) * count / rest)
    r.out(
        burst_count=F.coalesce(count, F.lit(0)), avg_burst_size=add("_size_avg", F.avg(F.when(closed, size))), burst_size_std=F.when(count > 0, F.coalesce(add("_size_sd", F.stddev_samp(F.when(closed, size))), F.lit(0.0))),
        avg_burst_duration=add("_lasts_avg", F.avg(lasts)) / 1e6, burst_packet_count_mean=add("_packets_avg", F.avg(F.when(closed, n))), burst_packet_rate_peak=add("_peak", F.max(F.when(lasts > 0, n * 1e6 / lasts))),
        burst_interval_mean=rest_mean / 1e6, burstiness_index=F.when(count == 1, 0.0).when(rest > 1, F.sqrt(squares / (rest - 1)) / rest_mean),
    )


def windows(r: Recipe) -> tuple[Column, Column]:
    """Packets and bytes of each window, from the flow's first packet on, that has a packet; null for other cells."""
    w = F.floor((F.col("ts_us") - r.begin()) / (r.cfg.window_size_ms * 1000))
    r.cell("window", F.when(w < r.cfg.max_windows, w), n=F.lit(1), size=F.col("pkt_len"))
    mine = F.col("grain") == "window"
    return F.when(mine, F.col("n")), F.when(mine, F.col("size"))


@feature_group
def window_pkt(r: Recipe) -> None:
    r.out(**Stats(r, "window_packet_count", windows(r)[0], True, cells="n").columns())


@feature_group
def window_byte(r: Recipe) -> None:
    r.out(**Stats(r, "window_byte_count", windows(r)[1], True, cells="size").columns())


@feature_group
def behavior_basic(r: Recipe) -> None:
    counts(r)
    d, bits = F.col("_duration"), F.col("_bytes") * 8
    some = lambda v: F.when(d > 0, v)
    r.out(
        flow_duration=d, avg_bitrate=some(bits / d), avg_packet_rate=some(F.col("_n") / d), avg_throughput=some(F.col("_bytes") / 1024 / d),
        is_bulk_transfer=some(flag(bits / d / 1000 > r.cfg.bulk_transfer_kbps)), short_connection_ratio=some(flag(d < r.cfg.short_conn_threshold_s)),
    )


@feature_group
def behavior_pattern(r: Recipe) -> None:
    counts(r)
    a = F.when((F.col("_fwd_bytes") == 0) & (F.col("_bwd_bytes") == 0), 1.0).otherwise(_ratio("_fwd_bytes", "_bwd_bytes"))
    iat, size = r.iat(), windows(r)[1]
    mean, sd = F.coalesce(r.agg("_gap_mean", F.avg(iat)), F.lit(0.0)), F.coalesce(r.agg("_gap_sd", F.stddev_samp(iat)), F.lit(0.0))
    tcp, udp = (r.agg(f"_proto_{k}", F.avg(flag(F.col("proto") == k))) for k in (0, 1))
    r.out(
        flow_asymmetry_ratio=a, flow_pattern=F.when(a < 0.5, "download_heavy").when(a > 2, "upload_heavy").when(a.between(0.8, 1.25), "balanced").otherwise("asymmetric"), protocol_tcp_ratio=tcp, protocol_udp_ratio=udp,
        peak_bitrate=r.cell_agg("_window_peak", F.max(size)) * 8 / (r.cfg.window_size_ms / 1000), has_regular_intervals=flag(F.when(mean == 0, 0.0).otherwise(sd / mean) < 0.5), protocol_icmp_ratio=F.lit(0.0), protocol_other_ratio=1 - tcp - udp,
    )


@feature_group
def behavior_bitrate(r: Recipe) -> None:
    """A flow has at most max_windows windows, so their bytes fit into an array."""
    size = windows(r)[1]
    rate = size * 8 / (r.cfg.window_size_ms / 1000)
    s = Stats(r, "instant_bitrate", rate, False, cells="size")
    ranks, every = r.cell_quantiles("bitrate", rate, [0.25, 0.5, 0.75, 0.9], "size"), r.cell_gathered("_window_sizes", F.collect_list(size))
    total = F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a + x)
    terms = F.transform(every, lambda x: F.when(x > 0, -x / total * F.log2(x / total)).otherwise(0.0))
    mean = F.when(F.size(every) > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.size(every))
    r.out(**s.columns(), traffic_entropy_ts_mean=mean, traffic_entropy_ts_peak=F.array_max(terms), **{f"bitrate_percentile_{p}": ranks[k] for k, p in enumerate((25, 50, 75, 90))})
