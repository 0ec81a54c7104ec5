"""The flow queries by name: a packet view, its thresholds, a feature group and the columns to return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EVENTS, FlowConfig
from ..functions.kernels import NINE
from ..functions.recipe import Recipe
from ..operators import headers as H
from ..operators import sequences as S
from ..operators import timing as G
from ..sources import packets as P
from ..sources import raw
from . import engine

DAYS = replace(EVENTS, rate_bin_us=30 * 24 * 3600 * 10**6)


def _texts(table: str, key: str, text: str, direction: int):
    return lambda spark, d: P.from_texts(spark.read.parquet(f"{d}/{table}.parquet"), key, text, direction)


VIEWS = {"events": P.from_events, "lines": P.from_lines, "docs": _texts("documents", "doc_id", "text", 1), "pages": _texts("pages", "page_id", "html", -1), "talks": P.from_conversations}
#: Views that a window over flows numbers.
TOGETHER = {"events", "lines", "talks"}


def nine(*prefixes: str) -> list[str]:
    return [f"{p}_{s}" for p in prefixes for s in NINE]


def plain(df: DataFrame, digits: int | dict[str, int] = 4) -> DataFrame:
    """df with doubles rounded to so many digits (of each column), null for what is not finite, and integers of one kind."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(f"CASE WHEN abs(`{f.name}`) < DOUBLE('Infinity') THEN round(`{f.name}`, {digits if isinstance(digits, int) else digits[f.name]}) + 0.0D END AS `{f.name}`")
        else:
            out.append(f"CAST(`{f.name}` AS LONG) AS `{f.name}`" if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else f"`{f.name}`")
    return df.selectExpr(*out)


def _query(view: str, cfg: FlowConfig, group: Callable[[DataFrame, FlowConfig], DataFrame], columns: list[str] | None, digits: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine.features(VIEWS[view](spark, sf_dir), cfg, [group], view in TOGETHER, columns)
        return plain(found, digits)

    return run


def sni_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hosts = pages.select(F.col("page_id").alias("flow_id"), F.lit(0).cast("long").alias("ts_us"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("server_name"))
    pk = P.from_texts(pages, "page_id", "html", -1)
    return plain(G.counters(pk, FlowConfig()).select("flow_id", "total_packets").join(P.server_names(hosts), "flow_id", "left"))


def flow_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full record of the event flows as JSON."""
    return engine.as_json(engine.flow_features(P.from_events(spark, sf_dir), EVENTS, together=True))


#: Queries whose columns flow_record and flow_json_fields return of the whole record.
RECORD = ("payload_dir", "tcp_flags", "tcp_window", "ip_ttl_tos", "port_features", "retransmission", "rst_interval", "payload_size", "payload_size_diff", "payload_mod", "length_runs")
JSON_FIELDS = ("flow_counters", "basic_ratios", "first_n", "pkt_length_dir", "iat_stats", "iat_autocorr", "iat_fwd_bwd", "burst", "behavior_pattern", "length_values", "bigrams", "chunk_sequence", "window_bytes", "response_delay")


def _columns(names: tuple[str, ...], cfg: FlowConfig) -> dict[str, int]:
    """Columns of some queries, with their digits."""
    found = {}
    for _, _, group, columns, digits in (QUERIES[name] for name in names):
        r = Recipe(cfg, [])
        group.ask(r)
        found |= dict.fromkeys(columns or r.outputs, digits)
    return found


def flow_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of eleven groups, out of the record of all."""
    columns = _columns(RECORD, DAYS)
    return plain(engine.flow_features(P.from_lines(spark, sf_dir), DAYS, together=True, columns=columns).drop("sni"), columns)


def flow_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the JSON text of the event flows' record, read back."""
    columns, record = _columns(JSON_FIELDS, EVENTS), engine.flow_features(P.from_events(spark, sf_dir), EVENTS, together=True)
    schema = T.StructType([record.schema[c] for c in columns])
    return plain(engine.as_json(record).select("flow_id", F.from_json("value", schema).alias("v")).select("flow_id", "v.*"), columns)


def packet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of the events as a capture, with recovered lengths, numbered."""
    pk = raw.numbered(raw.derived(P.raw_events(spark, sf_dir)), "event_id")
    return plain(pk.select("flow_id", "pkt_no", "event_id", "ts_us", "direction", "payload_len", "l2_len", "l3_len", "l4_len", "pkt_len"))


def opened_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the capture's flows from their opening on."""
    pk = raw.opened(raw.numbered(raw.derived(P.raw_events(spark, sf_dir)), "event_id"))
    return plain(engine.features(pk, EVENTS, [G.counters, G.behavior_basic]).select("flow_id", "total_packets", "fwd_packets", "bwd_packets", "total_bytes", "fwd_bytes", "bwd_bytes", "flow_duration"))


def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(engine.flow_features(P.from_lines(spark, sf_dir), DAYS, together=True))


#: name: view, thresholds, group, columns (None: all), digits.
QUERIES = {
    "flow_counters": ("events", EVENTS, G.counters, None, 4),
    "basic_ratios": ("events", EVENTS, G.basic_ratios, None, 4),
    "payload_dir": ("lines", DAYS, G.basic_payload_dir, None, 4),
    "first_n": ("events", EVENTS, G.basic_first_n, None, 4),
    "pkt_length_dir": ("events", EVENTS, G.basic_pkt_length, None, 4),
    "iat_stats": ("events", EVENTS, G.iat_stats, ["iat_mean", "iat_std", "iat_min", "iat_max", "iat_median", "iat_q1", "iat_q3", "interval_coefficient_of_variation"], 2),
    "iat_sequence": ("events", EVENTS, G.iat_stats, nine("iat_sequence"), 2),
    "iat_running_moments": ("events", EVENTS, G.iat_stats, ["iat_skew", "iat_kurt"], 4),
    "iat_entropy": ("events", EVENTS, G.iat_stats, ["iat_entropy"], 4),
    "iat_autocorr": ("events", EVENTS, G.iat_stats, [f"iat_autocorr_lag_{k}" for k in range(1, 6)], 4),
    "interval_ratio": ("events", EVENTS, G.iat_stats, ["interval_ratio_mean"], 3),
    "log_iat": ("events", EVENTS, G.iat_stats, nine("log_iat_sequence"), 4),
    "iat_fwd_bwd": ("events", EVENTS, G.iat_fwd_bwd, [*nine("fwd_iat", "bwd_iat"), "fwd_iat_cv", "bwd_iat_cv"], 2),
    "active_idle": ("events", EVENTS, G.iat_active, None, 4),
    "response_delay": ("events", EVENTS, G.iat_response, None, 3),
    "burst": ("events", EVENTS, G.burst, None, 3),
    "tcp_flags": ("lines", DAYS, H.tcp_flags, None, 4),
    "tcp_window": ("lines", DAYS, H.tcp_window, None, 3),
    "ip_ttl_tos": ("lines", DAYS, H.ip, None, 4),
    "udp_length": ("talks", DAYS, H.udp, None, 4),
    "port_features": ("lines", DAYS, H.port, ["src_ip_is_private", "dst_ip_is_private", "ip_fragmentation_flag", "src_port_is_ephemeral", "dst_port_is_ephemeral", "is_common_service", "quic_usage_flag", "src_port_range", "src_port_protocol", "dst_port_protocol", "well_known_src_port_ratio", "well_known_dst_port_ratio", "unique_src_ports", "unique_dst_ports", "tcppackcnt", "tcppseqcnt", "tcpinitwinsz"], 4),
    "retransmission": ("lines", DAYS, H.port, ["avg_retransmission_rate", "tcpseqfaultcnt", "tcpseqsntbytes", "tcpiseqn"], 4),
    "rst_interval": ("lines", DAYS, H.port, ["rst_trigger_interval"], 3),
    "payload_size": ("lines", DAYS, H.payload_size, nine("payload_size"), 3),
    "payload_size_diff": ("lines", DAYS, H.payload_size, nine("payload_size_diff"), 3),
    "payload_mod": ("lines", DAYS, H.payload_stats, [f"payload_length_mod_{m}_{s}" for m in (2, 4, 8, 16, 32, 64, 128, 256) for s in ("mean", "std")], 4),
    "payload_content": ("talks", DAYS, H.payload_content, None, 4),
    "payload_hist": ("talks", DAYS, H.payload_hist, [f"payload_hist_bin_{k}" for k in range(16)], 4),
    "payload_byte_stats": ("talks", DAYS, H.payload_hist, nine("payload_byte"), 4),
    "payload_magic": ("pages", DAYS, H.payload_magic, None, 3),
    "payload_entropy": ("talks", DAYS, H.payload_stats, ["payload_entropy", "payload_markov_entropy", "payload_autocorrelation_lag1", "payload_first_128_entropy", "payload_first_256_entropy"], 4),
    "payload_compression": ("docs", DAYS, H.payload_stats, ["payload_compression_ratio"], 4),
    "length_autocorr": ("events", EVENTS, S.sequence_stats, [f"length_autocorr_lag_{k}" for k in range(1, 6)], 4),
    "length_runs": ("lines", DAYS, S.sequence_stats, nine("length_run"), 4),
    "length_corr": ("events", EVENTS, S.sequence_stats, ["length_iat_correlation", "length_direction_correlation"], 4),
    "direction_stats": ("talks", DAYS, S.sequence_stats, ["direction_sequence_entropy", "direction_change_frequency", "direction_transition_unique_count"], 4),
    "length_values": ("events", EVENTS, S.sequence_stats, ["length_sequence_unique_ratio", "packet_length_entropy", *[f"packet_length_percentile_{p}" for p in S.PERCENTILES]], 4),
    "complexity": ("events", EVENTS, S.sequence_stats, ["lz78_complexity_index", "length_sequence_complexity", "hurst_exponent_estimate"], 4),
    "hurst": ("events", EVENTS, S.sequence_stats, ["hurst_exponent_estimate"], 4),
    "periodicity": ("events", EVENTS, S.sequence_stats, ["periodic_dominant_freq_ratio", "has_strong_periodicity"], 3),
    "bigrams": ("events", EVENTS, S.bigrams, None, 4),
    "raw_sequences": ("events", EVENTS, S.raw_sequences, None, 4),
    "chunk_sequence": ("events", EVENTS, S.chunk_sequences, None, 4),
    "rate_sequence": ("events", EVENTS, S.rate_sequences, ["uplink_rate_seq_len", "downlink_rate_seq_len"], 4),
    "rate_text": ("events", EVENTS, S.rate_sequences, None, 4),
    "fft_all": ("events", EVENTS, S.fft_global, None, 3),
    "fft_fwd": ("events", EVENTS, S.fft_fwd, None, 3),
    "fft_bwd": ("events", EVENTS, S.fft_bwd, None, 3),
    "window_packets": ("events", EVENTS, G.window_pkt, None, 4),
    "window_bytes": ("events", EVENTS, G.window_byte, None, 3),
    "behavior_basic": ("events", EVENTS, G.behavior_basic, None, 4),
    "behavior_pattern": ("events", EVENTS, G.behavior_pattern, None, 4),
    "behavior_bitrate": ("events", EVENTS, G.behavior_bitrate, None, 4),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: _query(*of) for name, of in QUERIES.items()}, "sni_join": sni_join, "flow_json": flow_json, "flow_features": flow_features, "flow_record": flow_record, "flow_json_fields": flow_json_fields, "packet_source": packet_source, "opened_flows": opened_flows}
