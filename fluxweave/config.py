"""Thresholds and switches of the flow features, from code or from an INI file."""

from __future__ import annotations

import configparser
import dataclasses
from dataclasses import dataclass, field

#: Output groups by master switch; a group is computed if its own switch and its master's are on.
GROUPS = {
    "basic": ("basic_ratios", "basic_payload_dir", "basic_first_n", "basic_pkt_length"),
    "iat": ("iat_stats", "iat_fwd_bwd", "iat_active", "iat_response"),
    "burst": ("burst",),
    "protocol": ("tcp_flags", "tcp_window", "ip", "udp", "port"),
    "payload": ("payload_size", "payload_content", "payload_hist", "payload_magic", "payload_stats"),
    "sequence": ("sequence_stats", "raw_sequences", "chunk_sequences", "rate_sequences"),
    "fft": ("fft_global", "fft_fwd", "fft_bwd"),
    "window": ("window_pkt", "window_byte"),
    "behavior": ("behavior_basic", "behavior_pattern", "behavior_bitrate"),
}


@dataclass(frozen=True)
class FlowConfig:
    """Times in µs unless the name says otherwise."""

    small_pkt_threshold: int = 64
    large_pkt_threshold: int = 1200
    burst_iat_threshold_us: int = 1000
    active_iat_threshold_us: int = 1000
    window_size_ms: int = 1000
    interactive_threshold_ms: float = 100
    bulk_transfer_kbps: float = 10
    short_conn_threshold_s: float = 2
    first_n_packets: int = 10
    chunk_gap_us: int = 100_000
    rate_bin_us: int = 50_000
    max_windows: int = 100
    max_sequence: int = 5000
    segment: int = 1 << 16  # packets of a flow that are dealt out together
    off: frozenset[str] = field(default_factory=frozenset)

    def on(self, group: str) -> bool:
        master = next(m for m, subs in GROUPS.items() if group in subs)
        return not self.off & {group, master}

    @classmethod
    def load(cls, text: str) -> FlowConfig:
        """From INI text: numbers by field name in any section; a switch enable_<group or master> = 0 turns that off."""
        ini = configparser.ConfigParser()
        ini.read_string(text)
        found = {k: v for s in ini.sections() for k, v in ini[s].items()}
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls) if f.name != "off"}
        values = {k: kinds[k](float(found[k])) for k in kinds if k in found}
        n = values.get("first_n_packets", 10)
        values["first_n_packets"] = 10 if n == 0 else min(n, 1024)
        off = {k.removeprefix("enable_") for k, v in found.items() if k.startswith("enable_") and not float(v)}
        return cls(**values, off=frozenset(off))


#: For event tables with gaps of hours.
EVENTS = FlowConfig(burst_iat_threshold_us=6 * 3600 * 10**6, active_iat_threshold_us=6 * 3600 * 10**6, chunk_gap_us=12 * 3600 * 10**6, window_size_ms=24 * 3600 * 1000, rate_bin_us=24 * 3600 * 10**6)
