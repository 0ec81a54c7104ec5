"""Groups about headers and payload bytes: protocol and payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kernels import RunningStats, flag
from ..functions.recipe import Recipe, feature_group
from ..functions.udfs import byte_counts, byte_entropy, byte_order, byte_terms, compressed_share

#: Bytes and non-empty packets that the entropies of a flow's beginning look at.
HEAD = 256


def is_tcp() -> Column:
    return F.col("proto") == 0


def is_udp() -> Column:
    return F.col("proto") == 1


def has_bytes() -> Column:
    return F.col("payload_len") > 0


# Bits of TCP flags, and names of well-known ports.
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
PORT_NAMES = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 143: "IMAP", 443: "HTTPS",
    465: "SMTPS", 587: "SUBMISSION", 993: "IMAPS", 995: "POP3S", 3306: "MYSQL", 3389: "RDP", 5432: "POSTGRESQL", 6379: "REDIS", 8080: "HTTP-ALT", 8443: "HTTPS-ALT",
}


def has(bits: int) -> Column:
    return is_tcp() & (F.col("tcp_flags").bitwiseAND(bits) == bits)


def main_flags(r: Recipe) -> dict[str, Column]:
    return {f"tcp_{name}_count": r.agg(f"_{name}", F.count_if(has(bits))) for name, bits in (("syn", SYN), ("fin", FIN), ("rst", RST), ("ack", ACK))}


@feature_group
def tcp_flags(r: Recipe) -> None:
    n = lambda name, c: r.agg(f"_{name}", F.count_if(c))
    main, update = main_flags(r), has(ACK) & ~has_bytes() & (r.lag("tcp_window") != F.col("tcp_window"))
    tcp, syn, syn_ack, syn_only = n("tcp", is_tcp()), main["tcp_syn_count"], n("syn_ack", has(SYN | ACK)), n("syn_only", has(SYN) & ~has(ACK))
    only_ack, payload = n("ack_only", is_tcp() & (F.col("tcp_flags") == ACK) & ~has_bytes()), n("tcp_payload", is_tcp() & has_bytes())
    share = lambda a, b: F.when(b > 0, a / b)
    r.out(
        **main, tcp_psh_count=n("psh", has(PSH)), tcp_urg_count=n("urg", has(URG)), tcp_syn_packets=syn, tcp_syn_ack_packets=syn_ack, tcp_ack_only_count=only_ack, tcp_payload_packets=payload,
        tcp_zero_window_count=n("zero_window", is_tcp() & (F.col("tcp_window") == 0)), window_update_frequency=n("window_update", update), l2_packets_count=r.agg("_n", F.count(F.lit(1))),
        **{c: F.lit(0) for c in ("icmp_packet_count", "header_anomaly_count", "tcp_header_anomaly_count")}, header_anomaly_ratio=F.lit(0.0), tcp_connection_success_rate=share(syn_ack, syn), tcp_syn_ratio=share(syn, tcp), tcp_rst_ratio=share(main["tcp_rst_count"], tcp),
        tcp_ack_only_ratio=share(only_ack, tcp), tcp_payload_packet_ratio=share(payload, tcp), tcp_syn_only_ratio=share(syn_only, tcp), tcp_half_open_ratio=F.when(syn == 0, 0.0).otherwise((syn - syn_ack) / syn),
    )


@feature_group
def tcp_window(r: Recipe) -> None:
    r.out(**RunningStats(r, "tcp_window", F.when(is_tcp(), F.col("tcp_window")), True).columns())


@feature_group
def ip(r: Recipe) -> None:
    r.out(**RunningStats(r, "ip_ttl", F.col("ttl"), True).columns(), **RunningStats(r, "ip_tos", F.col("tos"), True).columns(), **{f"ip_ttl_eq_{v}_count": r.agg(f"_ttl_{v}", F.count_if(F.col("ttl") == v)) for v in (32, 64, 128, 255)})


@feature_group
def udp(r: Recipe) -> None:
    r.out(**RunningStats(r, "udp_length", F.when(is_udp(), F.col("payload_len") + 8), True).columns())


def private_address(address: Column) -> Column:
    return address.rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def port_name(port: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PORT_NAMES.items() for x in kv]), port.cast("int")), F.lit("UNKNOWN"))


def port_range(port: Column) -> Column:
    return F.when(port < 1024, "well_known").when(port < 49152, "registered").otherwise("dynamic")


@feature_group
def port(r: Recipe) -> None:
    """A packet is sent again if it is TCP, has bytes and is not beyond the sequence number of the last such packet of its direction."""
    mine, way = is_tcp() & has_bytes(), F.col("direction")
    before = F.coalesce(*[F.when(way == d, r.last(f"_seq_{name}", F.when(mine & (way == d), F.col("tcp_seq")))) for name, d in (("fwd", 1), ("bwd", -1), ("none", 0))])
    again = r.column("_again", mine & F.coalesce(F.col("tcp_seq") <= before, F.lit(False)))
    sent, repeated, first = r.agg("_sent", F.count_if(mine)), r.agg("_repeated", F.count_if(again)), r.agg("_seq", F.max_by("tcp_seq", F.when(mine & (way == 1), F.col("pkt_no"))))
    reset = r.column("_reset_gap", F.when(has(RST), (F.col("ts_us") - r.last("_reset_ts", F.when(has(RST), F.col("ts_us")))) / 1e6))
    src, dst, sp, dp = (r.gathered(f"_last_{c}", F.max_by(c, "pkt_no")) for c in ("src_ip", "dst_ip", "src_port", "dst_port"))
    low = lambda c: r.agg(f"_low_{c}", F.avg(flag(F.col(c) < 1024)))
    r.out(
        avg_retransmission_rate=F.when(sent > 0, repeated / sent).otherwise(0.0), tcpseqfaultcnt=repeated, tcpseqsntbytes=r.agg("_sent_bytes", F.coalesce(F.sum(F.when(mine, F.col("payload_len"))), F.lit(0))), tcpiseqn=first, rst_trigger_interval=r.agg("_reset_mean", F.avg(reset)),
        ip_fragmentation_flag=r.agg("_fragment", F.max(flag(F.col("frag_offset") > 0))), well_known_src_port_ratio=low("src_port"), well_known_dst_port_ratio=low("dst_port"), tcppackcnt=r.agg("_ack", F.count_if(has(ACK))), tcppseqcnt=r.agg("_tcp", F.count_if(is_tcp())),
        tcpinitwinsz=r.agg("_window_mean", F.avg(F.when(is_tcp(), F.col("tcp_window")))), src_ip_is_private=flag(private_address(src)), dst_ip_is_private=flag(private_address(dst)), src_port_is_ephemeral=flag(sp.between(1024, 65535)), dst_port_is_ephemeral=flag(dp.between(1024, 65535)),
        is_common_service=flag((sp < 1024) | (dp < 1024)), quic_usage_flag=flag(dp == 443), src_port_range=port_range(sp), src_port_protocol=port_name(sp), dst_port_protocol=port_name(dp), unique_src_ports=flag(sp > 0), unique_dst_ports=flag(dp > 0),
        tcpackfaultcnt=F.lit(0), tcpbflgtmx=F.lit(0), tcpflwlssackrcvdbytes=F.lit(0),
    )


@feature_group
def payload_size(r: Recipe) -> None:
    size = F.when(has_bytes(), F.col("payload_len"))
    change = r.column("_size_change", F.abs(size - r.last("_size_before", size)))
    r.out(**RunningStats(r, "payload_size", size, True).columns(), **RunningStats(r, "payload_size_diff", change, True).columns())


def payload(r: Recipe, what: Column, kind: str) -> Column:
    """What is measured of payload bytes; null without reading any where the packets have none."""
    return what if "payload" in r.has else F.lit(None).cast(kind)


def histogram(r: Recipe) -> Column:
    """How often the flow's payloads have each byte."""
    b = r.value("_counts", payload(r, byte_counts("payload"), "array<long>"))
    if "payload" not in r.has:
        return F.lit(None).cast("array<long>")
    return r.after("_hist", F.array(*[r.agg(f"_h{k}", F.sum(F.get(b, F.lit(k)))) for k in range(256)]))


def added(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


@feature_group
def payload_content(r: Recipe) -> None:
    b = r.value("_counts", payload(r, byte_counts("payload"), "array<long>"))
    of = lambda name, lo, hi: r.agg(f"_{name}", F.sum(added(F.slice(b, lo + 1, hi - lo + 1))))
    size, letters = r.agg("_payload_bytes", F.sum("payload_len")), of("digits", 48, 57) + of("upper", 65, 90) + of("lower", 97, 122)
    r.out(payload_non_empty_ratio=r.agg("_non_empty", F.avg(flag(has_bytes()))), payload_printable_ratio=F.when(size > 0, of("printable", 32, 126) / size), payload_alnum_ratio=F.when(size > 0, letters / size))


@feature_group
def payload_hist(r: Recipe) -> None:
    """Bins, and statistics of all bytes: quantiles from their counts, third and fourth moments by the recurrence, of which each packet adds its terms."""
    h = histogram(r)
    n = r.after("_hist_n", added(h))
    power = lambda k: F.aggregate(F.transform(h, lambda x, i: x * F.pow(i.cast("double"), F.lit(float(k)))), F.lit(0.0), lambda a, x: a + x)
    mean = r.after("_hist_mean", F.when(n > 0, power(1) / n))
    v = r.after("_hist_v", F.when(n > 1, (power(2) - n * mean * mean) / (n - 1)).otherwise(0.0))

    def at(p: float) -> Column:  # counts are taken off the rank until none is left
        rank = F.floor(F.lit(p) * (n - 1))
        start = F.struct(rank.alias("left"), F.lit(0).cast("long").alias("byte"))
        step = lambda a, x: F.struct((a["left"] - x).alias("left"), (a["byte"] + F.when(a["left"] >= x, 1).otherwise(0)).alias("byte"))
        return F.when(n > 0, F.aggregate(h, start, lambda a, x: F.when(a["left"] < 0, a).otherwise(step(a, x)))["byte"].cast("double"))

    present = F.filter(F.transform(h, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    counts = F.col("_counts")
    sum_ = r.column("_byte_sum", F.aggregate(F.transform(counts, lambda x, i: x * i), F.lit(0).cast("long"), lambda a, x: a + x) if "payload" in r.has else F.lit(None).cast("long"))
    before, sum_before = r.so_far("_bytes_so_far", F.col("payload_len")) - F.col("payload_len"), r.so_far("_sum_so_far", sum_) - F.coalesce(sum_, F.lit(0))
    terms = r.column("_terms", payload(r, byte_terms("payload", before, sum_before), "struct<t3:double,t4:double>"), 1)
    t3, t4 = r.agg("_b3", F.sum(terms["t3"])), r.agg("_b4", F.sum(terms["t4"]))
    r.out(
        **{f"payload_hist_bin_{k}": F.when(n > 0, added(F.slice(h, 16 * k + 1, 16)) / n) for k in range(16)}, payload_byte_mean=mean, payload_byte_std=F.when(n > 1, F.sqrt(v)).when(n > 0, 0.0), payload_byte_min=F.array_min(present).cast("double"), payload_byte_max=F.array_max(present).cast("double"),
        payload_byte_q1=at(0.25), payload_byte_median=at(0.5), payload_byte_q3=at(0.75), payload_byte_skew=F.when(n > 0, F.when((n < 3) | (v <= 0), 0.0).otherwise(t3 / n / F.pow(v, F.lit(1.5)))), payload_byte_kurt=F.when(n > 0, F.when((n < 4) | (v <= 0), 0.0).otherwise(t4 / n / (v * v) - 3)),
    )


# What payloads begin with, in hexadecimal.
PREFIXES = {
    "http_get": "47455420", "http_post": "504F535420", "ssh": "5353482D", "jpeg": "FFD8", "png": "89504E47", "gif": "47494638",
}
TLS_VERSIONS = {"1_0": ("00", "01"), "1_1": ("02",), "1_2": ("03",), "1_3": ("04",)}


def magic_flags() -> dict[str, Column]:
    h = F.hex(F.substring("payload", 1, 6))
    long = F.col("payload_len") >= 4
    out = {name: long & h.startswith(p) for name, p in PREFIXES.items()}
    out["gif"] = long & (h.startswith("474946383761") | h.startswith("474946383961"))
    return out | {f"tls_{v}": long & h.startswith("1603") & F.substring(h, 5, 2).isin(*last) for v, last in TLS_VERSIONS.items()}


def looks_like() -> dict[str, Column]:
    h, n = F.hex("payload"), F.col("payload_len")
    first, last, second = F.substring(h, 1, 2), F.substring(h, -2, 2), F.substring(h, 3, 2)
    number = lambda x: F.conv(x, 16, 10).cast("int")
    http = F.lit(False)
    for verb in ("GET ", "POST ", "PUT ", "HEAD ", "HTTP"):
        http = http | h.startswith(verb.encode().hex().upper())
    return {
        "http": (n >= 4) & http, "json": (n >= 2) & first.isin("7B", "5B") & last.isin("7D", "5D"), "xml": (n >= 5) & (first == "3C"),
        "tls": (n >= 3) & first.isin("16", "17", "15") & (second == "03"), "ssh": (n >= 4) & (h.startswith("5353482D") | ((number(first) < 200) & (number(second) < 10))),
    }


def first_bytes(r: Recipe) -> Column:
    """The first HEAD payload bytes of a flow, of its first HEAD non-empty packets at most."""
    before, packets = r.so_far("_bytes_so_far", F.col("payload_len")) - F.col("payload_len"), r.so_far("_non_empty_so_far", flag(has_bytes()))
    part = r.column("_head", payload(r, F.when(has_bytes() & (packets <= HEAD) & (before < HEAD), F.hex(F.substring("payload", 1, HEAD))), "string"), 1)
    parts = r.gathered("_heads", F.collect_list(F.when(part.isNotNull(), F.struct("pkt_no", part.alias("h")))))
    text = F.substring(F.array_join(F.transform(F.sort_array(parts), lambda s: s.h), ""), 1, 2 * HEAD)
    return r.after("_first_bytes", F.when(F.size(parts) > 0, F.unhex(text)))


@feature_group
def payload_magic(r: Recipe) -> None:
    flags = {**{f"payload_magic_{k}": c for k, c in magic_flags().items()}, **{f"payload_looks_like_{k}": c for k, c in looks_like().items()}}
    found = {k: r.agg(f"_{k}", F.max(payload(r, F.when(has_bytes(), flag(c)), "int"))) for k, c in flags.items()}
    known = F.greatest(*[found[f"payload_magic_{k}"] for k in magic_flags()])
    h = histogram(r)
    bins = [added(F.slice(h, 16 * k + 1, 16)) for k in range(16)]
    expected = r.after("_expected", F.nullif(added(h), F.lit(0)) / 16)
    chi = sum(((b - expected) * (b - expected) / expected for b in bins[1:]), (bins[0] - expected) * (bins[0] - expected) / expected)
    r.out(**found, payload_magic_unknown=flag(known == 0), payload_chi_square=chi, payload_first_64_entropy=byte_entropy(F.substring(first_bytes(r), 1, 64)))


@feature_group
def payload_stats(r: Recipe) -> None:
    n = F.when(has_bytes(), F.col("payload_len"))
    for m in (2, 4, 8, 16, 32, 64, 128, 256):
        mean, sd = r.moments(f"mod_{m}", n % m)
        r.out(**{f"payload_length_mod_{m}_mean": mean, f"payload_length_mod_{m}_std": F.when(mean.isNotNull(), F.coalesce(sd, F.lit(0.0)))})
    order = r.value("_order", payload(r, byte_order("payload"), "struct<entropy:double,markov:double,autocorr:double>"))
    share = r.value("_zlib", payload(r, compressed_share("payload"), "double"))
    entropy, auto, head = r.agg("_entropy", F.avg(order["entropy"])), r.agg("_auto", F.avg(order["autocorr"])), first_bytes(r)
    r.out(
        payload_entropy=entropy, payload_markov_entropy=r.agg("_markov", F.avg(order["markov"])), payload_compression_ratio=r.agg("_zlib_mean", F.avg(share)), payload_autocorrelation_lag1=F.when(F.col("_mod_2_avg").isNotNull(), F.coalesce(auto, F.lit(0.0))),
        payload_first_128_entropy=byte_entropy(F.substring(head, 1, HEAD // 2)), payload_first_256_entropy=byte_entropy(head),
    )
