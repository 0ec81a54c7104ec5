"""Raw packets: a capture's columns become those that the feature groups read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packets import micros

# Links whose raw length begins at layer 2; bytes of a word of header lengths and of a UDP header.
LAYER_2 = ("mac", "vlan", "mac_in_mac")
WORD, UDP_HEADER = 4, 8
TCP, UDP = 0, 1
#: Packets of a flow within so many µs are numbered together.
SPAN_US = 60_000_000


def numbered(df: DataFrame, *order: str, span_us: int = SPAN_US) -> DataFrame:
    """df with pkt_no: a packet's place in its flow, by ts_us, then order. A long flow is numbered by spans of time, whose counts are summed up first."""
    rows = df.withColumn("_span", F.floor(F.col("ts_us") / span_us))
    within = F.row_number().over(Window.partitionBy("flow_id", "_span").orderBy("ts_us", *order))
    earlier = Window.partitionBy("flow_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("flow_id", "_span").agg(F.count(F.lit(1)).alias("_n")).select("flow_id", "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.withColumn("_within", within).join(spans, ["flow_id", "_span"]).withColumn("pkt_no", (F.col("_before") + F.col("_within")).cast("int")).drop("_span", "_within", "_before")


def derived(raw: DataFrame, clock: str = "packet") -> DataFrame:
    """Packets of a capture with lengths, direction sign and time; other columns stay.

    raw has flow_id, proto (0 TCP, 1 UDP), way (1 forward, 2 backward, other neither), payload_len, ip_words and tcp_words (header lengths in words of four
    bytes; null without an IP header), raw_len and link (null where unknown), ts (of the packet). Lengths: what stands before layer 3 is the raw length less
    the rest, for links that begin at layer 2 and if it is not negative; a TCP packet without an IP header is its payload.
    clock: "packet" takes the packet's time, "arrival" that of the platform, in whole milliseconds: arrived_ms, if there, else now. Packets without a
    flow_id are left out.
    """
    if clock not in ("packet", "arrival"):
        raise ValueError("clock is packet or arrival")
    arrived = F.col("arrived_ms") if "arrived_ms" in raw.columns else F.unix_millis(F.current_timestamp())
    tcp, has_ip = F.col("proto") == TCP, F.col("ip_words").isNotNull()
    payload = F.coalesce(F.col("payload_len"), F.lit(0)).cast("long")
    l3 = F.coalesce(F.col("ip_words") * WORD, F.lit(0)).cast("int")
    l4 = F.when(tcp, F.when(has_ip, F.coalesce(F.col("tcp_words") * WORD, F.lit(0))).otherwise(0)).when(F.col("proto") == UDP, UDP_HEADER).otherwise(0).cast("int")
    rest = F.col("raw_len") - (F.col("l3_len") + F.col("l4_len") + F.col("payload_len"))
    rows = raw.where("flow_id IS NOT NULL").withColumns({
        "ts_us": micros("ts") if clock == "packet" else arrived * 1000, "direction": F.when(F.col("way") == 1, 1).when(F.col("way") == 2, -1).otherwise(0), "payload_len": payload, "l3_len": l3, "l4_len": l4,
    })
    rows = rows.withColumn("l2_len", F.when(F.col("link").isin(*LAYER_2) & (rest >= 0), rest).otherwise(0).cast("int"))
    return rows.withColumn("pkt_len", F.col("payload_len") + F.col("l2_len") + F.col("l3_len") + F.col("l4_len")).drop("way", "raw_len", "link", "ip_words", "tcp_words", "ts", "arrived_ms")


def read(spark: SparkSession, path: str, *order: str, clock: str = "packet") -> DataFrame:
    """Numbered packets of a capture in Parquet; only the columns that a group asks for are read."""
    return numbered(derived(spark.read.parquet(path), clock), *order)


def opens() -> Column:
    """Whether a packet opens its flow: SYN for TCP, any packet else."""
    return (F.col("proto") != TCP) | (F.col("tcp_flags").bitwiseAND(2) > 0)


def opened(pk: DataFrame) -> DataFrame:
    """Packets from the one on that opens their flow, numbered anew; what came before, and flows that never open, are left out."""
    first = pk.groupBy("flow_id").agg(F.min(F.when(opens(), F.col("pkt_no"))).alias("_first")).where("_first IS NOT NULL")
    return pk.join(first, "flow_id").where("pkt_no >= _first").withColumn("pkt_no", F.col("pkt_no") - F.col("_first") + 1).drop("_first")
