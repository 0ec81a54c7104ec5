"""The same results in DuckDB SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

EVENTS = """pk AS (SELECT user_id AS flow_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pkt_no, epoch_us(ts) AS ts_us,
 CASE WHEN event_type IN ('click','signup','purchase') THEN 1 ELSE -1 END AS direction, CAST(floor(value*4) AS BIGINT) AS payload_len, CAST(floor(value*4) AS BIGINT)+40 AS pkt_len FROM events)"""
LINES = """raw AS (SELECT *, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT)*1000 END AS tcp_window FROM lineitem), pk AS (
 SELECT l_orderkey AS flow_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, tcp_window) AS pkt_no, epoch_us(l_shipdate)+l_linenumber AS ts_us,
 CASE WHEN l_linestatus='O' THEN 1 ELSE -1 END AS direction, CASE WHEN l_linenumber%3=0 THEN 0 ELSE CAST(l_quantity AS BIGINT)*30 END AS payload_len, tcp_window, l_partkey AS tcp_seq, l_suppkey % 8 AS tos,
 CASE l_linenumber%4 WHEN 0 THEN 32 WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 255 END AS ttl,
 CASE l_returnflag WHEN 'R' THEN 20 WHEN 'A' THEN 16 ELSE 2 + CASE WHEN l_linestatus='F' THEN 16 ELSE 0 END END AS f,
 l_partkey % 60000 + 1 AS src_port, CASE l_suppkey%5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53 ELSE 8080 END AS dst_port, l_suppkey % 64 AS dst_octet, payload_len + 40 AS pkt_len FROM raw)"""
TALKS = """pk AS (SELECT conv_id AS flow_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pkt_no, turn*1000000 AS ts_us,
 CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END AS direction, hex(encode(text)) AS h, octet_length(encode(text)) AS payload_len, octet_length(encode(text))+40 AS pkt_len FROM conversations)"""
GAPS = "g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS iat FROM pk)"
HOUR6, DAY = 21_600_000_000, 86_400_000_000


def r(x: str, d: int = 4) -> str:
    return f"(round({x}, {d}) + 0.0)"


def quantile(p: float, integer: bool) -> str:
    i = f"(CAST({p} AS DOUBLE)/100*(n-1))"
    v = f"(l[CAST(floor({i}) AS BIGINT)+1]*(1-({i}-floor({i}))) + l[CAST(least(floor({i})+1, n-1) AS BIGINT)+1]*({i}-floor({i})))"
    return f"floor({v})" if integer else v


def nine(src: str, x: str, p: str, integer: bool, d: int = 4, running: bool = False) -> str:
    """A chain of tables that ends in {p}_s: the nine statistics of x over rows of src."""
    m = "floor((l[(n-1)//2+1]+l[n//2+1])/2)" if integer else "(l[(n-1)//2+1]+l[n//2+1])/2"
    w = "OVER (PARTITION BY flow_id ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    if running:
        terms = f"""{p}_u AS (SELECT flow_id, pkt_no, CAST({x} AS DOUBLE) AS x FROM {src} WHERE ({x}) IS NOT NULL),
 {p}_w AS (SELECT flow_id, x, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY pkt_no) AS DOUBLE) AS k, x - coalesce(avg(x) {w.format('1 PRECEDING')}, 0) AS a, x - avg(x) {w.format('CURRENT ROW')} AS b FROM {p}_u),
 {p}_v AS (SELECT flow_id, x, a*b*b*(1-CAST(3 AS DOUBLE)/k) AS t3, a*pow(b,3) - 4*a*a*b*b/k + 6*pow(b,3)/(k*k) AS t4 FROM {p}_w)"""
        sums, s3, s4 = "sum(t3) AS m3, sum(t4) AS m4, var_samp(x) AS v", "m3/n/pow(v,1.5)", "m4/n/pow(v,2)-3"
    else:
        terms = f"{p}_v AS (SELECT flow_id, CAST({x} AS DOUBLE) AS x, avg(CAST({x} AS DOUBLE)) OVER (PARTITION BY flow_id) AS c FROM {src} WHERE ({x}) IS NOT NULL)"
        sums, s3, s4 = "avg(pow(x-c,3)) AS m3, avg(pow(x-c,4)) AS m4, var_samp(x) AS v", "m3/pow(v,1.5)", "m4/pow(v,2)-3"
    return f"""{terms}, {p}_a AS (SELECT flow_id, count(*) AS n, avg(x) AS mean, coalesce(stddev_samp(x),0) AS sd, min(x) AS lo, max(x) AS hi, list_sort(list(x)) AS l, {sums} FROM {p}_v GROUP BY flow_id),
 {p}_s AS (SELECT flow_id, n AS {p}_n, mean AS {p}_raw, sd AS {p}_sd, {r('mean', d)} AS {p}_mean, {r('sd', d)} AS {p}_std, {r('lo', d)} AS {p}_min, {r('hi', d)} AS {p}_max, {r(m, d)} AS {p}_median, {r(quantile(25, integer), d)} AS {p}_q1, {r(quantile(75, integer), d)} AS {p}_q3,
 CASE WHEN n<3 OR v=0 THEN 0 ELSE {r(s3, d)} END AS {p}_skew, CASE WHEN n<4 OR v=0 THEN 0 ELSE {r(s4, d)} END AS {p}_kurt FROM {p}_a)"""


STATS = ("mean", "std", "min", "max", "median", "q1", "q3", "skew", "kurt")


def cols(*prefixes: str, zero: bool = False) -> str:
    return ", ".join(f"coalesce({p}_{s}, 0) AS {p}_{s}" if zero else f"{p}_{s}" for p in prefixes for s in STATS)


def query(*tables: str, select: str, of: str = "", joins: tuple = ()) -> str:
    """All flows of pk with the columns of the joined tables."""
    return f"WITH {', '.join(tables)} SELECT flow_id, {select} FROM (SELECT DISTINCT flow_id FROM pk) {' '.join(f'LEFT JOIN {j} USING (flow_id)' for j in joins)}"


def autocorr(src: str, x: str, name: str, least: str) -> str:
    lags = range(1, 6)
    return f"""d AS (SELECT flow_id, pkt_no, CAST({x} AS DOUBLE) - avg(CAST({x} AS DOUBLE)) OVER (PARTITION BY flow_id) AS e FROM {src} WHERE {x} IS NOT NULL),
 dd AS (SELECT *, {', '.join(f'lead(e,{k}) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS e{k}' for k in lags)} FROM d),
 ac AS (SELECT flow_id, {', '.join(f"CASE WHEN count(*) > {least.format(k=k)} AND sum(e*e) FILTER (WHERE e{k} IS NOT NULL) > 0 THEN {r(f'sum(e*e{k})/sum(e*e) FILTER (WHERE e{k} IS NOT NULL)')} ELSE 0 END AS {name}_{k}" for k in lags)} FROM dd GROUP BY flow_id)"""


def entropy(src: str, v: str, name: str) -> str:
    return f"ec AS (SELECT flow_id, {v} AS v, CAST(count(*) AS DOUBLE) AS c FROM {src} WHERE ({v}) IS NOT NULL GROUP BY ALL), es AS (SELECT flow_id, c, sum(c) OVER (PARTITION BY flow_id) AS t FROM ec), en AS (SELECT flow_id, {r('-sum(c/t*log2(c/t))')} AS {name} FROM es GROUP BY flow_id)"


WINDOWS = f"wf AS (SELECT *, min(ts_us) OVER (PARTITION BY flow_id) AS t0 FROM pk), w AS (SELECT flow_id, (ts_us-t0)//{DAY} AS w, (ts_us-t0)//{DAY} AS pkt_no, count(*) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes FROM wf WHERE (ts_us-t0)//{DAY} < 100 GROUP BY ALL)"
BYTES = "b AS (SELECT flow_id, pkt_no, unnest(range(1, payload_len+1)) AS i, payload_len, CAST('0x' || substr(h, 2*unnest(range(1, payload_len+1))-1, 2) AS INTEGER) AS v FROM pk WHERE payload_len > 0)"


def spectrum(prefix: str, where: str, psd: bool) -> str:
    p = f"{prefix}_fft_magnitude"
    mags = ", ".join(f"{r(f'CASE WHEN half = 1 THEN 0 WHEN len(t) > {k} THEN t[{k + 1}] ELSE -1 END', 3)} AS {prefix}_fft_mag_{k}" for k in range(5))
    idx = ", ".join(f"CAST(CASE WHEN half = 1 THEN 0 WHEN len(ti) > {k} THEN ti[{k + 1}] ELSE -1 END AS BIGINT) AS {prefix}_fft_freq_{k}_idx" for k in range(5))
    return query(
        EVENTS, f"x AS (SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY pkt_no)-1 AS t, CAST(pkt_len AS DOUBLE) AS v FROM pk WHERE {where})",
        "n AS (SELECT flow_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM x GROUP BY flow_id HAVING count(*) >= 2)", "k AS (SELECT flow_id, size, size//2 AS half, unnest(range(0, size//2)) AS k FROM n)",
        "m AS (SELECT k.flow_id, half, k, sqrt(pow(sum(v*cos(2*pi()*((k*t)%size)/size)),2)+pow(sum(v*sin(2*pi()*((k*t)%size)/size)),2)) AS mag FROM k JOIN x ON k.flow_id=x.flow_id GROUP BY ALL)",
        "c AS (SELECT *, avg(mag) OVER (PARTITION BY flow_id) AS mu FROM m)",
        "a AS (SELECT flow_id, half, avg(mag) AS mean, coalesce(stddev_samp(mag),0) AS sd, min(mag) AS lo, max(mag) AS hi, list_sort(list(mag)) AS l, avg(pow(mag-mu,3)) AS m3, avg(pow(mag-mu,4)) AS m4, list(mag ORDER BY mag DESC, k) FILTER (WHERE k>0) AS t, list(k ORDER BY mag DESC, k) FILTER (WHERE k>0) AS ti FROM c GROUP BY ALL)",
        f"s AS (SELECT flow_id, {idx}, {mags}, {r('mean',3)} AS {p}_mean, {r('sd',3)} AS {p}_std, {r('lo',3)} AS {p}_min, {r('hi',3)} AS {p}_max, {r('l[half//2+1]',3)} AS {p}_median, {r('l[half//4+1]',3)} AS {p}_q1, {r('l[3*half//4+1]',3)} AS {p}_q3, CASE WHEN sd > 1e-9*greatest(1,mean) THEN {r('m3/pow(sd,3)',3)} ELSE 0 END AS {p}_skew, CASE WHEN sd > 1e-9*greatest(1,mean) THEN {r('m4/pow(sd,4)-3',3)} ELSE 0 END AS {p}_kurt{', CASE WHEN half = 1 THEN 0 ELSE ' + r('t[1]*t[1]', 3) + ' END AS psd_peak' if psd else ''} FROM a)",
        select="* EXCLUDE (flow_id)", joins=("s",),
    )


def _flags() -> str:
    has = lambda b: f"f & {b} = {b}"
    n = lambda c, a: f"count(*) FILTER (WHERE {c}) AS {a}"
    zero = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("icmp_packet_count", "header_anomaly_count", "tcp_header_anomaly_count"))
    counts = ", ".join([n(has(2), "tcp_syn_count"), n(has(1), "tcp_fin_count"), n(has(4), "tcp_rst_count"), n(has(16), "tcp_ack_count"), n(has(8), "tcp_psh_count"), n(has(32), "tcp_urg_count"), n(has(2), "tcp_syn_packets"), n(has(18), "tcp_syn_ack_packets"), n("f = 16 AND payload_len = 0", "tcp_ack_only_count"), n("payload_len > 0", "tcp_payload_packets"), n("tcp_window = 0", "tcp_zero_window_count"), n("f & 16 = 16 AND payload_len = 0 AND w0 <> tcp_window", "window_update_frequency"), "count(*) AS l2_packets_count"])
    share = lambda c, a: f"{r(f'count(*) FILTER (WHERE {c})/count(*)')} AS {a}"
    return f"""WITH {LINES}, w AS (SELECT *, lag(tcp_window) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS w0 FROM pk) SELECT flow_id, {counts}, {zero}, CAST(0 AS DOUBLE) AS header_anomaly_ratio,
 {r(f"count(*) FILTER (WHERE {has(18)})/nullif(count(*) FILTER (WHERE {has(2)}),0)")} AS tcp_connection_success_rate, {share(has(2), 'tcp_syn_ratio')}, {share(has(4), 'tcp_rst_ratio')}, {share('f = 16 AND payload_len = 0', 'tcp_ack_only_ratio')}, {share('payload_len > 0', 'tcp_payload_packet_ratio')}, {share('f & 18 = 2', 'tcp_syn_only_ratio')},
 coalesce({r(f"(count(*) FILTER (WHERE {has(2)}) - count(*) FILTER (WHERE {has(18)}))/nullif(count(*) FILTER (WHERE {has(2)}),0)")}, 0) AS tcp_half_open_ratio FROM w GROUP BY flow_id"""


CAPTURE = """raw AS (SELECT user_id AS flow_id, event_id, epoch_us(ts) AS ts_us, event_id % 3 = 0 AS udp, CASE WHEN event_type IN ('click','signup','purchase') THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END AS direction, CAST(floor(value*4) AS BIGINT) AS payload_len,
 CASE WHEN event_id % 7 <> 0 THEN (5 + event_id % 3)*4 END AS ip, (5 + event_id % 4)*4 AS tcp, CAST(floor(value*4) AS BIGINT) + 30 + event_id % 50 AS raw_len, event_id % 4 <> 2 AS layer2 FROM events),
 lens AS (SELECT *, coalesce(ip, 0) AS l3_len, CASE WHEN udp THEN 8 WHEN ip IS NULL THEN 0 ELSE tcp END AS l4_len FROM raw), pk AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ts_us, event_id) AS pkt_no,
 CASE WHEN layer2 THEN greatest(raw_len - l3_len - l4_len - payload_len, 0) ELSE 0 END AS l2_len, payload_len + l3_len + l4_len + CASE WHEN layer2 THEN greatest(raw_len - l3_len - l4_len - payload_len, 0) ELSE 0 END AS pkt_len FROM lens)"""


def _magic() -> str:
    starts = lambda *p: "len(s) >= 8 AND (" + " OR ".join(f"starts_with(s,'{x}')" for x in p) + ")"
    flags = {f"payload_magic_{k}": starts(*p) for k, p in {"http_get": ("47455420",), "http_post": ("504F535420",), "ssh": ("5353482D",), "jpeg": ("FFD8",), "png": ("89504E47",), "gif": ("474946383761", "474946383961")}.items()}
    flags |= {f"payload_magic_tls_{k}": f"len(s) >= 8 AND starts_with(s,'1603') AND substr(s,5,2) IN ({v})" for k, v in {"1_0": "'00','01'", "1_1": "'02'", "1_2": "'03'", "1_3": "'04'"}.items()}
    magic = list(flags)
    byte = lambda k: f"CAST('0x' || substr(s,{k},2) AS INTEGER)"
    flags["payload_looks_like_http"] = starts("47455420", "504F535420", "50555420", "4845414420", "48545450")
    flags["payload_looks_like_json"] = "len(s) >= 4 AND substr(s,1,2) IN ('7B','5B') AND right(s,2) IN ('7D','5D')"
    flags["payload_looks_like_xml"] = "len(s) >= 10 AND starts_with(s,'3C')"
    flags["payload_looks_like_tls"] = "len(s) >= 6 AND substr(s,1,2) IN ('16','17','15') AND substr(s,3,2) = '03'"
    flags["payload_looks_like_ssh"] = f"len(s) >= 8 AND (starts_with(s,'5353482D') OR ({byte(1)} < 200 AND {byte(3)} < 10))"
    found = ", ".join(f"max(CAST({c} AS BIGINT)) AS {k}" for k, c in flags.items())
    return f"""WITH pk AS (SELECT page_id AS flow_id, hex(encode(coalesce(html,''))) AS h FROM pages), seg AS (SELECT flow_id, substr(h, unnest(range(1, len(h)+1, 2920)), 2920) AS s FROM pk),
 m AS (SELECT flow_id, {found} FROM seg WHERE s <> '' GROUP BY flow_id), b AS (SELECT flow_id, unnest(range(1, len(h), 2)) AS i, CAST('0x' || substr(h, unnest(range(1, len(h), 2)), 2) AS INTEGER) AS v FROM pk),
 bins AS (SELECT flow_id, v//16 AS bin, CAST(count(*) AS DOUBLE) AS c FROM b GROUP BY ALL), t AS (SELECT flow_id, sum(c)/16 AS e, count(*) AS present FROM bins GROUP BY flow_id),
 chi AS (SELECT flow_id, {r('sum((c-e)*(c-e)/e) + (16-min(present))*min(e)', 3)} AS payload_chi_square FROM bins JOIN t USING (flow_id) GROUP BY flow_id),
 f64 AS (SELECT flow_id, v, CAST(count(*) AS DOUBLE) AS c FROM b WHERE i <= 127 GROUP BY ALL), n64 AS (SELECT flow_id, sum(c) AS n FROM f64 GROUP BY flow_id), h64 AS (SELECT flow_id, {r('-sum(c/n*log2(c/n))', 3)} AS payload_first_64_entropy FROM f64 JOIN n64 USING (flow_id) GROUP BY flow_id)
 SELECT DISTINCT pk.flow_id, m.* EXCLUDE (flow_id), CAST(greatest({', '.join(magic)}) = 0 AS BIGINT) AS payload_magic_unknown, payload_chi_square, payload_first_64_entropy FROM pk LEFT JOIN m USING (flow_id) LEFT JOIN chi USING (flow_id) LEFT JOIN h64 USING (flow_id)"""


PORT_CASE = "CASE {} WHEN 20 THEN 'FTP-DATA' WHEN 21 THEN 'FTP' WHEN 22 THEN 'SSH' WHEN 23 THEN 'TELNET' WHEN 25 THEN 'SMTP' WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP' WHEN 110 THEN 'POP3' WHEN 143 THEN 'IMAP' WHEN 443 THEN 'HTTPS' WHEN 465 THEN 'SMTPS' WHEN 587 THEN 'SUBMISSION' WHEN 993 THEN 'IMAPS' WHEN 995 THEN 'POP3S' WHEN 3306 THEN 'MYSQL' WHEN 3389 THEN 'RDP' WHEN 5432 THEN 'POSTGRESQL' WHEN 6379 THEN 'REDIS' WHEN 8080 THEN 'HTTP-ALT' WHEN 8443 THEN 'HTTPS-ALT' ELSE 'UNKNOWN' END"


def oracle_sql() -> dict[str, str]:
    c = "FROM pk GROUP BY flow_id"
    fw, bw = "FILTER (WHERE direction = 1)", "FILTER (WHERE direction = -1)"
    dur = "((max(ts_us)-min(ts_us))/1000000)"
    iat = (EVENTS, GAPS)
    way = "gw AS (SELECT flow_id, pkt_no, direction, ts_us - lag(ts_us) OVER (PARTITION BY flow_id, direction ORDER BY pkt_no) AS gap FROM pk WHERE pkt_no > 1)"
    resp = "rs AS (SELECT flow_id, pkt_no, CASE WHEN direction = -1 AND lag(direction) OVER o = 1 THEN (ts_us - lag(ts_us) OVER o)/1000 END AS delay FROM pk WINDOW o AS (PARTITION BY flow_id ORDER BY pkt_no))"
    cv = lambda p, d=2: f"CASE WHEN {p}_n > 0 THEN CASE WHEN {p}_raw = 0 THEN 0 ELSE {r(f'{p}_sd/{p}_raw', d)} END END AS {p}_cv"
    payload = []
    for w, f in (("fwd", 1), ("bwd", -1)):
        payload.append(f"CAST({w}_total AS BIGINT) AS {w}_total_payload, CASE WHEN {w}_all > 0 THEN {r(f'{w}_total/{w}_all')} END AS {w}_payload_mean, " + ", ".join(f"CASE WHEN {w}_all > 0 THEN coalesce({w}_payload_{s}, 0) END AS {w}_payload_{s}" for s in ("std", "min", "max")) + ", " + ", ".join(f"{w}_payload_{s}" for s in ("median", "q1", "q3", "skew", "kurt")))
    bigram = []
    for k in range(5):
        bigram += [f"CAST(CASE WHEN l[{k + 1}][2] = {j} THEN -l[{k + 1}][1] ELSE 0 END AS BIGINT) AS top_{k + 1}_bigram_{a}_freq" for j, a in enumerate(x + y for x in "sml" for y in "sml")]
    sql = {
        "flow_counters": f"WITH {EVENTS} SELECT flow_id, count(*) AS total_packets, count(*) {fw} AS fwd_packets, count(*) {bw} AS bwd_packets, CAST(sum(pkt_len) AS BIGINT) AS total_bytes, CAST(coalesce(sum(pkt_len) {fw},0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(pkt_len) {bw},0) AS BIGINT) AS bwd_bytes, min(ts_us) AS createtime, CAST(0 AS BIGINT) AS trans_proto, CAST(arg_max(direction, pkt_no) AS BIGINT) AS stream_dir {c}",
        "basic_ratios": f"WITH {EVENTS} SELECT flow_id, {r(f'count(*) {fw}/nullif(count(*) {bw},0)')} AS fwd_bwd_packet_ratio, {r(f'coalesce(sum(pkt_len) {fw},0)/nullif(sum(pkt_len) {bw},0)')} AS fwd_bwd_byte_ratio, {r('avg(pkt_len)')} AS avg_packet_length, coalesce({r(f'avg(pkt_len) {fw}')},0) AS fwd_avg_packet_length, coalesce({r(f'avg(pkt_len) {bw}')},0) AS bwd_avg_packet_length {c}",
        "payload_dir": query(LINES, nine("pk", "CASE WHEN direction=1 AND payload_len>0 THEN payload_len END", "fwd_payload", True), nine("pk", "CASE WHEN direction=-1 AND payload_len>0 THEN payload_len END", "bwd_payload", True), f"t AS (SELECT flow_id, coalesce(sum(payload_len) {fw},0) AS fwd_total, count(*) {fw} AS fwd_all, coalesce(sum(payload_len) {bw},0) AS bwd_total, count(*) {bw} AS bwd_all {c})", select=", ".join(payload), joins=("t", "fwd_payload_s", "bwd_payload_s")),
        "first_n": query(EVENTS, "f AS (SELECT * FROM pk WHERE pkt_no <= 10)", nine("f", "pkt_len", "first_n_packets_length", True), select=cols("first_n_packets_length"), joins=("first_n_packets_length_s",)),
        "pkt_length_dir": query(EVENTS, nine("pk", "CASE WHEN direction=1 THEN pkt_len END", "fwd_packet_length", True), nine("pk", "CASE WHEN direction=-1 THEN pkt_len END", "bwd_packet_length", True), f"t AS (SELECT flow_id, {r('avg(CAST(pkt_len<=64 AS INT))')} AS small_packet_ratio, {r('avg(CAST(pkt_len>=1200 AS INT))')} AS large_packet_ratio {c})", select=f"small_packet_ratio, large_packet_ratio, {cols('fwd_packet_length', 'bwd_packet_length')}, {cv('fwd_packet_length', 4)}, {cv('bwd_packet_length', 4)}", joins=("t", "fwd_packet_length_s", "bwd_packet_length_s")),
        "iat_stats": query(*iat, nine("g", "iat", "iat", False, 2), select="coalesce(iat_mean,0) AS iat_mean, coalesce(iat_std,0) AS iat_std, iat_min, iat_max, coalesce(iat_median,0) AS iat_median, coalesce(iat_q1,0) AS iat_q1, coalesce(iat_q3,0) AS iat_q3, coalesce(" + r("iat_sd/nullif(iat_raw,0)", 2) + ",0) AS interval_coefficient_of_variation", joins=("iat_s",)),
        "iat_sequence": query(*iat, nine("g", "iat", "iat_sequence", False, 2), select=cols("iat_sequence", zero=True), joins=("iat_sequence_s",)),
        "iat_running_moments": query(*iat, nine("g", "iat", "iat", False, 4, True), select="coalesce(iat_skew,0) AS iat_skew, coalesce(iat_kurt,0) AS iat_kurt", joins=("iat_s",)),
        "iat_entropy": query(*iat, "lh AS (SELECT flow_id, iat, min(iat) OVER (PARTITION BY flow_id) AS lo, max(iat) OVER (PARTITION BY flow_id) AS hi FROM g)", entropy("lh", "CASE WHEN hi > lo THEN floor((iat-lo)/(hi-lo)*31) WHEN iat IS NOT NULL THEN 0 END", "iat_entropy"), select="coalesce(iat_entropy,0) AS iat_entropy", joins=("en",)),
        "iat_autocorr": query(*iat, autocorr("g", "iat", "iat_autocorr_lag", "{k}"), select=", ".join(f"coalesce(iat_autocorr_lag_{k},0) AS iat_autocorr_lag_{k}" for k in range(1, 6)), joins=("ac",)),
        "interval_ratio": query(*iat, "q AS (SELECT flow_id, iat, lag(iat) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS p FROM g)", f"s AS (SELECT flow_id, {r('avg(iat/p) FILTER (WHERE p > 0)', 3)} AS x FROM q GROUP BY flow_id)", select="coalesce(x,0) AS interval_ratio_mean", joins=("s",)),
        "log_iat": query(*iat, nine("g", "ln(1+iat)", "log_iat_sequence", False), select=cols("log_iat_sequence", zero=True), joins=("log_iat_sequence_s",)),
        "iat_fwd_bwd": query(EVENTS, way, nine("gw", "CASE WHEN direction=1 THEN gap END", "fwd_iat", False, 2, True), nine("gw", "CASE WHEN direction=-1 THEN gap END", "bwd_iat", False, 2, True), select=f"{cols('fwd_iat', 'bwd_iat')}, {cv('fwd_iat')}, {cv('bwd_iat')}", joins=("fwd_iat_s", "bwd_iat_s")),
        "active_idle": f"WITH {EVENTS}, {GAPS}, s AS (SELECT flow_id, coalesce(sum(iat) FILTER (WHERE iat <= {HOUR6}),0)/1000000 AS a, coalesce(sum(iat) FILTER (WHERE iat > {HOUR6}),0)/1000000 AS i FROM g GROUP BY flow_id) SELECT flow_id, {r('a')} AS active_time, {r('i')} AS idle_time, CASE WHEN a+i > 0 THEN {r('a/(a+i)')} END AS active_time_ratio FROM s",
        "response_delay": query(EVENTS, resp, nine("rs", "delay", "response_delay", False, 3), select=f"{cols('response_delay')}, CAST(response_delay_raw < 100 AS BIGINT) AS is_interactive_session", joins=("response_delay_s",)),
        "burst": query(*iat, f"bi AS (SELECT *, sum(CAST(coalesce(iat,0) > {HOUR6} AS INT)) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS b FROM g)", "bg AS (SELECT flow_id, b, sum(pkt_len) AS size, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1 FROM bi GROUP BY ALL)", "bn AS (SELECT *, lead(t0) OVER (PARTITION BY flow_id ORDER BY b) AS t2 FROM bg)", "bc AS (SELECT *, t2-t0 AS dur, CASE WHEN row_number() OVER (PARTITION BY flow_id ORDER BY b) > 1 THEN t2-t1 END AS gap FROM bn WHERE t2 IS NOT NULL AND n >= 2)", f"s AS (SELECT flow_id, count(*) AS burst_count, {r('avg(size)', 3)} AS avg_burst_size, {r('coalesce(stddev_samp(size),0)', 3)} AS burst_size_std, {r('avg(dur)/1000000', 3)} AS avg_burst_duration, {r('avg(n)', 3)} AS burst_packet_count_mean, {r('max(n*1000000/dur) FILTER (WHERE dur>0)', 3)} AS burst_packet_rate_peak, {r('avg(gap)/1000000', 3)} AS burst_interval_mean, CASE WHEN count(gap)<1 THEN 0 WHEN count(gap)>1 THEN {r('stddev_samp(gap)/avg(gap)', 3)} END AS burstiness_index FROM bc GROUP BY flow_id)", select="* EXCLUDE (flow_id, burst_count), coalesce(burst_count,0) AS burst_count", joins=("s",)),
        "tcp_flags": _flags(),
        "tcp_window": query(LINES, nine("pk", "tcp_window", "tcp_window", True, 3, True), select=cols("tcp_window"), joins=("tcp_window_s",)),
        "ip_ttl_tos": query(LINES, nine("pk", "ttl", "ip_ttl", True, 4, True), nine("pk", "tos", "ip_tos", True, 4, True), f"t AS (SELECT flow_id, {', '.join(f'count(*) FILTER (WHERE ttl={v}) AS ip_ttl_eq_{v}_count' for v in (32, 64, 128, 255))} {c})", select=f"{cols('ip_ttl', 'ip_tos')}, ip_ttl_eq_32_count, ip_ttl_eq_64_count, ip_ttl_eq_128_count, ip_ttl_eq_255_count", joins=("ip_ttl_s", "ip_tos_s", "t")),
        "udp_length": query(TALKS, nine("pk", "payload_len+8", "udp_length", True, 4, True), select=cols("udp_length"), joins=("udp_length_s",)),
        "port_features": f"WITH {LINES}, a AS (SELECT flow_id, arg_max(src_port, pkt_no) AS sp, arg_max(dst_port, pkt_no) AS dp, arg_max(dst_octet, pkt_no) AS o, {r('avg(CAST(src_port<1024 AS INT))')} AS x, {r('avg(CAST(dst_port<1024 AS INT))')} AS y, count(*) FILTER (WHERE f & 16 = 16) AS acks, count(*) AS n, {r('avg(tcp_window)')} AS win {c}) SELECT flow_id, CAST(1 AS BIGINT) AS src_ip_is_private, CAST(o BETWEEN 16 AND 31 AS BIGINT) AS dst_ip_is_private, CAST(0 AS BIGINT) AS ip_fragmentation_flag, CAST(sp BETWEEN 1024 AND 65535 AS BIGINT) AS src_port_is_ephemeral, CAST(dp BETWEEN 1024 AND 65535 AS BIGINT) AS dst_port_is_ephemeral, CAST(sp<1024 OR dp<1024 AS BIGINT) AS is_common_service, CAST(dp=443 AS BIGINT) AS quic_usage_flag, CASE WHEN sp<1024 THEN 'well_known' WHEN sp<49152 THEN 'registered' ELSE 'dynamic' END AS src_port_range, {PORT_CASE.format('sp')} AS src_port_protocol, {PORT_CASE.format('dp')} AS dst_port_protocol, x AS well_known_src_port_ratio, y AS well_known_dst_port_ratio, CAST(sp>0 AS BIGINT) AS unique_src_ports, CAST(dp>0 AS BIGINT) AS unique_dst_ports, acks AS tcppackcnt, n AS tcppseqcnt, win AS tcpinitwinsz FROM a",
        "retransmission": query(LINES, "s AS (SELECT *, tcp_seq <= lag(tcp_seq) OVER (PARTITION BY flow_id, direction ORDER BY pkt_no) AS again FROM pk WHERE payload_len > 0)", f"t AS (SELECT flow_id, count(*) AS n, count(*) FILTER (WHERE again) AS k, sum(payload_len) AS b, arg_max(tcp_seq, pkt_no) {fw} AS q FROM s GROUP BY flow_id)", select=f"coalesce({r('k/n')},0) AS avg_retransmission_rate, coalesce(k,0) AS tcpseqfaultcnt, CAST(coalesce(b,0) AS BIGINT) AS tcpseqsntbytes, q AS tcpiseqn", joins=("t",)),
        "rst_interval": query(LINES, "s AS (SELECT flow_id, (ts_us - lag(ts_us) OVER (PARTITION BY flow_id ORDER BY pkt_no))/1000000 AS gap FROM pk WHERE f & 4 = 4)", f"t AS (SELECT flow_id, {r('avg(gap)', 3)} AS rst_trigger_interval FROM s GROUP BY flow_id)", select="rst_trigger_interval", joins=("t",)),
        "payload_size": query(LINES, nine("pk", "CASE WHEN payload_len>0 THEN payload_len END", "payload_size", True, 3, True), select=cols("payload_size"), joins=("payload_size_s",)),
        "payload_size_diff": query(LINES, "p AS (SELECT flow_id, pkt_no, abs(payload_len - lag(payload_len) OVER (PARTITION BY flow_id ORDER BY pkt_no)) AS x FROM pk WHERE payload_len>0)", nine("p", "x", "payload_size_diff", True, 3, True), select=cols("payload_size_diff"), joins=("payload_size_diff_s",)),
        "payload_mod": query(LINES, "t AS (SELECT flow_id, " + ", ".join(f"{r(f'avg(payload_len%{m})')} AS payload_length_mod_{m}_mean, {r(f'coalesce(stddev_samp(payload_len%{m}),0)')} AS payload_length_mod_{m}_std" for m in (2, 4, 8, 16, 32, 64, 128, 256)) + " FROM pk WHERE payload_len>0 GROUP BY flow_id)", select="* EXCLUDE (flow_id)", joins=("t",)),
        "payload_content": query(TALKS, BYTES, f"t AS (SELECT flow_id, {r('avg(CAST(payload_len>0 AS INT))')} AS payload_non_empty_ratio {c})", f"s AS (SELECT flow_id, {r('avg(CAST(v BETWEEN 32 AND 126 AS INT))')} AS payload_printable_ratio, {r('avg(CAST(v BETWEEN 48 AND 57 OR v BETWEEN 65 AND 90 OR v BETWEEN 97 AND 122 AS INT))')} AS payload_alnum_ratio FROM b GROUP BY flow_id)", select="* EXCLUDE (flow_id)", joins=("t", "s")),
        "payload_hist": query(TALKS, BYTES, "s AS (SELECT flow_id, " + ", ".join(f"{r(f'avg(CAST(v//16={k} AS INT))')} AS payload_hist_bin_{k}" for k in range(16)) + " FROM b GROUP BY flow_id)", select="* EXCLUDE (flow_id)", joins=("s",)),
        "payload_byte_stats": query(TALKS, BYTES, "bo AS (SELECT flow_id, v, row_number() OVER (PARTITION BY flow_id ORDER BY pkt_no, i) AS pkt_no FROM b)", nine("bo", "v", "payload_byte", False, 4, True), "q AS (SELECT flow_id, list_sort(list(v)) AS l, count(*) AS n FROM b GROUP BY flow_id)", "z AS (SELECT flow_id, " + ", ".join(f"CAST(l[CAST(floor(CAST({p} AS DOUBLE)*(n-1)) AS BIGINT)+1] AS DOUBLE) AS z{s}" for p, s in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + " FROM q)", select=", ".join(f"z{s} AS payload_byte_{s}" if s in ("median", "q1", "q3") else f"payload_byte_{s}" for s in STATS), joins=("payload_byte_s", "z")),
        "length_autocorr": query(EVENTS, autocorr("pk", "pkt_len", "length_autocorr_lag", "5"), select=", ".join(f"length_autocorr_lag_{k}" for k in range(1, 6)), joins=("ac",)),
        "length_runs": query(LINES, "rn AS (SELECT *, CAST(coalesce(pkt_len <> lag(pkt_len) OVER (PARTITION BY flow_id ORDER BY pkt_no), true) AS INT) AS nw FROM pk)", "ri AS (SELECT *, sum(nw) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS run FROM rn)", "rl AS (SELECT flow_id, run AS pkt_no, count(*) AS k FROM ri GROUP BY ALL)", nine("rl", "k", "length_run", True), select=cols("length_run"), joins=("length_run_s",)),
        "length_corr": query(EVENTS, "x AS (SELECT *, lead(ts_us) OVER (PARTITION BY flow_id ORDER BY pkt_no) - ts_us AS gap FROM pk)", f"s AS (SELECT flow_id, {r('covar_pop(CAST(pkt_len AS DOUBLE), CAST(gap AS DOUBLE))/nullif(stddev_pop(pkt_len) FILTER (WHERE gap IS NOT NULL)*stddev_pop(gap),0)')} AS a, {r('covar_pop(CAST(pkt_len AS DOUBLE), CAST(direction AS DOUBLE))/nullif(stddev_pop(pkt_len)*stddev_pop(direction),0)')} AS b FROM x GROUP BY flow_id)", select="coalesce(a,0) AS length_iat_correlation, coalesce(b,0) AS length_direction_correlation", joins=("s",)),
        "direction_stats": query(TALKS, "x AS (SELECT *, lag(direction) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS p FROM pk)", "s AS (SELECT flow_id, count(*) FILTER (WHERE direction=1) AS f, count(*) FILTER (WHERE direction=-1) AS b, count(*) AS n, count(*) FILTER (WHERE p<>direction) AS ch, count(DISTINCT CASE WHEN p IS NOT NULL THEN CAST(p>0 AS INT)*2+CAST(direction>0 AS INT) END) AS u FROM x GROUP BY flow_id)", select=f"CASE WHEN f>0 AND b>0 THEN {r('-(f/(f+b))*log2(f/(f+b))-(b/(f+b))*log2(b/(f+b))')} ELSE 0 END AS direction_sequence_entropy, CASE WHEN n>1 THEN {r('ch/(n-1)')} ELSE 0 END AS direction_change_frequency, u AS direction_transition_unique_count", joins=("s",)),
        "length_values": query(EVENTS, "mx AS (SELECT *, max(pkt_len) OVER (PARTITION BY flow_id) AS m FROM pk)", entropy("mx", "CASE WHEN m<4096 THEN pkt_len ELSE least(pkt_len,4095) END", "packet_length_entropy"), "q AS (SELECT flow_id, count(*) AS n, count(DISTINCT pkt_len) AS u, list_sort(list(CAST(pkt_len AS DOUBLE))) AS l FROM pk GROUP BY flow_id)", f"s AS (SELECT flow_id, {r('u/n')} AS length_sequence_unique_ratio, " + ", ".join(f"{'l[n]' if p == 100 else quantile(p, True)} AS packet_length_percentile_{p}" for p in (1, 5, 10, 90, 95, 99, 100)) + " FROM q)", select="* EXCLUDE (flow_id)", joins=("s", "en")),
        "hurst": query(*iat, "q AS (SELECT flow_id, CAST(iat AS DOUBLE) AS x, row_number() OVER (PARTITION BY flow_id ORDER BY pkt_no) - 1 AS i, count(*) OVER (PARTITION BY flow_id) AS n FROM g WHERE iat IS NOT NULL)",
            "b AS (SELECT flow_id, x, i, n, s, i // s AS k FROM q, (SELECT CAST(8 * 2**e AS BIGINT) AS s FROM range(12) t(e)) WHERE s <= n // 2 AND i // s < n // s)",
            "d AS (SELECT flow_id, i, n, s, k, x, x - avg(x) OVER (PARTITION BY flow_id, s, k) AS d FROM b)",
            "w AS (SELECT flow_id, s, k, x, sum(d) OVER (PARTITION BY flow_id, s, k ORDER BY i) AS c FROM d)",
            "z AS (SELECT flow_id, s, k, CASE WHEN stddev_samp(x) > 0 THEN (greatest(max(c),0) - least(min(c),0)) / stddev_samp(x) ELSE 0 END AS rs FROM w GROUP BY ALL)",
            "p AS (SELECT flow_id, s, avg(rs) AS rs FROM z GROUP BY ALL)",
            "h AS (SELECT flow_id, least(greatest(regr_slope(ln(rs), ln(s)), 0), 1.5) AS x FROM p WHERE rs > 0 GROUP BY flow_id HAVING count(*) > 1)",
            select=f"coalesce({r('x')}, 0.5) AS hurst_exponent_estimate", joins=("h",)),
        "periodicity": query(*iat, "d AS (SELECT flow_id, pkt_no, CAST(iat AS DOUBLE) - avg(iat) OVER (PARTITION BY flow_id) AS e FROM g WHERE iat IS NOT NULL)", "dd AS (SELECT *, " + ", ".join(f"lead(e,{k}) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS e{k}" for k in range(1, 6)) + " FROM d)", "a AS (SELECT flow_id, count(*) AS n, " + ", ".join(f"abs(sum(e*e{k})/nullif(sum(e*e),0)) AS r{k}" for k in range(1, 6)) + " FROM dd GROUP BY flow_id)", "s AS (SELECT flow_id, CASE WHEN n>6 THEN greatest(r1,r2,r3,r4,r5)/CASE WHEN r1>1e-9 THEN r1 ELSE 1 END ELSE 0 END AS x FROM a)", select=f"coalesce({r('x', 3)},0) AS periodic_dominant_freq_ratio, CAST(coalesce(x,0)>1.5 AS BIGINT) AS has_strong_periodicity", joins=("s",)),
        "bigrams": query(EVENTS, "x AS (SELECT flow_id, pkt_no, CASE WHEN pkt_len<=64 THEN 0 WHEN pkt_len<=1200 THEN 1 ELSE 2 END AS c FROM pk)", "y AS (SELECT flow_id, lag(c,1,0) OVER (PARTITION BY flow_id ORDER BY pkt_no)*3+c AS p FROM x)", f"z AS (SELECT flow_id, list_sort([{', '.join(f'[-count(*) FILTER (WHERE p={k}), {k}]' for k in range(9))}]) AS l FROM y GROUP BY flow_id)", select=", ".join(bigram), joins=("z",)),
        "raw_sequences": query(*iat, "s AS (SELECT flow_id, string_agg(pkt_len, ',' ORDER BY pkt_no) AS packet_length_seq, coalesce(string_agg(iat, ',' ORDER BY pkt_no), '') AS packet_iat_seq, string_agg(direction, ',' ORDER BY pkt_no) AS packet_direction_seq, string_agg('0/0/0/' || payload_len || '/' || coalesce(iat,0), ',' ORDER BY pkt_no) AS l2l3l4pl_iat FROM g GROUP BY flow_id)", select="* EXCLUDE (flow_id)", joins=("s",)),
        "chunk_sequence": query(*iat, f"x AS (SELECT *, CAST(coalesce(direction <> lag(direction) OVER (PARTITION BY flow_id ORDER BY pkt_no) OR iat > {2 * HOUR6}, false) AS INT) AS nw FROM g)", "y AS (SELECT *, sum(nw) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS ch FROM x)", "z AS (SELECT flow_id, ch, CAST(sum(pkt_len) AS BIGINT) AS b FROM y GROUP BY ALL)", "s AS (SELECT flow_id, string_agg(b, ',' ORDER BY ch) AS dl_chunk_seq, count(*) AS dl_chunk_seq_len FROM z GROUP BY flow_id)", select="* EXCLUDE (flow_id)", joins=("s",)),
        "rate_sequence": query(EVENTS, f"s AS (SELECT flow_id, (max(ts_us)-min(ts_us))//{DAY}+1 AS n FROM pk GROUP BY flow_id)", select="n AS uplink_rate_seq_len, n AS downlink_rate_seq_len", joins=("s",)),
        "fft_all": spectrum("all", "true", True),
        "fft_fwd": spectrum("fwd", "direction = 1", False),
        "fft_bwd": spectrum("bwd", "direction = -1", False),
        "window_packets": query(EVENTS, WINDOWS, nine("w", "packets", "window_packet_count", True), select=cols("window_packet_count"), joins=("window_packet_count_s",)),
        "window_bytes": query(EVENTS, WINDOWS, nine("w", "bytes", "window_byte_count", True, 3), select=cols("window_byte_count"), joins=("window_byte_count_s",)),
        "behavior_basic": f"WITH {EVENTS}, a AS (SELECT flow_id, {dur} AS d, sum(pkt_len) AS b, count(*) AS n {c}) SELECT flow_id, {r('d')} AS flow_duration, CASE WHEN d>0 THEN {r('b*8/d')} END AS avg_bitrate, CASE WHEN d>0 THEN {r('n/d')} END AS avg_packet_rate, CASE WHEN d>0 THEN {r('b/1024/d')} END AS avg_throughput, CASE WHEN d>0 THEN CAST(b*8/d/1000>10 AS BIGINT) END AS is_bulk_transfer, CASE WHEN d>0 THEN CAST(d<2 AS BIGINT) END AS short_connection_ratio FROM a",
        "behavior_pattern": query(*iat, WINDOWS, f"a AS (SELECT flow_id, coalesce(sum(pkt_len) {fw},0) AS f, coalesce(sum(pkt_len) {bw},0) AS b, coalesce(stddev_samp(iat),0) AS sd, coalesce(avg(iat),0) AS mu FROM g GROUP BY flow_id)", f"pw AS (SELECT flow_id, {r('max(bytes)*8/86400')} AS peak_bitrate FROM w GROUP BY flow_id)", "t AS (SELECT *, CASE WHEN f=0 AND b=0 THEN 1 WHEN b=0 THEN CAST('Infinity' AS DOUBLE) ELSE f/b END AS x FROM a)", select=f"CASE WHEN b>0 OR f=0 THEN {r('x')} END AS flow_asymmetry_ratio, CASE WHEN x<0.5 THEN 'download_heavy' WHEN x>2 THEN 'upload_heavy' WHEN x BETWEEN 0.8 AND 1.25 THEN 'balanced' ELSE 'asymmetric' END AS flow_pattern, CAST(CASE WHEN mu=0 THEN true ELSE sd/mu<0.5 END AS BIGINT) AS has_regular_intervals, CAST(1 AS DOUBLE) AS protocol_tcp_ratio, CAST(0 AS DOUBLE) AS protocol_udp_ratio, CAST(0 AS DOUBLE) AS protocol_icmp_ratio, CAST(0 AS DOUBLE) AS protocol_other_ratio, peak_bitrate", joins=("t", "pw")),
        "behavior_bitrate": query(EVENTS, WINDOWS, "wr AS (SELECT flow_id, pkt_no, bytes*8/86400 AS rate, bytes/sum(bytes) OVER (PARTITION BY flow_id) AS sh FROM w)", nine("wr", "rate", "instant_bitrate", False), f"q AS (SELECT flow_id, count(*) AS n, list_sort(list(rate)) AS l, {r('avg(CASE WHEN sh>0 THEN -sh*log2(sh) ELSE 0 END)')} AS traffic_entropy_ts_mean, {r('max(CASE WHEN sh>0 THEN -sh*log2(sh) ELSE 0 END)')} AS traffic_entropy_ts_peak FROM wr GROUP BY flow_id)", "z AS (SELECT flow_id, traffic_entropy_ts_mean, traffic_entropy_ts_peak, " + ", ".join(f"{r(quantile(p, False))} AS bitrate_percentile_{p}" for p in (25, 50, 75, 90)) + " FROM q)", select=f"{cols('instant_bitrate')}, z.* EXCLUDE (flow_id)", joins=("instant_bitrate_s", "z")),
        "sni_join": "SELECT page_id AS flow_id, greatest(CAST(ceil(octet_length(encode(html))/1460) AS BIGINT), 1) AS total_packets, nullif(substr(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), 1, 127), '') AS sni FROM pages",
        "payload_entropy": query(TALKS, BYTES,
            "c1 AS (SELECT flow_id, pkt_no, v, CAST(count(*) AS DOUBLE) AS c FROM b GROUP BY ALL), c2 AS (SELECT *, sum(c) OVER (PARTITION BY flow_id, pkt_no) AS t FROM c1), e1 AS (SELECT flow_id, pkt_no, -sum(c/t*log2(c/t)) AS e FROM c2 GROUP BY ALL)",
            "nx AS (SELECT flow_id, pkt_no, i, v, lead(v) OVER (PARTITION BY flow_id, pkt_no ORDER BY i) AS u, v - avg(v) OVER (PARTITION BY flow_id, pkt_no) AS d FROM b), nd AS (SELECT *, lead(d) OVER (PARTITION BY flow_id, pkt_no ORDER BY i) AS d1 FROM nx)",
            "m1 AS (SELECT flow_id, pkt_no, v, u, CAST(count(*) AS DOUBLE) AS c FROM nx WHERE u IS NOT NULL GROUP BY ALL), m2 AS (SELECT *, sum(c) OVER (PARTITION BY flow_id, pkt_no, v) AS t, sum(c) OVER (PARTITION BY flow_id, pkt_no) AS a FROM m1), mk AS (SELECT flow_id, pkt_no, -sum(c/a*log2(c/t)) AS m FROM m2 GROUP BY ALL)",
            "au AS (SELECT flow_id, pkt_no, CASE WHEN sum(d*d) FILTER (WHERE d1 IS NOT NULL) > 0 THEN sum(d*d1)/sum(d*d) FILTER (WHERE d1 IS NOT NULL) ELSE 0 END AS a FROM nd GROUP BY ALL HAVING count(*) > 1)",
            f"p AS (SELECT flow_id, {r('avg(e)')} AS payload_entropy, {r('avg(coalesce(m,0))')} AS payload_markov_entropy, {r('coalesce(avg(a),0)')} AS payload_autocorrelation_lag1 FROM e1 LEFT JOIN mk USING (flow_id, pkt_no) LEFT JOIN au USING (flow_id, pkt_no) GROUP BY flow_id)",
            "o AS (SELECT flow_id, v, row_number() OVER (PARTITION BY flow_id ORDER BY pkt_no, i) AS place FROM b)",
            *[f"h{k} AS (SELECT flow_id, v, CAST(count(*) AS DOUBLE) AS c FROM o WHERE place <= {k} GROUP BY ALL), g{k} AS (SELECT *, sum(c) OVER (PARTITION BY flow_id) AS t FROM h{k}), f{k} AS (SELECT flow_id, {r('-sum(c/t*log2(c/t))')} AS payload_first_{k}_entropy FROM g{k} GROUP BY flow_id)" for k in (128, 256)],
            select="* EXCLUDE (flow_id)", joins=("p", "f128", "f256")),
        "rate_text": query(EVENTS, f"x AS (SELECT flow_id, direction, pkt_len, (ts_us - min(ts_us) OVER (PARTITION BY flow_id))//{DAY} AS k FROM pk)", "y AS (SELECT flow_id, k, coalesce(sum(pkt_len) FILTER (WHERE direction=1),0)*8/86400 AS up, coalesce(sum(pkt_len) FILTER (WHERE direction=-1),0)*8/86400 AS down FROM x GROUP BY ALL)",
            "z AS (SELECT flow_id, unnest(range(0, max(k)+1)) AS k FROM x GROUP BY flow_id)",
            "s AS (SELECT flow_id, string_agg(format('{:g}', CAST(coalesce(up,0) AS DOUBLE)), ',' ORDER BY k) AS uplink_rate_seq, string_agg(format('{:g}', CAST(coalesce(down,0) AS DOUBLE)), ',' ORDER BY k) AS downlink_rate_seq, count(*) AS uplink_rate_seq_len, count(*) AS downlink_rate_seq_len FROM z LEFT JOIN y USING (flow_id, k) GROUP BY flow_id)",
            select="* EXCLUDE (flow_id)", joins=("s",)),
    }
    sql["payload_magic"] = _magic()
    sql["packet_source"] = f"WITH {CAPTURE} SELECT flow_id, pkt_no, event_id, ts_us, CAST(direction AS BIGINT) AS direction, payload_len, l2_len, CAST(l3_len AS BIGINT) AS l3_len, CAST(l4_len AS BIGINT) AS l4_len, pkt_len FROM pk"
    way = lambda d: f"count(*) FILTER (WHERE direction = {d})"
    of = lambda d: f"CAST(coalesce(sum(pkt_len) FILTER (WHERE direction = {d}), 0) AS BIGINT)"
    opening = "o AS (SELECT flow_id, min(pkt_no) AS first FROM pk WHERE udp OR event_id % 5 = 0 GROUP BY flow_id)"
    sql["opened_flows"] = f"WITH {CAPTURE}, {opening} SELECT flow_id, count(*) AS total_packets, {way(1)} AS fwd_packets, {way(-1)} AS bwd_packets, CAST(sum(pkt_len) AS BIGINT) AS total_bytes, {of(1)} AS fwd_bytes, {of(-1)} AS bwd_bytes, {r('(max(ts_us)-min(ts_us))/1e6')} AS flow_duration FROM pk JOIN o USING (flow_id) WHERE pkt_no >= first GROUP BY flow_id"
    from .queries import JSON_FIELDS, RECORD

    for name, parts in (("flow_record", RECORD), ("flow_json_fields", JSON_FIELDS)):  # the record is its groups side by side
        sql[name] = f"SELECT * FROM ({sql[parts[0]]})" + "".join(f" JOIN ({sql[part]}) USING (flow_id)" for part in parts[1:])
    return sql
