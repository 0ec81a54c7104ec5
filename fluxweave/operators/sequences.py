"""Groups about the order of packets: sequence measures, raw, chunk and rate sequences, spectra. All look at a flow's last max_sequence packets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kernels import Lagged, Stats, entropy, flag
from ..functions.recipe import Recipe, feature_group
from ..functions.udfs import hurst_rs, lz78_phrases, short_numbers, spectrum
from .timing import LAGS

PERCENTILES = (1, 5, 10, 90, 95, 99, 100)
CLASSES = "sml"
#: Sizes from here on count as one in the entropy of a flow that has a larger one.
LARGEST = 4096


def kept_packets(r: Recipe) -> Column:
    """The tail's packets by pkt_no, with their parts; at most max_sequence."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in r.has else F.lit(0)
    mine, inner = r.tail()
    iat = F.when(inner, r.iat())
    cells = F.concat_ws("/", part("l2_len"), part("l3_len"), part("l4_len"), F.col("payload_len"), F.coalesce(iat, F.lit(0)))
    every = r.gathered("_tail", F.collect_list(F.when(mine, F.struct("pkt_no", "pkt_len", iat.alias("iat"), "direction", cells.alias("cells")))))
    return r.after("_kept", F.sort_array(every))


def length_runs(r: Recipe) -> Column:
    """Length of each run of packets of one size; null for other cells."""
    mine, inner = r.tail()
    new = r.column("_new_run", flag(mine & (~inner | (F.col("pkt_len") != r.lag("pkt_len")))), 0, 1)
    r.cell("run", F.when(mine, r.so_far("_run", new)), n=F.lit(1))
    return F.when(F.col("grain") == "run", F.col("n"))


def correlation(r: Recipe, name: str, x: Column, y: Column) -> Column:
    """Pearson's; 0 where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    of = lambda part, a: r.agg(f"_{name}_{part}", a)
    return F.coalesce(F.try_divide(of("xy", F.covar_pop(x, y)), F.nullif(of("x", F.stddev_pop(x)) * of("y", F.stddev_pop(y)), F.lit(0.0))), F.lit(0.0))


def directions(r: Recipe) -> dict[str, Column]:
    (mine, inner), way = r.tail(), F.col("direction")
    before = F.when(inner, r.lag("direction"))
    f, b, n = r.agg("_tail_fwd", F.count_if(mine & (way == 1))), r.agg("_tail_bwd", F.count_if(mine & (way == -1))), r.agg("_tail_n", F.count_if(mine))
    share = f / (f + b)
    pair = (before > 0).cast("int") * 2 + (way > 0).cast("int")
    pairs = [r.agg(f"_turn_{k}", F.coalesce(F.max(flag(pair == k)), F.lit(0))) for k in range(4)]
    changed = r.agg("_turns", F.count_if(before != way))
    return {
        "direction_sequence_entropy": F.when((f > 0) & (b > 0), -share * F.log2(share) - (1 - share) * F.log2(1 - share)).otherwise(0.0), "direction_change_frequency": F.when(n > 1, changed / (n - 1)).otherwise(0.0),
        "direction_transition_unique_count": (pairs[0] + pairs[1] + pairs[2] + pairs[3]).cast("long"),
    }


def length_values(r: Recipe) -> dict[str, Column]:
    """How many different sizes, their entropy, and percentiles."""
    mine, _ = r.tail()
    size = F.when(mine, F.col("pkt_len"))
    r.cell("size", size, n=F.lit(1))
    here, n, key = F.col("grain") == "size", F.col("n"), F.col("key")
    different, total = r.cell_agg("_sizes", F.count_if(here)), r.cell_agg("_sizes_n", F.sum(F.when(here, n)))
    terms, large = r.cell_agg("_sizes_t", F.sum(F.when(here & (key < LARGEST - 1), n * F.log2(n)))), r.cell_agg("_sizes_l", F.sum(F.when(here & (key >= LARGEST - 1), n)))
    rest = F.coalesce(terms, F.lit(0.0)) + F.coalesce(large * F.log2(large), F.lit(0.0))
    ranks, most = r.quantiles("tail_size", size, [p / 100 for p in PERCENTILES[:-1]]), r.agg("_size_max", F.max(size))
    columns = {f"packet_length_percentile_{p}": F.floor(ranks[k]).cast("double") for k, p in enumerate(PERCENTILES[:-1])} | {"packet_length_percentile_100": most.cast("double")}
    return columns | {"length_sequence_unique_ratio": different / total, "packet_length_entropy": F.log2(total) - rest / total}


def bigram_columns(r: Recipe) -> dict[str, Column]:
    """Of the nine pairs of neighbouring size classes the five most frequent, one column a rank and pair; the first packet follows a small one, ties go to the first pair."""
    mine, inner = r.tail()
    of = lambda size: F.when(size <= r.cfg.small_pkt_threshold, 0).when(size <= r.cfg.large_pkt_threshold, 1).otherwise(2)
    pair = F.when(inner, of(r.lag("pkt_len"))).otherwise(0) * 3 + of(F.col("pkt_len"))
    r.after("_pairs", F.sort_array(F.array(*[F.struct((-r.agg(f"_pair_{k}", F.count_if(mine & (pair == k)))).alias("n"), F.lit(k).alias("k")) for k in range(9)])))
    names = [a + b for a in CLASSES for b in CLASSES]
    return {f"top_{place + 1}_bigram_{name}_freq": F.expr(f"IF({at}.k = {k}, -{at}.n, 0)") for place in range(5) for at in [f"get(_pairs, {place})"] for k, name in enumerate(names)}


@feature_group
def bigrams(r: Recipe) -> None:
    r.out(**bigram_columns(r))


def lagged_in_tail(r: Recipe, name: str, prefix: str, less: Column, first: int, layer: int) -> Lagged:
    """Products of the tail's values of a column; its first values, so many, have none."""
    r.tail()
    place = F.col("pkt_no") - r.tail_first() - first
    return Lagged(r, prefix, F.when(place >= 0, F.col(name)) - less, {k: F.when(place >= k, r.lag(name, k, layer)) - less for k in LAGS})


def periodicity(r: Recipe) -> dict[str, Column]:
    """Largest of five autocorrelations of the gaps, by the whole sum of squares, over the first (by itself where that is next to 0); none up to six gaps."""
    r.iat()
    s = lagged_in_tail(r, "iat", "tail_gaps", r.total("_iat_lo", "min", F.col("iat"), 1), 1, 1)
    shares = [F.when(s.squares() > 0, F.abs(s.products(k) / s.squares())) for k in LAGS]
    largest = F.greatest(*shares)
    ratio = r.after("_periodic", F.when((s.n > 6) & largest.isNotNull(), F.when(shares[0] > 1e-9, largest / shares[0]).otherwise(largest)).otherwise(0.0))
    return {"periodic_dominant_freq_ratio": ratio, "has_strong_periodicity": flag(ratio > 1.5)}


def complexity(r: Recipe) -> dict[str, Column]:
    """Phrases of the lengths' parse, absolute and by packet, and the Hurst exponent of the gaps."""
    kept = kept_packets(r)
    phrases = r.after("_phrases", lz78_phrases(F.transform(kept, lambda s: s.pkt_len)))
    gaps = F.transform(F.filter(kept, lambda s: s.iat.isNotNull()), lambda s: s.iat.cast("double"))
    return {"lz78_complexity_index": phrases, "length_sequence_complexity": phrases / F.size(kept), "hurst_exponent_estimate": hurst_rs(gaps)}


@feature_group
def sequence_stats(r: Recipe) -> None:
    (mine, inner), n = r.tail(), F.col("_tail_n")
    least = r.total("_size_lo", "min", F.col("pkt_len"))
    sizes = r.column("_size_over", F.col("pkt_len") - least)
    lengths = lagged_in_tail(r, "_size_over", "tail_sizes", F.lit(0), 0, 1)
    gap, before = F.when(inner, r.iat()), F.when(inner, r.lag("pkt_len"))
    r.out(
        **directions(r), **lengths.correlations("length_autocorr_lag", least=5), **Stats(r, "length_run", length_runs(r), True, cells="n").columns(), **length_values(r), **complexity(r), **periodicity(r), **bigram_columns(r),
        packet_length_seq_len=n, packet_iat_seq_len=n - 1, packet_direction_seq_len=n, length_iat_correlation=correlation(r, "size_gap", before, gap), length_direction_correlation=correlation(r, "size_way", F.when(mine, sizes), F.col("direction")),
        custom_protocol_length_pattern=F.lit("unknown"), ar_prediction_mse=F.lit(0.0), ar_prediction_mae=F.lit(0.0),
    )


@feature_group
def raw_sequences(r: Recipe) -> None:
    kept = kept_packets(r)
    text = lambda f: F.array_join(F.transform(kept, f), ",")
    r.out(packet_length_seq=text(lambda s: s.pkt_len), packet_iat_seq=text(lambda s: s.iat), packet_direction_seq=text(lambda s: s.direction), l2l3l4pl_iat=text(lambda s: s.cells))


@feature_group
def chunk_sequences(r: Recipe) -> None:
    """Bytes of groups that end where the direction changes or a gap is long."""
    mine, inner = r.tail()
    new = r.column("_new_chunk", flag(inner & ((F.col("direction") != r.lag("direction")) | (r.iat() > r.cfg.chunk_gap_us))), 0, 1)
    r.cell("chunk", F.when(mine, r.so_far("_chunk", new)), size=F.col("pkt_len"))
    every = r.after("_chunks", F.sort_array(r.cell_gathered("_chunk_list", F.collect_list(F.when(F.col("grain") == "chunk", F.struct("key", "size"))))))
    r.out(dl_chunk_seq=F.array_join(F.transform(every, lambda s: s["size"]), ","), dl_chunk_seq_len=F.size(every))


@feature_group
def rate_sequences(r: Recipe) -> None:
    """Bits a second of each time bin from the first packet of the tail to the last, empty ones too."""
    (mine, _), size, way = r.tail(), F.col("pkt_len"), F.col("direction")
    begin = r.total("_tail_begin", "min", F.when(mine, F.col("ts_us")), 1)
    r.cell("rate", F.when(mine, F.floor((F.col("ts_us") - begin) / r.cfg.rate_bin_us)), up=F.when(way == 1, size), down=F.when(way == -1, size))
    mine = F.col("grain") == "rate"
    bins, last = r.cell_gathered("_bins", F.collect_list(F.when(mine, F.struct("key", F.struct("up", "down"))))), r.cell_agg("_last_bin", F.max(F.when(mine, F.col("key"))))
    by_bin = r.after("_by_bin", F.map_from_entries(bins))
    rate = lambda way: r.after(f"_{way}_rate", F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.coalesce(F.try_element_at(by_bin, k)[way], F.lit(0)) * 8 / (r.cfg.rate_bin_us / 1e6)))
    up, down = rate("up"), rate("down")
    r.out(uplink_rate_seq=short_numbers(up), downlink_rate_seq=short_numbers(down), uplink_rate_seq_len=F.size(up), downlink_rate_seq_len=F.size(down))


def _fft(r: Recipe, prefix: str, way: int | None) -> None:
    kept = kept_packets(r)
    mine = F.filter(kept, lambda s: s.direction == way) if way else kept
    f = r.after(f"_{prefix}_spectrum", spectrum(F.transform(mine, lambda s: s.pkt_len)))
    r.out(
        **{f"{prefix}_fft_freq_{k}_idx": F.get(f["idx"], F.lit(k)) for k in range(5)}, **{f"{prefix}_fft_mag_{k}": F.get(f["mag"], F.lit(k)) for k in range(5)},
        **{f"{prefix}_fft_magnitude_{n}": f[n] for n in ("mean", "std", "min", "max", "median", "q1", "q3", "skew", "kurt")}, **({} if way else {"psd_peak": f["psd"]}),
    )


@feature_group
def fft_global(r: Recipe) -> None:
    _fft(r, "all", None)


@feature_group
def fft_fwd(r: Recipe) -> None:
    _fft(r, "fwd", 1)


@feature_group
def fft_bwd(r: Recipe) -> None:
    _fft(r, "bwd", -1)
