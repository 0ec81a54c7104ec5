"""Phrase collocations: suffix automata of shards count bounded phrases by their end positions, the counts are summed, cut and ranked for each language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, codes, mixed, saved, words, LOWER

#: Most words of a phrase, and fewest occurrences.
DEPTH, LEAST = 4, 30
#: A phrase inside a longer one goes if that has so many hundredths of its occurrences.
SUBSUMED = 80
#: Phrases returned for each language.
TOP = 2000
#: Bytes of text in the automaton of one shard.
SHARD_BYTES = 1 << 20
#: Pairs and triples of words are counted by so many bits of their hashes, and looked up by the first of these (2^27 bits: 16 MB). Those that meet are only
#: counted in vain; while the bitmap has room (some 10^7 frequent ones), 2^32 numbers seldom hold 30 rare ones in one.
NUMBER_BITS, FILTER_BITS = 32, 27
#: Parts in which a language's phrases are ranked before its first ones are ranked together.
PARTS = 32

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[*b" \t.,;:!?\n\x0b\x0c\r"]] = False
#: Bytes between the pieces in which phrases stand.
BREAK_BYTES = np.zeros(256, np.int64)
BREAK_BYTES[[*b".,;:!?\n\x0b\x0c\r"]] = 1


class Shard:
    """The words of some rows: their bytes, hashes, rows, and whether each follows the one before it in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.hashes, self.starts, self.ends, ptr = words(data, offsets, WORD_BYTES)
        raw = LOWER[data[int(offsets[0]) : int(offsets[-1])]]
        breaks = np.cumsum(BREAK_BYTES[raw])
        self.row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[1:] = (self.row[1:] == self.row[:-1]) & (breaks[self.starts[1:]] == breaks[self.starts[:-1]])
        self.raw = raw
        self.raw[self.ends[:-1][self.follows[1:]]] = 32

    def pairs(self, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words of the pairs in a piece, and the pairs' hashes; salt has a number for each row."""
        at = np.flatnonzero(self.follows)
        return at, mixed(mixed(self.hashes[at - 1] + salt[self.row[at]]) * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at])

    def triples(self, at: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words of the triples made of two of these pairs, and the triples' hashes."""
        here = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
        return at[here], mixed(pair[here - 1] * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at[here]])

    def texts(self, first: np.ndarray, n: int) -> pa.Array:
        """The n words from each place on, one blank between them."""
        size = self.ends[first + n - 1] - self.starts[first]
        if n > 1:  # more than one blank may stand between two words
            each = (first[:, None] + np.arange(n)).ravel()
            length = self.ends[each] - self.starts[each] + np.tile(np.arange(n) < n - 1, len(first))
            size = length.reshape(-1, n).sum(1)
            data = self.raw[_places(self.starts[each], length)]
        else:
            data = self.raw[_places(self.starts[first], size)]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.string())


def _places(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(starts - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def automaton(values: list[int], fresh: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of the generalised suffix automaton of some sequences, one after the other; fresh marks where each begins.

    Of each state: its suffix link, the length of its longest string, a place where that ends, and the number of places
    where its strings end. State 0 is the empty string.
    """
    follow: list[dict[int, int]] = [{}]
    link, length, end, count = [-1], [0], [-1], [0]
    last = 0

    def cloned(p: int, q: int, c: int) -> int:
        """The state of the strings of q that continue those of p by c, taken out of q."""
        new = len(follow)
        follow.append(follow[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        end.append(end[q])
        count.append(0)
        link[q] = new
        while p >= 0 and follow[p].get(c) == q:
            follow[p][c] = new
            p = link[p]
        return new

    for i, c in enumerate(values):
        if fresh[i]:
            last = 0
        q = follow[last].get(c)
        if q is not None:
            last = q if length[q] == length[last] + 1 else cloned(last, q, c)
            count[last] += 1
            continue
        new, p = len(follow), last
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(i)
        count.append(1)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            link[new] = q if length[q] == length[p] + 1 else cloned(p, q, c)
        last = new
    for v in np.argsort(-np.array(length), kind="stable").tolist()[:-1]:  # what ends a longer string ends its suffixes
        count[link[v]] += count[v]
    return np.array(link), np.array(length), np.array(end), np.array(count)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Shard]]:
    data, offsets = buffers(batch.column("text"))
    for a, b in chunks(offsets, SHARD_BYTES):
        yield a, b, Shard(data, offsets[a : b + 1])


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a bitmap has the hashes' places."""
    place = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0


def _numbers(frequent: Broadcast | None) -> Callable:
    """Numbers of the pairs of a shard, or of the triples of frequent pairs, and how often they come."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = batch.column("salt").to_numpy().view(np.uint64)
            for a, b, shard in _rows(batch):
                at, hashes = shard.pairs(salt[a:b])
                if frequent is not None:
                    keep = _has(frequent.value, hashes)
                    at, hashes = shard.triples(at[keep], hashes[keep])
                found, n = np.unique(hashes >> np.uint64(64 - NUMBER_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["number", "n"])

    return of


def _bitmap(rows: DataFrame, frequent: Broadcast | None, least: int) -> Broadcast:
    """A bit for each place of FILTER_BITS that the number of a pair (of a triple of frequent pairs, if these are given) has, whose occurrences are least or more."""
    counts = rows.select("text", "salt").mapInArrow(_numbers(frequent), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.shiftright("number", NUMBER_BITS - FILTER_BITS)
    cells = counts.select(F.shiftright(place, 6).alias("cell"), F.lit(1).cast("long").alias("one"), place.bitwiseAND(63).cast("int").alias("bit"))
    cells = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def _phrases(pairs: Broadcast, triples: Broadcast, depth: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt, langs = batch.column("salt").to_numpy().view(np.uint64), batch.column("lang")
            names = langs.dictionary_encode()
            number = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n_langs = len(names.dictionary)

            def made(rows: np.ndarray, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([langs.take(pa.array(rows)), phrases, pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

            for a, b, shard in _rows(batch):
                if not len(shard.starts):
                    continue
                code = codes(shard.raw, shard.starts, shard.ends) * n_langs + number[a:b][shard.row]
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                yield made(a + shard.row[first], shard.texts(first, 1), n)
                total = np.bincount(number[a:b][shard.row], minlength=n_langs)
                some = np.flatnonzero(total)
                at = np.array([int(np.flatnonzero(number == k)[0]) for k in some])
                yield made(at, pa.array([""] * len(some)), total[some])  # all words of a language
                last, pair = shard.pairs(salt[a:b])
                keep = _has(pairs.value, pair)
                last, pair = last[keep], pair[keep]
                linked, ends_triple = np.zeros(len(code) + 1, bool), np.zeros(len(code), bool)
                linked[last] = True
                last, triple = shard.triples(last, pair)
                ends_triple[last[_has(triples.value, triple)]] = True
                inside = np.flatnonzero(linked[:-1] | linked[1:])
                if not len(inside):
                    continue
                link, length, end, count = automaton(code[inside].tolist(), (~linked[inside]).tolist())
                for k in range(2, depth + 1):
                    state = np.flatnonzero((length >= k) & (length[np.maximum(link, 0)] < k))
                    last = inside[end[state]]
                    for back in range(k - 2):  # all its triples must be frequent
                        state, last = state[ends_triple[last - back]], last[ends_triple[last - back]]
                    first = last - (k - 1)
                    yield made(a + shard.row[first], shard.texts(first, k), count[state])

    return of


def counted(documents: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """lang, phrase and f, its occurrences, of the phrases of at most depth words that have least or more; the empty phrase has the language's number of words.

    A phrase of that many occurrences is made of pairs and triples that have as many. So pairs are counted first, by numbers, then triples of frequent pairs;
    two bitmaps of the frequent ones, the same size for any corpus, leave only stretches of frequent pairs to the automata, and of the longer
    phrases only those that can be frequent.
    """
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").withColumn("salt", F.xxhash64("lang"))
    pairs = _bitmap(rows, None, least)
    triples = _bitmap(rows, pairs, least)
    found = rows.mapInArrow(_phrases(pairs, triples, depth), "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def mine(documents: DataFrame, depth: int = DEPTH, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    Texts are cut at .,;:!? and line ends into pieces, pieces at blanks and tabs into words, A-Z lower-cased. A phrase of 2 to depth
    words scores 2000000 * a / (l + r), rounded down: a, l and r are the occurrences of it, of its first words and of
    the rest, at the cut with the lowest score. It is left out if a phrase one word longer, to which its suffix link or the link of the
    reversed text leads, has subsumed hundredths of its occurrences; a still longer one that does has such a phrase in it.
    A null text counts as empty, a null lang as "und"; repeated rows count as often as they come; other columns are left out.
    """
    every = saved(counted(documents, depth, least), "phrases")
    part = lambda n: F.expr(f"substring_index(phrase, ' ', {n})")
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    phrases = every.where("phrase <> ''").withColumnRenamed("f", "a").withColumn("k", size).where("k > 1")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part("cut").alias("left"), part("cut - k").alias("right"))
    of = lambda part, n: every.select("lang", F.col("phrase").alias(part), F.col("f").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("CAST(CAST(a AS DECIMAL(20,0)) * 2000000 DIV (CAST(l AS DECIMAL(20,0)) + r) AS LONG)")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    links = F.array(part("1 - k"), part("k - 1"))
    longer = phrases.where("k > 2").select("lang", F.explode(links).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {subsumed}")
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words_of = every.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return first.join(words_of, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
