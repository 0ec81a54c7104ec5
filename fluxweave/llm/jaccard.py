"""N-gram Jaccard join by parity sketches: XOR-hashed bit sketches per size band, joined on equal parts (pigeonhole), verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, buffers, chunks, grams, mixed, saved, settled, sized, text_hash, words
from .graph import components, linked


def shingle_sets(hashes: np.ndarray, ptr: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles in order; of a text with fewer words, the whole sequence as one."""
    found, at = grams(hashes, ptr, k)
    out = []
    for n, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            out.append(np.unique(found[a:b]))
        elif ptr[n + 1] > ptr[n]:
            size = int(ptr[n + 1] - ptr[n])
            out.append(grams(hashes[ptr[n] : ptr[n + 1]], np.array([0, size]), size)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands for a Jaccard of at least percent/100: two linked sets are of one band or of neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, tops = percent, [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
        self.tops = np.array(tops, np.int64)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size))

    def differ(self, band: int) -> int:
        """Shingles by which linked sets up to the band's top can differ.

        Of sizes a and b with an intersection of at least p/(100+p) of a+b, the sets differ by at most (a+b)(100-p)/(100+p).
        """
        return int(2 * self.tops[band] * (100 - self.percent) // (100 + self.percent))


#: A set may leave out one in so many of its parts: those that most sets have.
SPARE = 8


def part_keys(shingles: np.ndarray, band: int, differ: int) -> np.ndarray:
    """Keys of the parts of the parity sketch. A shingle turns one bit over, so the sketches of two sets
    differ in no more bits, and no more parts, than the sets in shingles.

    Of differ + 1 + 2 * spare parts, linked sets have 1 + 2 * spare equal ones at least. Whichever spare of its parts
    each set leaves out, one part that both keep is equal. The sketch has 2^64 bits, so that a part with a single bit set tells
    texts apart already; it is not stored, a part's key is the XOR of hashes of the bits set in it.
    """
    n_parts = differ + 1 + 2 * (differ // SPARE)
    bit = mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5 + band))
    keys = mixed(np.arange(n_parts, dtype=np.uint64) + np.uint64(band << 40))
    np.bitwise_xor.at(keys, ((bit >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64), mixed(bit * np.uint64(0x9E3779B97F4A7C15)))
    return keys


def _profiles(k: int):
    """Size of each text's set and two hashes of it; null without shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                hashes, _, _, ptr = words(data, offsets[a : b + 1], SPACE_BYTES)
                sets = shingle_sets(hashes, ptr, k)
                one = [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
                two = [int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5DEECE66D))).view(np.int64)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("text_hash")[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "text_hash", "n_shingles", "one", "two"])

    return of


#: Bits of a key besides those of its group; rows are dealt out by groups, of GROUP shingles of the corpus each. Keys that a worker holds before it deals them out.
LOW, GROUP, HELD = 28, 1 << 19, 1 << 20


def _dealt(k: int, bands: Bands, bits: int):
    """The keys of each text's sketch in its own size band (large) and in the next one's, LOW + bits bits of each, as one row for each group that has some: eight bytes a key, with large and 32 bits that name the text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            number, row = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(number)
            group, row = number[order] >> np.uint64(LOW), row[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            at = np.append(first, len(row)).astype(np.int32) * 8
            return pa.RecordBatch.from_arrays([pa.array(group[first].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(row)])], ["group", "rows"])

        n = 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                hashes, _, _, ptr = words(data, offsets[a : b + 1], SPACE_BYTES)
                names = batch.column("name")[a:b].to_numpy().astype(np.uint64)
                for name, s in zip(names, shingle_sets(hashes, ptr, k)):
                    for step in (0, 1) if len(s) else ():
                        band = bands.band(len(s)) + step
                        number = part_keys(s, band, bands.differ(band)) >> np.uint64(64 - LOW - bits)
                        low = number & np.uint64((1 << LOW) - 1)
                        held.append((number, (low << np.uint64(1) | np.uint64(1 - step)) << np.uint64(32) | name))
                        n += len(number)
                    if n >= HELD:
                        yield flush()
                        n = 0
        if held:
            yield flush()

    return of


def _met(rows: pa.Table) -> pa.Table:
    """Of a group the keys that several rows have, one of them large: key, name, large and how many rows have the key."""
    group = rows.column("group")[0].as_py()
    row = np.sort(np.frombuffer(b"".join(rows.column("rows").to_pylist()), np.uint64))
    low = row >> np.uint64(33)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    size = np.diff(np.append(first, len(row)))
    large = row >> np.uint64(32) & np.uint64(1)
    several = np.repeat((size > 1) & (large[first + size - 1] > 0), size)  # large ones are the last of a key
    found, n = row[several], np.repeat(size, size)[several]
    key = (found >> np.uint64(33)).astype(np.int64) | group << LOW
    return pa.table([key, (found & np.uint64(0xFFFFFFFF)).astype(np.int64), large[several] > 0, n.astype(np.int64)], names=["key", "name", "large", "n"])


def _spares(bands: Bands):
    """How many parts each set may leave out in its own band and in the next one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = np.array([bands.differ(v) // SPARE for v in range(len(bands.tops))], np.int64)
        for batch in batches:
            band = np.searchsorted(bands.tops, batch.column("n_shingles").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("name"), pa.array(differ[band]), pa.array(differ[band + 1])], ["rep", "name", "own", "next"])

    return of


def _sets(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                hashes, _, _, ptr = words(data, offsets[a : b + 1], SPACE_BYTES)
                sets = shingle_sets(hashes, ptr, k)
                sketches = [np.concatenate([whole_sketch(s), np.array([len(s)], np.int64)]) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("rep")[a:b], *(pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], sketches))], ["rep", "content", "sketch"])

    return of


#: Words of 64 bits in the parity sketch of a whole set.
WHOLE = 12


def whole_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, in WHOLE words."""
    place = mixed(shingles ^ np.uint64(0x3C6EF372FE94F82B))
    sketch = np.zeros(WHOLE, np.uint64)
    np.bitwise_xor.at(sketch, ((place >> np.uint64(32)) % np.uint64(WHOLE)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return sketch.view(np.int64)


def _likely(x: Column, y: Column, percent: int) -> Column:
    """Whether whole sketches (and, at the end, sizes) allow a Jaccard of percent / 100: the sets differ in as many shingles as the sketches in bits at least."""
    bits = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, WHOLE)), F.bit_count(x[0].bitwiseXOR(y[0])))
    nx, ny = x[WHOLE], y[WHOLE]
    return (bits * (100 + percent) <= (nx + ny) * (100 - percent)) & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))


def join(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles long, component_id.

    Texts link when 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles (words between
    white space, A-Z lower-cased; a shorter text is one shingle). component_id is the smallest doc_id that links
    reach. A null, empty or wordless text has n_shingles 0 and links with nothing: its component is its own id.
    Equal sets are one class and enter the join once. Repeated rows get equal results: an id names one document, for which, where its rows differ in text, the text of the smallest hash
    stands. A row with a null id keeps it, takes no part and has a null component. Other columns are not read.
    """
    kind = dict(documents.dtypes)["doc_id"]
    named = documents.select("doc_id", "text", text_hash().alias("text_hash"))
    profile = saved(named.mapInArrow(_profiles(k), f"doc_id {kind}, text_hash long, n_shingles long, one long, two long"), "profiles")
    same = ["n_shingles", "one", "two"]
    some = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text_hash", *same)).alias("t")).select("doc_id", "t.*")
    classes = some.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select(*same, F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("text_hash"))
    classes = saved(classes, "classes")

    found = settled(lambda: components(_links(named, profile, classes, k, percent)), "components", documents.sparkSession).withColumnRenamed("id", "rep")
    root = some.join(classes.select(*same, "rep"), same).join(found, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return profile.select("doc_id", "n_shingles").join(root, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(named: DataFrame, profile: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the classes of equal sets."""
    bands, kind = Bands(percent), dict(named.dtypes)["doc_id"]
    standing = classes.select(F.col("rep").alias("doc_id"), "text_hash")
    copies = sized(saved(profile.where("n_shingles > 0").select("doc_id", "text_hash").join(standing, ["doc_id", "text_hash"], "left_anti").distinct(), "copies"), 48)
    reps = named.where("doc_id IS NOT NULL").join(copies, ["doc_id", "text_hash"], "left_anti")
    if profile.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        reps = reps.dropDuplicates(["doc_id", "text_hash"])
    name = F.xxhash64("doc_id").bitwiseAND(0xFFFFFFFF)  # texts of one name are taken for each other where they meet others, and told apart when pairs are verified
    bits = int(np.clip(np.ceil(np.log2(max(classes.agg(F.sum("n_shingles")).head()[0] or 0, 1) / GROUP)), 4, 30))
    met = reps.select("text", name.alias("name")).mapInArrow(_dealt(k, bands, bits), "group int, rows binary").groupBy("group").applyInArrow(_met, "key long, name long, large boolean, n long")
    spares = classes.select("rep", F.xxhash64("rep").bitwiseAND(0xFFFFFFFF).alias("name"), "n_shingles").mapInArrow(_spares(bands), f"rep {kind}, name long, own long, next long")
    rows = saved(met, "met").join(spares, "name").select("key", "n", "rep", "large", F.when(F.col("large"), F.col("own")).otherwise(F.col("next")).cast("int").alias("spare"))
    of_set = rows.groupBy("rep", "large", "spare").agg(F.sort_array(F.collect_set(F.struct("n", "key"))).alias("keys"))  # no more than a set has parts
    kept = F.slice("keys", 1, F.greatest(F.size("keys") - F.col("spare"), F.lit(0)))
    buckets = saved(of_set.select(F.explode(kept).alias("k"), "rep", "large").select("k.key", "rep", "large"), "buckets")

    wanted = sized(saved(buckets.select("rep").distinct().join(classes.select("rep", "text_hash"), "rep"), "wanted"), 32)
    texts = named.join(wanted, (named.doc_id == wanted.rep) & (named.text_hash == wanted.text_hash)).select("rep", wanted.text_hash, "text").dropDuplicates(["rep", "text_hash"])
    content = saved(texts.select("rep", "text").mapInArrow(_sets(k), f"rep {kind}, content array<long>, sketch array<long>"), "sets")
    return linked(buckets, content, lambda shingles: shingles, percent, _likely)
