"""Fuzzy line dedup by MinHash, in DataFrame operations alone: character shingles, banding, exact Jaccard, union-find."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, settled, sized, text_hash
from .graph import components, linked, once

#: Characters in a shingle, and hundredths of Jaccard similarity from which lines are one.
SHINGLE, PERCENT = 8, 80
#: Bands, and minima in a band: lines of similarity s share a band with a probability of 1 - (1 - s^ROWS)^BANDS, 0.99 at 0.8.
BANDS, ROWS = 7, 3
#: A line is signed over the shingles that begin at words, if it has LONG of them or more and they are one in FEW of all or more; over all its shingles
#: if it has fewer than SHORT, or they are less than one in MANY. Lines between these bounds are signed both ways, so that similar lines are signed alike in
#: one way at least. A line whose words stand beside a long unbroken run is so signed over the run, too.
LONG, SHORT, FEW, MANY = 24, 40, 10, 8
#: Of a pair's BANDS * ROWS minima, four bits each, so many agree if the similarity is 0.8 (but for one pair in 110) or 0.6 (but for one in 500).
AGREE = {PERCENT: 13, 2 * PERCENT - 100: 7}


def normal(line: str) -> Column:
    """The form in which lines are compared: lower case, white space at the ends cut."""
    return F.lower(F.btrim(F.col(line), F.lit(" \t\r\f\v")))


def _cut(line: Column, where: str = "") -> Column:
    """The shingles that begin at the places where a pattern holds, as often as they come."""
    return F.regexp_extract_all(line, F.lit(rf"(?s){where}(?=(.{{{SHINGLE}}}))"), F.lit(1))


def shingles(line: Column) -> Column:
    """Hashes of all distinct shingles; a line shorter than one is a shingle itself."""
    return F.array_distinct(F.transform(F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(_cut(line)), lambda s: F.xxhash64(s)))


def _minima() -> list[Column]:
    """Minima of as many hash functions of a shingle: two hashes of it, seen from points that are spread over all hashes."""
    draw = random.Random(8)
    points = [((k << 60) | draw.getrandbits(60)) - (1 << 63) for k in range(16)]
    return [F.min(F.col(f"h{k % 2}").bitwiseXOR(F.lit(points[k // 2]))).alias(f"m{k}") for k in range(BANDS * ROWS)]


def _signatures(lines: DataFrame) -> DataFrame:
    """id, long (which shingles were signed), bands (the keys) and s0, s1 (four bits of each minimum) of each distinct line (id, line).

    Lines come together by id first, so that the minima over a line's exploded shingles need no further shuffle.
    """
    distinct = once(lines.groupBy("id").agg(F.first("line").alias("line")), "some", _cut(F.col("line"), "(?<![a-z])"))
    some, all_ = F.size("some"), F.length("line") - (SHINGLE - 1)
    ways = F.array_compact(F.array(F.when((some < SHORT) | (some * MANY < all_), False), F.when((some >= LONG) & (some * FEW >= all_), True)))
    placed = distinct.select("id", "line", "some", F.explode(ways).alias("long"))
    n = F.when(F.col("long"), F.size("some")).otherwise(F.greatest(F.length("line") - (SHINGLE - 1), F.lit(1)))
    placed = placed.select("id", "line", "some", "long", F.explode(F.sequence(F.lit(1), n)).alias("p"))
    shingle = F.when(F.col("long"), F.get("some", F.col("p") - 1)).otherwise(F.substring("line", F.col("p"), F.lit(SHINGLE)))
    rows = placed.select("id", "long", shingle.alias("s")).select("id", "long", F.xxhash64("s").alias("h0"), F.xxhash64("s", F.lit(1)).alias("h1"))
    minima = rows.groupBy("id", "long").agg(*_minima())
    keys = [F.xxhash64(F.lit(b), "long", *[f"m{k}" for k in range(b * ROWS, (b + 1) * ROWS)]) for b in range(BANDS)]
    bits = [F.shiftleft(F.col(f"m{k}").bitwiseAND(15), k % 16 * 4) for k in range(BANDS * ROWS)]
    return minima.select("id", "long", F.array(*keys).alias("bands"), reduce(Column.bitwiseOR, bits[:16]).alias("s0"), reduce(Column.bitwiseOR, bits[16:]).alias("s1"))


def _likely(x: Column, y: Column, percent: int) -> Column:
    """Whether enough minima agree, in one of the two ways, for a similarity of percent / 100."""

    def agree(k: int) -> Column:
        d = x[k].bitwiseXOR(y[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return 16 - F.bit_count(d.bitwiseAND(0x1111111111111111))

    unused = 32 - BANDS * ROWS
    return F.coalesce(F.greatest(agree(0) + agree(1), agree(2) + agree(3)) - unused >= AGREE[percent], F.lit(False))


def occurrences(documents: DataFrame) -> DataFrame:
    """Every line that is not blank: doc_id, text_hash, line_no (from 0), line (normal form) and its hash, the line's id."""
    raw = documents.select("doc_id", text_hash().alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return once(raw, "line", normal("raw")).where("line != ''").select("doc_id", "text_hash", "line_no", "line", F.xxhash64("line").alias("id"))


def line_components(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, text_hash, line_no, id), and component of the ids that are similar to another."""
    lines = occurrences(documents)
    placed = saved(lines.select("doc_id", "text_hash", "line_no", "id"), "occurrences")
    return placed, settled(lambda: _components(lines), "components", documents.sparkSession)


def _components(lines: DataFrame) -> DataFrame:
    """id and component of the lines that are similar to another."""
    signed = saved(_signatures(lines), "signatures")
    rows = signed.select(F.explode("bands").alias("key"), F.col("id").alias("rep"))
    shared = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    buckets = saved(rows.join(sized(shared, 16), "key").withColumn("large", F.lit(True)), "buckets")
    wanted = sized(saved(buckets.select(F.col("rep").alias("id")).distinct(), "wanted"), 16)
    sketch = F.array(*[F.max(F.when(F.col("long") == way, F.col(s))) for way in (False, True) for s in ("s0", "s1")])
    sketches = signed.join(wanted, "id", "left_semi").groupBy("id").agg(sketch.alias("sketch"))
    texts = lines.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("content"))
    content = saved(texts.join(sketches, "id").withColumnRenamed("id", "rep"), "lines")
    return components(linked(buckets, content, shingles, PERCENT, _likely))


def removed(documents: DataFrame) -> DataFrame:
    """Lines to remove, by row of documents: doc_id, text_hash and lines (numbers): all lines of a component but its first in the order of doc_id and line number."""
    occurring, found = line_components(documents)
    placed = occurring.join(sized(found, 32), "id", "left").select("doc_id", "text_hash", "line_no", F.coalesce("component", "id").alias("component"))
    at = F.struct("doc_id", "text_hash", "line_no")
    several = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), at)).alias("first")).where("n > 1")
    several = sized(saved(several, "several"), 64)
    extra = placed.join(several, "component").where(~F.col("first").eqNullSafe(at) & F.col("doc_id").isNotNull())
    return extra.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("lines"))


def dedup(documents: DataFrame) -> DataFrame:
    """documents with text without its duplicate lines, and n_lines, n_removed long (after the other columns).

    Lines, cut at newlines, are one component where their normal forms are equal or linked by similarities of 0.8 or more of
    their character shingles; each component keeps one line, the first by doc_id and line number. Blank lines stay. A
    null text stays null and has no lines. Rows with a null id keep all lines. A repeated row (same id and text) is the same
    document, so both keep the same lines. Columns of documents named n_lines or n_removed are replaced, all others kept.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    rows = documents.select(F.struct(*quoted).alias("row"), F.col("doc_id").alias("row_id"), text_hash().alias("row_hash"))  # no name of theirs can clash
    gone = sized(settled(lambda: removed(documents), "removed", documents.sparkSession), 96)
    joined = rows.join(gone, (rows.row_id == gone.doc_id) & (rows.row_hash == gone.text_hash), "left").select("row", F.split("row.text", "\n").alias("all"), F.col("lines").alias("gone"))
    none = F.col("gone").isNull()
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone")
    text = F.when(none, F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("all", i)), "\n"))
    counts = [F.when(F.col("all").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines"), F.when(none, 0).otherwise(F.size("gone")).cast("long").alias("n_removed")]
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.{q}") for c, q in zip(names, quoted)], *counts)
