"""The queries of this subpackage, by name, and the SQL for those that it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, jaccard, licenses, lines, neighbours, packing, personal, pieces, quality, runs, tokens, toxicity
from .common import SPACE_WORD, held, shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; null and empty texts have one too, a repeated row repeats its result."""
    scored = quality.classify(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held("doc_id", quality.FOLDS, quality.HELD).alias("held_out"), "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document; a null text counts as empty and has none."""
    return licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; null texts and texts without words have none."""
    found = decontamination.find(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0), lambda total, s: total + s.end - s.start).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back; a null text is empty and has the end id alone."""
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokens.write(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; null and empty texts have one too, a repeated row repeats its result."""
    scored = toxicity.classify(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held("doc_id", toxicity.FOLDS, toxicity.HELD).alias("held_out"), "score", "predicted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by their word shingles; a document without words is linked with nothing."""
    return jaccard.join(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; vectors without a direction take no part."""
    return neighbours.search(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its duplicate lines; the first of each group of similar lines stays."""
    return lines.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def _written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; a null text counts as empty and has none."""
    found = personal.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s.kind)
    counts = [F.size(F.filter(kinds, (lambda k: lambda x: x == k)(k))).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = F.col("decoded").eqNullSafe(F.replace("text", F.lit(pieces.BLANK), F.lit(" ")))
    return both.select("doc_id", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_ids"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"), back.alias("round_trip"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language; null texts have no words, a null language is und."""
    return collocations.mine(_read(spark, sf_dir, "documents").select("lang", "text"))


def repeating(documents: DataFrame) -> DataFrame:
    """doc_id and text of documents, in which a tenth, by the id's hash, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n, a = F.size("w"), F.col("a")
    rows = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({SPACE_WORD})"), 1)).alias("w"))
    rows = rows.select("doc_id", "text", "w", F.floor(F.col("h") / 10).alias("g"), F.when(n > 0, F.floor(F.col("h") / 10) % n).alias("a"))
    rows = rows.select("doc_id", "text", "w", "a", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).alias("p"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, of which a tenth is made to repeat itself; a null text counts as empty and has none."""
    found = runs.find(repeating(_read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    whole = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(whole, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best")["length"], -F.col("best")["col3"]
    return rows.select("doc_id", "n_runs", (-F.col("best")["col2"]).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length DIV -best.col3").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1,024 ids, a row a piece; a null text is empty and has the end id alone."""
    packed = packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    pieces_of = packed.select("sequence_id", F.inline("pieces"))
    return pieces_of.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    single = {f.__name__: f for f in (op1_quality, op2_licenses, op3_decontamination, op4_tokens, op5_toxicity, op6_jaccard, op7_neighbours, op8_lines, op9_personal, op10_sentencepiece, op11_collocations, op12_runs, op13_packing)}
    return {**single, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    alnum = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    space = rf"regexp_extract_all({lower}, '[^\x20\x09-\x0D]+')"
    return {
        "op3_decontamination": f"""WITH d AS (SELECT doc_id, {alnum} AS w FROM documents), b AS (SELECT item_id, {alnum} AS w FROM benchmark),
 bi AS (SELECT item_id, w, least(len(w),10) AS k, unnest(range(1, greatest(len(w)-9,1)+1)) AS i FROM b WHERE len(w)>0), bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1],' ') AS win FROM bi),
 di AS (SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) AS i FROM d, (SELECT DISTINCT k FROM bw)), dw AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1],' ') AS win FROM di),
 o AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k=bw.k AND dw.win=bw.win), p AS (SELECT doc_id, unnest(range(i,i+k)) AS place FROM o), h AS (SELECT doc_id, count(DISTINCT place) AS n FROM p GROUP BY doc_id),
 t AS (SELECT doc_id, count(DISTINCT item_id) AS n, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS l FROM o GROUP BY doc_id)
 SELECT d.doc_id, len(w) AS n_words, coalesce(h.n,0) AS n_hit, coalesce(t.n,0) AS n_items, sha256(coalesce(array_to_string(l,','),'')) AS items_sha256, coalesce(h.n,0)>0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
        "op11_collocations": f"""WITH p AS (SELECT coalesce(lang,'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents), w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT lang, k, unnest([array_to_string(w[i:i+k-1],' ') FOR i IN range(1, len(w)-k+2)]) AS phrase FROM w, (SELECT unnest([1,2,3,4]) AS k)), f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
 n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase,' ') AS w FROM f WHERE k>1 AND f>=30),
 keyed AS (SELECT concat(lang,chr(9),phrase) AS id, f FROM f), cut AS (SELECT c.*, cut, concat(lang,chr(9),array_to_string(w[1:cut],' ')) AS first, concat(lang,chr(9),array_to_string(w[cut+1:],' ')) AS rest FROM c, (SELECT unnest([1,2,3]) AS cut) WHERE cut<c.k),
 s AS (SELECT x.lang, x.phrase, x.a, x.cut, y.f AS l, z.f AS r, x.a*2000000//(y.f+z.f) AS score FROM cut x JOIN keyed y ON y.id=x.first JOIN keyed z ON z.id=x.rest),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut)=1),
 sub AS (SELECT lang, a AS longer, array_to_string(w[i:i+m-1],' ') AS phrase FROM c, (SELECT unnest([1,2,3]) AS i), (SELECT unnest([2,3]) AS m) WHERE m<c.k AND i+m-1<=c.k), h AS (SELECT lang, phrase, max(longer) AS longer FROM sub GROUP BY ALL),
 kept AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100*longer<80*a), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
 SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank<=2000""",
        "op6_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {space} AS w FROM documents), di AS (SELECT doc_id, w, unnest(range(1, greatest(len(w)-2,1)+1)) AS i FROM d WHERE len(w)>0),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2],' ') AS g FROM di), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g=y.g AND x.doc_id<>y.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id=a JOIN n q ON q.doc_id=b WHERE 100*k >= 90*(p.n+q.n-k)),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b=l.a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
 SELECT d.doc_id, coalesce(n.n,0) AS n_shingles, least(d.doc_id, coalesce(c.b,d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a=d.doc_id""",
    }
