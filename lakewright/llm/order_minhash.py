"""Document fingerprints by order MinHash, in DataFrame operations only.

A text's words give overlapping k-mers of ``K`` words; a character of a script
that is written without spaces is a word of its own.  Each k-mer is numbered by
its occurrence, so repeats stay apart.  ``M`` permutations order the numbered
k-mers by hash; the ``L`` least of each are put back into text order and their
tuple is hashed.  Equal tuples need the same k-mers in the same order, so
likeness follows edit distance and not only the set of k-mers.

The permutations are ``RINGS`` independent random orders, each read from M / RINGS
evenly spaced points of its hash ring: from a point the least elements are the
first ``L`` met going up.  One sort of a text's hashes thus serves M / RINGS
permutations.  A k-mer travels as one long: 38 bits of hash over 26 bits of
position (67 million words).

Defined results: null text is the empty text; a text without words has the
all-zero fingerprint; one of fewer than ``K`` words is a single k-mer; with
fewer than ``L`` k-mers the tuple is of all there are.  Fingerprints read words
only, so white space does not change them.  Repeated ids are taken in the order
of the text's hash, wholly repeated rows one after the other; null ids come
last in descending order.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewright.llm.common import let
from lakewright.sources.shared import materialise

K, L, M, RINGS = 2, 2, 64, 4

#: Characters of scripts written without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = r"[\x{0E01}-\x{0EDF}\x{1000}-\x{109F}\x{1780}-\x{17D3}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"

_POS_BITS = 26
_LOW = (1 << _POS_BITS) - 1
_HIGH = ~_LOW
_NONE = "cast(array() as array<bigint>)"


def _below(ordered: Column, target: Column) -> Column:
    """How many elements of an ascending array lie below ``target``, by bisection."""
    steps = F.expr("sequence(30, 0, -1)")
    n = F.size(ordered)
    return F.aggregate(
        F.filter(steps, lambda b: F.call_function("shiftleft", F.lit(1), b) <= n),
        F.lit(0),
        lambda at, b: let_step(ordered, n, target, at, b),
    )


def let_step(ordered: Column, n: Column, target: Column, at: Column, b: Column) -> Column:
    up = at + F.call_function("shiftleft", F.lit(1), b)
    return F.when((up <= n) & (F.get(ordered, up - 1) < target), up).otherwise(at)


def words(text: Column) -> Column:
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(F.coalesce(text, F.lit("")))
    return F.filter(F.split(spaced, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def kmers(w: Column, k: int = K) -> Column:
    """Ascending array<bigint> of the k-mers' hashes over their positions."""
    n = F.size(w)
    at = lambda i: F.xxhash64(*(F.get(w, i + t) for t in range(k))).bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long"))
    return F.sort_array(F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), at)).otherwise(F.expr(_NONE)))


def numbered(s: Column) -> Column:
    """Ascending hashes of (k-mer, occurrence) over positions, from :func:`kmers`."""

    def one(x: Column, i: Column) -> Column:
        key = x.bitwiseAND(F.lit(_HIGH))
        again = (i > 0) & (F.get(s, i - 1) >= key)
        occurrence = F.when(again, i - _below(s, key)).otherwise(F.lit(0))
        return F.xxhash64(key, occurrence).bitwiseAND(F.lit(_HIGH)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))

    return F.sort_array(F.transform(s, one))


def signature(u: Column, l: int = L, m: int = M, rings: int = RINGS) -> Column:  # noqa: E741
    """array<int> of ``m`` tuple hashes from :func:`numbered`."""
    points = m // rings
    starts = F.array(*(F.lit(-(1 << 63) + j * ((1 << 64) // points)).cast("long") for j in range(points)))
    n = F.size(u)

    def ring(r: int) -> Column:
        order = F.sort_array(F.transform(u, lambda x: F.xxhash64(x.bitwiseAND(F.lit(_HIGH)), F.lit(r)).bitwiseAND(F.lit(_HIGH)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))))
        return let(order if r else u, lambda v: F.transform(starts, lambda p: pick(v, _below(v, p))))

    def pick(v: Column, first: Column) -> Column:
        chosen = F.transform(
            F.sequence(F.lit(0), F.least(F.lit(l), n) - 1),
            lambda t: let(
                F.get(v, F.pmod(first + t, n)),
                lambda x: F.call_function("shiftleft", x, F.lit(64 - _POS_BITS)).bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(_POS_BITS))),
            ),
        )
        in_order = F.transform(F.sort_array(chosen), lambda x: x.bitwiseAND(F.lit((1 << (64 - _POS_BITS)) - 1)))
        return F.xxhash64(in_order).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    return F.when(n > 0, F.concat(*(ring(r) for r in range(rings)))).otherwise(F.array_repeat(F.lit(0), m))


def fingerprint(df: DataFrame, text: str, out: str, k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """``df`` with the signature of column ``text`` as array<int> column ``out``."""
    return (
        df.withColumn("_w", words(F.col(text)))
        .withColumn("_s", kmers(F.col("_w"), k))
        .withColumn("_u", numbered(F.col("_s")))
        .withColumn(out, signature(F.col("_u"), l, m))
        .drop("_w", "_s", "_u")
    )


def likeness(a: Column, b: Column, m: int = M) -> Column:
    """The share of equal tuples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(m))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 8, "0"))), "")


def predecessors(rows: DataFrame) -> DataFrame:
    """For each row of (k0, k1, h, half, n) the row before it in descending order of id, cyclically.

    Rows are range partitioned, so neighbours meet inside a partition, and only
    the last row of each partition goes through a table of one row a partition.
    """
    cols = ["k0", "o1", "o2", "k1", "h", "half"]
    dealt = rows.withColumns({"o1": F.bitwise_not("k1"), "o2": F.bitwise_not("h")}).repartitionByRange("k0", "o1", "o2")
    dealt = materialise(dealt.withColumn("pid", F.spark_partition_id()), "order")
    ends = dealt.groupBy("pid").agg(F.max(F.struct(*cols)).alias("last"))
    ends = ends.select("pid", F.coalesce(F.lag("last").over(Window.orderBy("pid")), F.max("last").over(Window.partitionBy())).alias("before"))
    inside = F.lag(F.struct(*cols)).over(Window.partitionBy("pid").orderBy("k0", "o1", "o2"))
    return (
        dealt.withColumn("prev", inside)
        .join(F.broadcast(ends), "pid")
        .withColumn("prev", F.coalesce("prev", "before"))
        .select("k0", "k1", "h", "n", F.col("prev.k0").alias("p0"), F.col("prev.k1").alias("p1"), F.col("prev.h").alias("ph"), F.col("prev.half").alias("p_half"))
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint, its edited text's and the next document's.

    Whole texts are shuffled once, by id; of the next document only the
    characters that the edit takes are sent on.
    """
    keyed = docs.select(
        F.col("doc_id").isNull().alias("k0"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = predecessors(
        keyed.groupBy("k0", "k1", "h").agg(F.count(F.lit(1)).alias("n"), F.max(F.floor(F.length("text") / 2).cast("int")).alias("half"))
    )
    key = ["k0", "k1", "h"]
    met = fingerprint(keyed, "text", "sig").join(order, key)
    met = met.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    sent = met.where("copy = 1").select(
        F.col("p0").alias("k0"), F.col("p1").alias("k1"), F.col("ph").alias("h"), F.expr("substring(text, 1, p_half)").alias("piece"), F.col("sig").alias("next_sig")
    )
    # both sides read the same columns of ``keyed``, so they share one exchange of the texts
    own = met.select(*key, "text", "sig", "n", "copy").join(sent, key)
    last = F.col("copy") == F.col("n")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    own = own.withColumns(
        {
            "doc_id": F.when(~F.col("k0"), F.col("k1")),
            "n_chars": size.cast("long"),
            "edited": F.concat(F.substring("text", F.lit(1), size - half), F.when(last, F.col("piece")).otherwise(F.substring("text", F.lit(1), half))),
            "next_sig": F.when(last, F.col("next_sig")).otherwise(F.col("sig")),
        }
    ).select("doc_id", "n_chars", "edited", "sig", "next_sig")
    return fingerprint(own, "edited", "edited_sig")


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
