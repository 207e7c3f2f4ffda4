"""Document fingerprints by consistent weighted sampling, in DataFrame
functions only.

A document's terms are its lower-cased words, weighted by their counts; a run of
characters of a script without spaces gives every three neighbouring characters
as a term.  For each sample k every term draws, from hashes of (term, k) alone,
r and c from Gamma(2, 1) and b from U(0, 1); with weight w

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r

and the sample is (term, t) of the smallest a.  Two documents have the same
sample with a probability equal to their generalised Jaccard similarity
(sum of minima over sum of maxima of the weights), so the share of equal
samples estimates it.  Equal texts have equal fingerprints.

Plan.  The next document in id order is found without a global window: ids are
cut into buckets at quantiles of a sample of the ids chosen by hash (ids of any
type that sorts; ``PER_BUCKET`` sampled ids a bucket, which only place the cuts;
``ROWS`` documents a bucket, so buckets grow in number and not in size), the
texts are shuffled once by bucket, and each bucket also gets a copy of the first
document of the bucket after it.  All that follows (words, counts, draws,
minima) keeps that partitioning: no other shuffle carries texts or terms.  The
words that a text and its edited text share are split and counted once.  The
least a of a document with W words is exponential with rate W, so it lies above
``REACH`` / W with a probability of exp(-``REACH``), 1e-13; a term whose a lies
above that by a bound without logarithms is not drawn to the end (see ``_low``).
A hot source does not matter, as nothing is keyed by it; a long text is spread
over rows.

Results: a null text is an empty one; a text without words has no samples, is
like another such text (1.0) and unlike any other (0.0), and its fingerprint is
zeros; equal ids are ordered by text, a null id comes first; repeated rows get
a row each; the last document's next is the first, a lone document's itself.
Columns besides id and text are not read.  The id keeps its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents a bucket (but four buckets a shuffle partition at least), and sampled ids a bucket.
ROWS = 1 << 16
PER_BUCKET = 64
#: Least a of interest, times the number of words.
REACH = 30.0

_BLANK = " \t\n\x0b\f\r"
#: Thai, Lao, Myanmar, Khmer, Hiragana, Katakana, Han (as ranges, which match faster than names).
_UNSPACED = (r"\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{ff66}-\x{ff9d}"
             r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}")


def _bounds(ids: DataFrame) -> list:
    """Ids that are the first of their bucket, ascending; the first bucket, where
    the null ids are, has none."""
    least = 4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, ids.count() // ROWS)
    sample = (ids.filter("id is not null").select("id", F.xxhash64("id").alias("_h"))
                 .orderBy("_h").limit(PER_BUCKET * buckets).orderBy("id"))
    found = [r["id"] for r in sample.select("id").collect()]
    cuts = [found[i * len(found) // buckets] for i in range(1, buckets)] if found else []
    return [x for x, before in zip(cuts, found[:1] + cuts) if x != before]


def _bucket(bounds: list, dtype) -> Column:
    """Number of bounds up to the id, by binary search in the literal."""
    if not bounds:
        return F.lit(0)
    # The id travels in the state: a lambda that names a column of the table stops
    # the optimizer's constraints over a union.
    literal = lambda: F.array(*[F.lit(x).cast(dtype) for x in bounds])
    found = F.aggregate(
        F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)]),
        F.struct(F.lit(0).alias("at"), F.col("id").alias("id")),
        lambda x, step: F.struct(F.when(F.try_element_at(literal(), x["at"] + step) <= x["id"], x["at"] + step)
                                  .otherwise(x["at"]).alias("at"), x["id"].alias("id")),
        lambda x: x["at"])
    return F.coalesce(found, F.lit(0))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, place, copy, id, t, next_t): each text with the next one in
    ascending id order.  ``copy`` marks the first of the next bucket, put last."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    bounds = _bounds(rows.select("id"))
    rows = rows.withColumn("bucket", _bucket(bounds, rows.schema["id"].dataType))
    n = len(bounds) + 1
    # The first id of each bucket after the first is its bound; of the first, the lowest.
    low = rows.select("id").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).alias("low")).first()["low"]
    lowest = low["id"] if low else None
    heads = rows.filter(F.col("id").isin(bounds + ([lowest] if lowest is not None else []))
                        | (F.lit(lowest is None) & F.col("id").isNull()))
    heads = (heads.groupBy("bucket").agg(F.min(F.struct("id", "t")).alias("h"))
                  .select(F.pmod(F.col("bucket") - 1 + n, F.lit(n)).alias("bucket"), F.lit(True).alias("copy"), "h.id", "h.t"))
    data = rows.select("bucket", F.lit(False).alias("copy"), "id", "t").unionByName(heads)
    w = Window.partitionBy("bucket").orderBy("copy", F.col("id").asc_nulls_first(), "t")
    return data.select("bucket", F.row_number().over(w).alias("place"), "copy", "id", "t",
                       F.lead("t").over(w).alias("next_t"))


def edited(t: Column, next_t: Column) -> Column:
    """The text whose last quarter of code points is replaced by the first as
    many (or all) of the next text."""
    quarter = F.floor(F.length(t) / 4).cast("int")
    return F.concat(F.substring(t, F.lit(1), F.length(t) - quarter), F.substring(next_t, F.lit(1), quarter))


def _uniforms(term: Column, k: Column) -> dict[str, Column]:
    """u (of c), v (of r) and b of a term's k-th sample: u and v are products of
    two uniform numbers, whose negative logarithm is Gamma(2, 1)."""
    one, two = F.xxhash64(term, k), F.xxhash64(k, term)
    unit = lambda bits, width: (bits.cast("double") + 0.5) / float(1 << width)
    low32, low24 = F.lit((1 << 32) - 1), F.lit((1 << 24) - 1)
    return {"v": unit(one.bitwiseAND(low32), 32) * unit(F.shiftrightunsigned(one, 32), 32),
            "u": unit(two.bitwiseAND(low24), 24) * unit(F.shiftrightunsigned(two, 24).bitwiseAND(low24), 24),
            "b": unit(F.shiftrightunsigned(two, 48), 16)}


def _low() -> Column:
    """A lower bound of a for weights up to ``most``.  c = -ln u >= 1 - u; as
    r (t - b) <= ln w, a >= c v / w; at w = 1, t = 0 and a = c v^(1 - b), which is
    not less than c times the weighted harmonic mean of v and 1."""
    u, v, b, most = F.col("u"), F.col("v"), F.col("b"), F.col("most")
    return (1 - u) * F.when(most == 1, v / (1 - b + b * v)).otherwise(v / most)


def _candidate(ln_w: Column) -> Column:
    """One long that orders as a and carries the sample's 32 bits below it."""
    r, ln_c, b = F.col("r"), F.col("ln_c"), F.col("b")
    t = F.floor(ln_w / r + b)
    ln_a = ln_c - r * (t - b) - r
    order = F.floor((ln_a + 100.0) * float(1 << 24)).cast("long")     # ln a lies between -90 and 10
    low32 = F.lit((1 << 32) - 1)
    sample = F.col("term").bitwiseXOR(t.cast("long").bitwiseAND(low32) * F.lit(40503)).bitwiseAND(low32)
    return F.shiftleft(order, 32).bitwiseOR(sample)


def _words(text: Column) -> Column:
    """The words of a text, in an array."""
    low = F.lower(text)
    runs = F.regexp_replace(low, f"([{_UNSPACED}])(?=([{_UNSPACED}]{{2}}))", " $1$2 ")
    spaced = F.when((F.octet_length(low) > F.length(low)) & low.rlike(f"[{_UNSPACED}]"), runs).otherwise(low)
    for blank in _BLANK[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _parts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reach, one, two, words): the words that text and edited text share
    and those that only one of them has, cut apart at a blank."""
    t, quarter = F.col("t"), F.floor(F.length("t") / 4).cast("int")
    cut = placed.withColumn("shared", F.when(F.col("copy"), F.lit("")).otherwise(
        F.regexp_extract(F.substring(t, F.lit(1), F.length(t) - quarter), f"(?s)^(.*[{_BLANK}])", 1)))
    after = lambda text: F.substr(text, F.length("shared") + 1)
    split = cut.select(*keys, _words(F.col("shared")).alias("both"), _words(after(t)).alias("own"),
                       _words(after(F.coalesce("edited_t", F.lit("")))).alias("other"))
    total = lambda only: F.nullif(F.size("both") + F.size(only), F.lit(0))
    part = lambda one, two, words: F.struct(F.lit(one).alias("one"), F.lit(two).alias("two"), F.col(words).alias("words"))
    return (split.select(*keys, (REACH / F.least(total("own"), total("other"))).alias("reach"),
                         F.explode(F.array(part(1, 1, "both"), part(1, 0, "own"), part(0, 1, "other"))).alias("x"))
                 .select(*keys, "reach", "x.*"))


def sample_terms(parts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """(keys, first, second): the samples of two weighted term sets, as arrays
    (null: no terms).  ``parts``: keys, reach, one, two and words that count one
    times for the first set and two times for the second; already partitioned by
    the keys, so nothing is shuffled."""
    # A part without words gives a row without a term, so that each key stays.
    counts = (parts.select(*keys, "reach", "one", "two", F.explode_outer("words").alias("word"))
                   .select(*keys, "reach", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"), "one", "two")
                   .groupBy(*keys, "reach", "term").agg(F.sum("one").alias("n1"), F.sum("two").alias("n2")))
    ln = lambda n: F.when(F.col("term").isNotNull() & (F.col(n) > 0), F.log(F.col(n).cast("double")))
    logs = counts.select(*keys, "reach", "term", ln("n1").alias("w1"), ln("n2").alias("w2"), F.greatest("n1", "n2").alias("most"))
    drawn = logs.select("*", F.explode(F.array(*map(F.lit, range(samples)))).alias("k"))
    drawn = drawn.select("*", *[x.alias(name) for name, x in _uniforms(F.col("term"), F.col("k")).items()])
    drawn = drawn.filter(F.col("term").isNull() | (_low() <= F.col("reach")))
    drawn = drawn.select(*keys, "term", "w1", "w2", "k", "b", (-F.log("v")).alias("r"), F.log(-F.log("u")).alias("ln_c"))
    low32 = F.lit((1 << 32) - 1)
    least = (drawn.select(*keys, "k", _candidate(F.col("w1")).alias("c1"), _candidate(F.col("w2")).alias("c2"))
                  .groupBy(*keys, "k").agg(F.min("c1").alias("first"), F.min("c2").alias("second")))

    def whole(c: str) -> Column:
        found = F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("k", F.col(c).bitwiseAND(low32).alias("v")))))
        # The map is bound once, not once for each sample.
        values = F.transform(F.array(found), lambda m: F.transform(F.array(*map(F.lit, range(samples))), lambda k: F.coalesce(
            F.try_element_at(m, k), F.lit(0).cast("long"))))
        return F.when(F.count(c) > 0, F.get(values, F.lit(0)))

    return least.groupBy(*keys).agg(whole("first").alias("first"), whole("second").alias("second"))


def _string(samples: Column, n: int) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
                      F.lit("0" * 8 * n))


def _share(a: Column, b: Column) -> Column:
    """Share of equal samples; null samples are those of a text without words."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(equal / F.size(a))


def fingerprint(docs: DataFrame, samples: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (see ``edited``; likeness as the share of equal
    samples)."""
    keys = ["bucket", "place"]
    placed = (with_next(docs, id_col, text_col)
              .withColumn("edited_t", F.when(~F.col("copy"), edited(F.col("t"), F.col("next_t")))))
    prints = (sample_terms(_parts(placed, keys), keys, samples)
              .select(*keys, F.col("first").alias("own"), F.col("second").alias("other")))
    facts = placed.select(*keys, "copy", "id", F.length("t").cast("long").alias("n_chars"),
                          F.sha2("edited_t", 256).alias("edited_sha256"))
    w = Window.partitionBy("bucket").orderBy("place")
    # Both sides come from one shuffle of the texts.
    joined = (facts.join(prints, keys)
                   .withColumn("next_own", F.lead("own").over(w)))
    return (joined.filter(~F.col("copy")).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        _string(F.col("own"), samples).alias("fingerprint"), _string(F.col("other"), samples).alias("edited_fingerprint"),
        _share(F.col("own"), F.col("other")).alias("near_edited"),
        _share(F.col("own"), F.col("next_own")).alias("near_next")))
