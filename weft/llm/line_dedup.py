"""Line dedup over shared pairs of lines, in DataFrame functions only.

A text is cut into lines: at line ends, and within a line after each sentence,
so that a passage can be found wherever it stands; a line of over ``LONG`` bytes
is cut further, by its own content (see ``_with_lines``).  Every two neighbouring
lines are a unit, so each shared passage of two lines or more is made of units
that are shared, and no boundary between chunks can miss it; a line of
``min_words`` words is also a unit by itself.  Words stand between blanks; in
scripts without spaces two characters (of Thai, Lao, Khmer or Burmese four)
count as a word.

A unit whose hash occurs more than once in the corpus is a candidate.  The
candidates' bytes are compared (smallest against largest content of the hash,
combined map-side): a hash with different contents is dropped.  Within the
runs of neighbouring repeated units, the fewest lines with ``min_words`` words
from each line on, and up to each line, are a window.  A window that stands in
an earlier place, by id and position, as a whole is removed, and so is a line of
``min_words`` words alone; what remains is byte for byte as it was.  So a shared
passage of that many words goes whole, its first occurrence stays, and text
that is shared only pair by pair with unrelated places stays.  Each line removed
stands in an earlier place, so the first of all equal lines stays.

With a ``divisor`` the units are chunks instead, fewer but with gaps: a rolling
hash over the last two line hashes decides after which lines a chunk ends (about
one in ``divisor``); it starts anew at each line end, and a physical line of
several sentences is always a boundary on both sides.  A run then is one of
neighbouring repeated chunks of at least two lines, and passages inside running
text are found in part only.

Plan.  Rows of the two large steps are one number pair a unit (counting, then
the join with the repeated hashes, where a frequent unit's rows are split by
adaptive execution); texts are shuffled by document only, and contents only of
repeated units, after map-side minima and maxima.  Windows are made of repeated
units only.  The repeated occurrences and the windows are written tables.  Nothing is gathered but a document's own units.

Results: a null or empty text stays as it is; a text of any length is treated
whole; rows with the same id and text count as one occurrence and are treated
alike; a null id comes first; all other columns are kept; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import scratch_path

_CUT = "\x01"
_BLANK = " \t\r\n"

#: Bytes above which a line is cut further: fewer than 50 words have as a rule.
LONG = 200
#: Signs after which long lines are cut, before one is cut at places chosen by hash.
#: None starts with what another one ends with.
_SIGNS = (", ", "; ", ": ", ") ", "] ", *"\t|。！？；，、।۔؟…")
#: Characters of scripts without spaces, by the number of them that make a word.
_UNSPACED = {2: r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}", 4: r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"}


def lines(text: Column) -> Column:
    """Lines and sentences with their ends; joined they are the text."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _CUT))
    cut = F.when(F.contains(text, F.lit(_CUT)), F.split(text, r"(?<=\n)|(?<=[.!?] )")).otherwise(F.split(marked, _CUT))
    return F.filter(cut, lambda x: x != "")


def _by_hash(piece: Column) -> Column:
    """A piece cut where a hash of the three characters before says so: after
    about one space in 5, or without spaces after about one character in 16.
    One that holds the control character used for cutting stays whole."""
    def cut(ends) -> Column:
        def one(chars: Column) -> Column:
            def marked(c: Column, i: Column) -> Column:
                rolled = F.xxhash64(F.get(chars, i - 2), F.get(chars, i - 1), c)
                return F.when(ends(c, rolled), F.concat(c, F.lit(_CUT))).otherwise(c)
            return F.split(F.array_join(F.transform(chars, marked), ""), _CUT)
        # The characters are bound once, not once for each of them.
        return F.flatten(F.transform(F.array(F.split(piece, "")), one))

    return (F.when(F.contains(piece, F.lit(_CUT)), F.array(piece))
             .when(F.contains(F.btrim(piece, F.lit(_BLANK)), F.lit(" ")),
                   cut(lambda c, rolled: (c == " ") & (F.pmod(rolled, F.lit(5)) == 0)))
             .otherwise(cut(lambda c, rolled: F.pmod(rolled, F.lit(16)) == 0)))


def _over(lines_: Column, cut) -> Column:
    """Each line of over ``LONG`` bytes replaced by its parts."""
    is_long = lambda x: F.octet_length(x) > LONG
    return F.when(F.exists(lines_, is_long), F.flatten(F.transform(
        lines_, lambda x: F.when(is_long(x), cut(x)).otherwise(F.array(x))))).otherwise(lines_)


def _at_signs(line: Column) -> Column:
    """A line cut after each sign; marking them is cheaper than looking behind each character."""
    marked = line
    for sign in _SIGNS:
        marked = F.replace(marked, F.lit(sign), F.lit(sign + _CUT))
    behind = "|".join(rf"(?<=\Q{sign}\E)" for sign in _SIGNS)
    return F.when(F.contains(line, F.lit(_CUT)), F.split(line, behind)).otherwise(F.split(marked, _CUT))


def _with_lines(docs: DataFrame) -> DataFrame:
    """Adds _u: the lines of ``_t``, long ones cut further at signs, and what is
    still long at places chosen by a hash.  Whether and where a line is cut
    depends on it alone, so equal lines are cut alike.  Joined they are ``_t``."""
    at_signs = docs.withColumn("_u", lines(F.col("_t"))).withColumn("_u", _over(F.col("_u"), _at_signs))
    return at_signs.withColumn("_u", F.filter(_over(F.col("_u"), _by_hash), lambda x: x != ""))


def _chunked(docs: DataFrame, divisor: int) -> DataFrame:
    """Adds _u (lines), _h (their hashes) and _s (first line of each chunk, and
    last the number of lines) to rows with a text ``_t``."""
    with_lines = docs.withColumn("_u", lines(F.col("_t")))
    hashed = (with_lines.withColumn("_h", F.transform("_u", lambda x: F.xxhash64(F.btrim(x, F.lit(_BLANK)))))
                        .withColumn("_e", F.transform("_u", lambda x: F.endswith(x, F.lit("\n"))))
                        .withColumn("_n", F.size("_u")))

    def boundary(i: Column) -> Column:
        """Whether a chunk starts at line i > 0."""
        at = lambda a, k: F.get(F.col(a), i + k)
        rolled = F.pmod(F.xxhash64(F.when(~at("_e", -2), at("_h", -2)), at("_h", -1)), F.lit(divisor)) == 0
        long_before = at("_e", -1) & (i > 1) & ~F.coalesce(at("_e", -2), F.lit(True))
        long_after = at("_e", -1) & ~at("_e", 0) & (i < F.col("_n") - 1)
        return rolled | long_before | long_after

    inner = F.when(F.col("_n") > 1, F.filter(F.sequence(F.lit(1), F.col("_n") - 1), boundary)).otherwise(F.array().cast("array<int>"))
    return hashed.withColumn("_s", F.concat(F.array(F.lit(0)), inner, F.array("_n"))).drop("_e")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_t"))


def _places(docs: DataFrame, divisor: int) -> DataFrame:
    """(_id, _th, _j, _c): a row for each chunk, with its hash."""
    chunks = _chunked(docs.filter(F.coalesce(F.col("_t"), F.lit("")) != ""), divisor)
    hashes = F.transform(F.sequence(F.lit(0), F.size("_s") - 2), lambda j: F.xxhash64(
        F.slice("_h", F.get("_s", j) + 1, F.get("_s", j + 1) - F.get("_s", j))))
    return chunks.select("_id", "_th", F.posexplode(hashes).alias("_j", "_c"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def removals(docs: DataFrame, divisor: int, min_words: int) -> DataFrame:
    """(_id, _th, cuts): per document with repeated passages the runs of lines
    to remove, as (first line, number of lines)."""
    spark = docs.sparkSession
    places = _places(docs, divisor)
    often = places.groupBy("_c").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_c")
    path = scratch_path(spark, "line-dedup")
    places.join(often, "_c").write.parquet(path)
    repeated = spark.read.parquet(path)

    # The contents of the repeated chunks, from their documents.
    wanted = repeated.groupBy("_id", "_th").agg(F.collect_set(F.struct("_j", "_c")).alias("_w"))
    wanted = wanted.select(F.col("_id").alias("_wid"), F.col("_th").alias("_wth"), "_w")
    joined = docs.join(wanted, docs["_id"].eqNullSafe(wanted["_wid"]) & (docs["_th"] == wanted["_wth"]))
    own = _chunked(joined.select("_id", "_th", "_t", "_w"), divisor)
    each = own.select("_id", "_th", "_u", "_s", F.explode("_w").alias("_x")).select(
        "_id", "_th", F.col("_x._j").alias("_j"), F.col("_x._c").alias("_c"), F.get("_s", F.col("_x._j")).alias("_from"),
        (F.get("_s", F.col("_x._j") + 1) - F.get("_s", F.col("_x._j"))).alias("_lines"),
        "_u")
    each = each.select("_id", "_th", "_j", "_c", "_from", "_lines", F.array_join(F.transform(
        F.slice("_u", F.col("_from") + 1, F.col("_lines")), lambda x: F.btrim(x, F.lit(_BLANK))), "\n").alias("_text"))
    path = scratch_path(spark, "line-dedup")
    first = F.struct("_id", "_th", "_j")
    (each.groupBy("_c").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"), F.min(first).alias("_first"))
         .filter(F.col("_low") == F.col("_high"))
         .select("_c", "_first", F.size(F.split("_low", "[ \n]+")).alias("_words")).write.parquet(path))
    kept = spark.read.parquet(path)

    # Every other occurrence goes if its run of neighbours is long enough.
    later = (repeated.distinct().join(kept, "_c")
             .filter(~(F.col("_first._id").eqNullSafe(F.col("_id")) & (F.col("_first._th") == F.col("_th"))
                       & (F.col("_first._j") == F.col("_j")))))
    w = Window.partitionBy("_id", "_th").orderBy("_j")
    runs = (later.withColumn("_run", F.col("_j") - F.row_number().over(w))
                 .groupBy("_id", "_th", "_run").agg(F.min("_j").alias("_a"), F.max("_j").alias("_b"), F.sum("_words").alias("_words"))
                 .filter(F.col("_words") >= min_words))
    return runs.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("_a", "_b"))).alias("_cuts"))


def _words(line: Column) -> Column:
    """Words of a line: those between blanks, or by characters where that is more."""
    spaced = F.when(line == "", 0).otherwise(F.size(F.split(line, "[ \t]+")))
    unspaced = [F.length(F.regexp_replace(line, f"[^{kind}]", "")) / n for n, kind in _UNSPACED.items()]
    return F.when(_more_bytes(line) <= 4 * spaced, spaced).otherwise(
        F.greatest(spaced, F.ceil(sum(unspaced, F.lit(0))).cast("int")))


def _more_bytes(line: Column) -> Column:
    """Bytes beyond one a character.  A character of a script without spaces has
    two at least and is half a word at most, so a word of them takes four."""
    return F.octet_length(line) - F.length(line)


def _units(docs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, _j, _k, _c): a row for every two neighbouring lines from line
    ``_j`` on (``_k`` = 2) and every line of ``min_words`` words (``_k`` = 1),
    with their hash."""
    own = _with_lines(docs.filter(F.coalesce(F.col("_t"), F.lit("")) != "")).select("_id", "_th", F.transform(
        "_u", lambda x: F.btrim(x, F.lit(_BLANK))).alias("_u"))
    own = own.withColumn("_h", F.transform("_u", lambda x: F.xxhash64(x)))
    unit = lambda i, k, *h: F.struct(i.alias("_j"), F.lit(k).alias("_k"), F.xxhash64(*h).alias("_c"))
    pairs = F.transform(F.slice("_h", F.lit(1), F.size("_h") - 1), lambda x, i: unit(i, 2, x, F.get("_h", i + 1)))
    # Blanks are counted first: few lines are cut into words.
    blanks = lambda x: F.octet_length(x) - F.octet_length(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("\t"), F.lit("")))
    enough = lambda x: (F.when(F.octet_length(x) < 2 * min_words - 1, False)
                         .when((blanks(x) >= min_words - 1) | (_more_bytes(x) > 4 * (min_words - 1)), _words(x) >= min_words).otherwise(False))
    alone = F.filter(F.transform("_u", lambda x, i: F.when(enough(x), unit(i, 1, F.get("_h", i)))), lambda x: x.isNotNull())
    return own.select("_id", "_th", F.inline(F.concat(pairs, alone)))


def shared_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, cuts): per document with repeated passages the runs of lines
    to remove, as (first line, line after the last), in order and disjoint."""
    spark = docs.sparkSession
    units = _units(docs, min_words)
    often = units.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_c")
    path = scratch_path(spark, "line-dedup")
    units.join(often, "_c").write.parquet(path)
    repeated = spark.read.parquet(path)

    # The contents of the repeated units, from their documents.
    wanted = repeated.groupBy("_id", "_th").agg(F.collect_set(F.struct("_j", "_k", "_c")).alias("_w"))
    wanted = wanted.select(F.col("_id").alias("_wid"), F.col("_th").alias("_wth"), "_w")
    joined = docs.join(wanted, docs["_id"].eqNullSafe(wanted["_wid"]) & (docs["_th"] == wanted["_wth"]))
    own = _with_lines(joined.select("_id", "_th", "_w", "_t")).select("_id", "_th", "_w", F.transform("_u", lambda x: F.btrim(x, F.lit(_BLANK))).alias("_u"))
    # A unit's own text leaves its document, never the document's lines beside each unit.
    at = lambda x, k: F.get("_u", x["_j"] + k)
    each = own.select("_id", "_th", F.inline(F.transform("_w", lambda x: F.struct(x["_j"].alias("_j"), x["_c"].alias("_c"), F.when(
        x["_k"] == 1, at(x, 0)).otherwise(F.concat(at(x, 0), F.lit("\n"), at(x, 1))).alias("_text")))))
    path = scratch_path(spark, "line-dedup")
    first = F.struct("_id", "_th", "_j")
    parts = F.split("_low", "\n")
    (each.groupBy("_c").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"), F.min(first).alias("_first"))
         .filter(F.col("_low") == F.col("_high"))
         .select("_c", "_first", _words(F.get(parts, F.lit(0))).alias("_w1"),
                 F.when(F.size(parts) > 1, _words(F.get(parts, F.lit(1)))).otherwise(0).alias("_w2")).write.parquet(path))
    kept = spark.read.parquet(path)

    occurrences = repeated.distinct().join(kept, "_c")
    earlier = F.col("_first._id").eqNullSafe(F.col("_id")) & (F.col("_first._th") == F.col("_th")) & (F.col("_first._j") == F.col("_j"))
    alone = occurrences.filter((F.col("_k") == 1) & ~earlier).select("_id", "_th", F.col("_j").alias("_a"), (F.col("_j") + 1).alias("_b"))
    path = scratch_path(spark, "line-dedup")
    _windows(occurrences.filter("_k = 2"), min_words).write.parquet(path)
    windows = spark.read.parquet(path)

    # A window goes if it stands in an earlier place as a whole.
    place = F.struct("_id", "_th", "_a")
    origin = windows.groupBy("_k1", "_k2").agg(F.min(place).alias("_from"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # Only what has no unit at its first place can stand in an earlier one.
    later = windows.filter("_later").join(origin, ["_k1", "_k2"]).filter(~(
        F.col("_from._id").eqNullSafe(F.col("_id")) & (F.col("_from._th") == F.col("_th")) & (F.col("_from._a") == F.col("_a"))))
    gone = later.select("_id", "_th", "_a", "_b").unionByName(alone)
    w = Window.partitionBy("_id", "_th").orderBy("_a", "_b")
    end = F.coalesce(F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = (gone.withColumn("_fresh", (end <= F.col("_a")).cast("int")).withColumn("_run", F.sum("_fresh").over(w))
                .groupBy("_id", "_th", "_run").agg(F.min("_a").alias("a"), F.max("_b").alias("b")))
    return runs.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_cuts"))


def _windows(pairs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, _a, _b, _k1, _k2, _later): in each run of repeated pairs, from each
    line on and up to each line, the fewest lines with ``min_words`` words.

    ``_k1`` and ``_k2`` are two hashes, 128 bits, of the pairs' hashes, whose bytes have
    been compared; ``_later`` says that no pair is at its first place."""
    w = Window.partitionBy("_id", "_th").orderBy("_j")
    first = F.col("_first._id").eqNullSafe(F.col("_id")) & (F.col("_first._th") == F.col("_th")) & (F.col("_first._j") == F.col("_j"))
    # Words up to the end of a pair and up to its start; first places up to a pair.
    marked = (pairs.withColumn("_run", F.col("_j") - F.row_number().over(w)).withColumn("_to", F.sum("_w2").over(w))
                   .withColumn("_f", first.cast("int")).withColumn("_fs", F.sum("_f").over(w))
                   .withColumn("_at", F.col("_to") - F.col("_w2") - F.col("_w1")))
    run = marked.groupBy("_id", "_th", "_run").agg(F.sort_array(F.collect_list(F.struct(
        "_j", "_to", "_at", "_c", "_f", "_fs", "_w1", "_w2"))).alias("_p"))
    run = run.select("_id", "_th", F.get("_p", F.lit(0))["_j"].alias("_j0"), F.get("_p", F.lit(0))["_at"].alias("_base"),
                     F.get("_p", F.size("_p") - 1)["_to"].alias("_last"), *[F.col(f"_p.{c}").alias(f"{c}s") for c in ("_to", "_at", "_c", "_f", "_fs", "_w1", "_w2")])
    # The line of each word of a run, so that a window's other end is looked up.
    run = run.filter(F.col("_last") - F.col("_base") >= min_words).withColumn("_line", F.flatten(F.concat(
        F.array(F.array_repeat(F.lit(0), F.get("_w1s", F.lit(0)))), F.transform("_w2s", lambda n, k: F.array_repeat(k + 1, n))))).drop("_w1s", "_w2s")
    # Two rows for a pair: the window from its first line on and the one up to its last.
    each = run.select("*", F.explode(F.sequence(F.lit(0), 2 * F.size("_tos") - 1)).alias("_x"))
    each, on = each.withColumn("_i", F.shiftright("_x", 1)), F.col("_x") % 2 == 0
    line = F.get("_line", (F.when(on, F.get("_ats", F.col("_i")) + (min_words - 1)).otherwise(F.get("_tos", F.col("_i")) - min_words)
                           - F.col("_base")).cast("int"))
    each = (each.withColumn("_l", line).filter(F.col("_l").isNotNull())
                .withColumn("_from", F.when(on, F.col("_i")).otherwise(F.least("_l", "_i")))
                .withColumn("_until", F.when(on, F.greatest(F.col("_l") - 1, F.col("_i"))).otherwise(F.col("_i"))))
    # A window up to a line is left out where one of the same lines is found from its first line on.
    fresh = (F.col("_until") > F.col("_from")) & (F.get("_tos", F.col("_i") - 1) >= F.get("_ats", F.col("_from")) + min_words)
    each = each.filter(on | fresh).withColumn("_key", F.slice("_cs", F.col("_from") + 1, F.col("_until") - F.col("_from") + 1))
    at = lambda c, k: F.get(F.col(c), F.col(k))
    return each.select("_id", "_th", (F.col("_j0") + F.col("_from")).alias("_a"), (F.col("_j0") + F.col("_until") + 2).alias("_b"),
                       F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(min_words), "_key").alias("_k2"),
                       (at("_fss", "_until") == at("_fss", "_from") - at("_fs", "_from")).alias("_later"))


def line_dedup(docs: DataFrame, divisor: int | None = None, min_words: int = 25,
               id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` without repeated passages; ``removed_col`` adds the number of
    lines removed."""
    keyed = _keyed(docs, id_col, text_col)
    found = shared_runs(keyed, min_words) if divisor is None else removals(keyed, divisor, min_words)
    cuts = found.select(F.col("_id").alias("_rid"), F.col("_th").alias("_rth"), "_cuts")
    base = docs.withColumns({"_id": F.col(id_col), "_th": F.xxhash64(text_col)})
    joined = base.join(cuts, base["_id"].eqNullSafe(cuts["_rid"]) & (base["_th"] == cuts["_rth"]), "left").drop("_rid", "_rth")
    # A document without cuts isn't cut into lines at all.
    work = joined.withColumn("_t", F.when(F.col("_cuts").isNotNull(), F.col(text_col)))
    if divisor is None:
        work = _with_lines(work).withColumn("_n", F.size("_u"))
    else:
        work = _chunked(work, divisor)
        # Runs of at least two lines, as lines: (first, end).
        work = work.withColumn("_cuts", F.filter(
            F.transform("_cuts", lambda c: F.struct(F.get("_s", c["_a"]).alias("a"), F.get("_s", c["_b"] + 1).alias("b"))),
            lambda r: r["b"] - r["a"] >= 2))
    m = F.size("_cuts")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), m), lambda k: F.slice(
        F.col("_u"),
        F.coalesce(F.get("_cuts", k - 1)["b"], F.lit(0)) + 1,
        F.coalesce(F.get("_cuts", k)["a"], F.col("_n")) - F.coalesce(F.get("_cuts", k - 1)["b"], F.lit(0)))))
    out = {text_col: F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))}
    if removed_col:
        out[removed_col] = F.coalesce(F.aggregate("_cuts", F.lit(0), lambda s, r: s + r["b"] - r["a"]), F.lit(0))
    return work.withColumns(out).drop("_id", "_th", "_t", "_u", "_h", "_n", "_s", "_cuts")
