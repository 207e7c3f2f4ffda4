"""Exact n-gram Jaccard join by a token-group matrix, and its components.

A document's tokens are its distinct word shingles (64-bit hashes).  Documents
with equal sets are one *class*.  Classes are put into groups of similar ones;
the matrix holds each group's token union; a query class is compared with the
members of a group only if its overlap with the union could reach the threshold
(a link needs at least threshold * |query| shared tokens).

1. Statistics.  How often each of 2^``sketch_bits`` token buckets occurs, over
   all documents: tasks count, a streamed sum per block of buckets follows.
   The table's size is fixed.  It only orders tokens (rare first), so its
   collisions cost time, never a link.
2. Signatures: per document its class, some min-hashes, a *histogram* (how many
   tokens fall on each of about n places) and its *prefix*: two sets with
   Jaccard >= t share one of their first |x| - ceil(t |x|) + 1 tokens in any
   common order.
3. Groups.  Classes with an equal min-hash are compared with one pivot class of
   theirs (a large family is one star, never all its pairs); the components of
   the links found are provisional.  The classes of a min-hash, in blocks of at
   most ``block``, are the matrix's groups.
4. Matrix.  Prefix tokens that occur in more than one component are the
   matrix's entries (token, group).  A class queries the groups with which it
   shares one and that hold a *larger* component than its own; a single link is
   enough to join two components, so members of one are never compared again.
   Two sets share nothing before their first common token, so at place i of n
   and j of m they share n - i and m - j tokens at most; a token is left where
   that is too few for a link.  A class with many tokens of its own, which come
   first, so queries little of a family around it.
5. Opening.  Queries go to the groups' members, bounded blocks in streamed
   order; a group with many queries is dealt out with copies of its members.
   First with histograms: minima over the places bound the overlap with the
   group's union and then with a member from above.  Only groups that could
   qualify are opened with the whole sets, where the union's overlap is the
   bound again.

Whole sets are made only for the classes that step needs, by one more scan that
skips other texts by a fixed-size bit table of ids; texts are never shuffled.
No link between different sets is lost, and none is dropped for size.

Results: null, empty or blank texts have no tokens and link with nothing; a
text with fewer words than ``words`` is one token; texts are read whole;
repeated rows (equal ids) are members of the same component; a null id is a
member of no link and gets the component of its class, if ids have it; an empty
table gives no rows.  Two different tokens or sets are taken for equal with a
probability of 2^-64 each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import wordbpe as wb
from weft.llm.components import connected_components
from weft.session import scratch_path

_P = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = 64
#: Bytes of text whose words are held in memory together.
_SLICE = 2 << 20
#: Columns of the min-hashes.  Each gives a class one more pivot to be compared
#: with; the first one also makes the matrix's groups.
_MIN_HASHES = ("h1", "h2", "h3", "h4")


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes (uint64) of its word shingles."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = np.asarray(split.offsets, np.int64)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if not distinct:
        return [np.zeros(0, np.uint64)] * len(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    index = np.asarray(coded.indices)
    real = np.array([bool(w) for w in distinct])[index]
    h = hashed[index][real]
    before = np.concatenate([[0], np.cumsum(real)])
    at = before[offsets - offsets[0]]
    out: list[np.ndarray] = []
    n = len(h) - words + 1
    rolled = np.zeros(0, np.uint64)
    if n > 0:
        rolled = h[:n].copy()
        for k in range(1, words):
            rolled = rolled * _P + h[k:n + k]
        rolled = _finish(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = np.uint64((int(one) * int(_P) + int(x)) & (1 << 64) - 1)
            out.append(_finish(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _need(n: int, percent: int) -> int:
    """Least number of shared tokens of a set of n with a set that links to it."""
    return -(-n * percent // 100)


def _written(df: DataFrame, name: str = "jaccard") -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sets(batches, words):
    for batch in batches:
        texts = wb.text_array(batch.column(1))
        for a, n in wb.slices(texts, _SLICE):
            yield batch.column(0).slice(a, n), shingles(texts.slice(a, n), words)


def token_sketch(rows: DataFrame, words: int, bits: int) -> np.ndarray:
    """Documents that hold a token of each bucket, over all documents."""
    size = (1 << bits) // _BLOCKS

    def count(batches):
        seen = np.zeros(1 << bits, np.int32)
        for _, sets in _sets(batches, words):
            seen += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
        if seen.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_BLOCKS), pa.int32()), pa.array([seen[k * size:(k + 1) * size].tobytes() for k in range(_BLOCKS)], pa.binary())],
                names=["block", "seen"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(raw.as_buffer(), raw_types[len(raw.as_buffer()) // size])
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                             names=["block", "seen"])

    raw_types = {4: np.int32, 8: np.int64}
    schema = "block int, seen binary"
    parts = rows.mapInArrow(wb.trimmed(count), schema).repartition(_BLOCKS, "block").mapInArrow(wb.trimmed(add), schema)
    total = np.zeros(1 << bits, np.int64)
    for r in parts.collect():                      # fixed size: 8 * 2^bits bytes
        total[r.block * size:(r.block + 1) * size] = np.frombuffer(r.seen, np.int64)
    return total


def histogram(s: np.ndarray) -> np.ndarray:
    """How many tokens fall on each of 2^floor(log2 n) places, 16 at least."""
    places = 1 << max(4, len(s).bit_length() - 1)
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) & places - 1, minlength=places), 255).astype(np.uint8)


def could_share(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the tokens that sets with these histograms share."""
    places = min(len(a), len(b))
    a, b = (x.reshape(-1, places).sum(axis=0, dtype=np.int64) if len(x) > places else x for x in (a, b))
    return int(np.minimum(a, b).sum(dtype=np.int64)) if max(a.max(), b.max()) < 255 else 1 << 62


def _signatures(rows: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """(id, n, c, min-hashes, hist, prefix) of every document; c: its class."""
    sketch = np.minimum(token_sketch(rows, words, bits), 2**32 - 1).astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(sketch)       # 4 * 2^bits bytes

    def run(batches):
        sketch = shared.value
        for ids, sets in _sets(batches, words):
            n = [len(s) for s in sets]
            c, mins, hist, prefix = [], [[] for _ in _MIN_HASHES], [], []
            for s in sets:
                if not len(s):
                    for column in (c, *mins, hist):
                        column.append(None)
                    prefix.append(s)
                    continue
                c.append(_class(s))
                for k, column in enumerate(mins):
                    column.append(int(_finish(s + np.uint64(k) * _P).min().view(np.int64)))
                hist.append(histogram(s).tobytes())
                order = np.argsort(sketch[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                prefix.append(s[order[:len(s) - _need(len(s), percent) + 1]])
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in (c, *mins)), pa.array(hist, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(prefix).view(np.int64)))], names=names)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n long, c long, {', '.join(f'{h} long' for h in _MIN_HASHES)}, hist binary, prefix array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(wb.trimmed(run), schema)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Group:
    """The members held of one group, with whole sets or with histograms."""

    def __init__(self, percent: int, exact: bool):
        self.percent, self.exact, self.members, self.union = percent, exact, [], None

    def add(self, c: int, n: int, raw: bytes, size: int, comp: int) -> None:
        self.members.append((c, n, np.frombuffer(raw, np.uint64 if self.exact else np.uint8), size, comp))

    def _bound(self) -> np.ndarray:
        """The union of the sets, or the largest count of each place."""
        if self.union is None:
            if self.exact:
                self.union = np.unique(np.concatenate([m[2] for m in self.members]))
            else:
                places = min(len(m[2]) for m in self.members)
                folded = [np.minimum(s.reshape(-1, places).sum(axis=0, dtype=np.int64), 255) for _, _, s, _, _ in self.members]
                self.union = np.max(folded, axis=0)
        return self.union

    def links(self, c: int, n: int, raw: bytes, size: int, comp: int) -> list[int]:
        """A member of each larger component that links to the query; with
        histograms one member that could."""
        common = _shared if self.exact else could_share
        s = np.frombuffer(raw, np.uint64 if self.exact else np.uint8)
        if len(self.members) > 1 and common(s, self._bound()) < _need(n, self.percent):
            return []
        out, seen = [], {comp}
        for d, m, t, d_size, d_comp in self.members:
            if d_comp in seen or (d_size, -d_comp) < (size, -comp) or min(n, m) * 100 < max(n, m) * self.percent:
                continue
            both = common(s, t)
            if 100 * both >= self.percent * (n + m - both):
                out.append(d)
                seen.add(d_comp)
                if not self.exact:
                    break
        return out


def _probe(members: DataFrame, queries: DataFrame, payload: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(u, v): for each query u of a group a member v of each larger component
    that links to it.

    members, queries: (g, c, size, comp); payload: (c, n, s).  Rows come sorted by group,
    members first; a group's members are held (bounded), its queries streamed."""
    rows = (members.select("g", F.lit(0).alias("role"), "c", "size", "comp")
                   .unionAll(queries.select("g", F.lit(1).alias("role"), "c", "size", "comp"))
                   .join(payload.select("c", "n", "s"), "c").select("g", "role", "c", "n", "size", "comp", "s")
                   .repartition("g").sortWithinPartitions("g", "role", "c"))

    def run(batches):
        group, held = None, None
        for batch in batches:
            u, v = [], []
            for g, role, c, n, size, comp, raw in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if held is None or g != group:
                    group, held = g, _Group(percent, exact)
                if role == 0:
                    held.add(c, n, raw, size, comp)
                elif held.members:
                    for d in held.links(c, n, raw, size, comp):
                        u.append(c)
                        v.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(wb.trimmed(run), "u long, v long")


def _open(rows: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, bits: int = 21) -> DataFrame:
    """(c, n, s): the whole sets of the wanted classes (column c), made from the
    text of one document each.  A table of 2^bits bits of hashed ids passes over
    other texts; what it lets through by chance is taken out by the class."""
    spark = rows.sparkSession
    reps = _written(wanted.select("c").distinct().join(classes.select("c", "rep"), "c"))
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))")
    marks = (reps.select(F.col("rep").alias("id")).select(F.shiftright(place, 6).alias("word"), bit.alias("b"))
                 .groupBy("word").agg(F.bit_or("b").alias("b")))
    table = np.zeros(1 << bits - 6, np.uint64)
    for r in marks.collect():                               # 2^(bits - 6) rows at most
        table[r.word] = np.uint64(r.b & (1 << 64) - 1)
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero(shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            kept = batch.take(pa.array(hit))
            texts = wb.text_array(kept.column(2))
            for a, n in wb.slices(texts, _SLICE):
                sets = shingles(texts.slice(a, n), words)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0).slice(a, n), pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=names)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, c long, n long, s binary"
    names = [x.split()[0] for x in schema.split(", ")]
    made = rows.filter("id is not null").select("id", place.alias("at"), "t").mapInArrow(wb.trimmed(run), schema)
    return _written(made.join(reps.select("c", F.col("rep").alias("id")), ["c", "id"], "left_semi").select("c", "n", "s"))


def _grouped(classes: DataFrame, joined: DataFrame, block: int) -> DataFrame:
    """Classes with their provisional component, its size, and their group: a
    block of the classes with their first min-hash."""
    placed = classes.join(joined, F.col("c") == F.col("node"), "left").select(*classes.columns, F.coalesce("component", "c").alias("comp"))
    size = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    first = _MIN_HASHES[0]
    many = placed.groupBy(first).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    group = F.xxhash64(first, F.pmod(F.xxhash64("c"), F.col("blocks"))).alias("g")
    return _written(placed.join(size, "comp").join(many, first).select("c", "n", "rep", "comp", "size", group))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, sketch_bits: int = 20,
                       block: int = 1024, deal: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the least id reachable over
    links (100 * intersection >= percent * union), its own included."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    signed = _written(_signatures(rows, words, percent, sketch_bits))

    # Classes of equal sets; equal texts anywhere are combined before the shuffle.
    known = signed.filter("c is not null and id is not null")
    classes = _written(known.groupBy("c", "n", *_MIN_HASHES).agg(F.min("id").alias("rep")))
    hists = known.join(classes.select("c", F.col("rep").alias("id")), ["c", "id"], "left_semi").select("c", "n", F.col("hist").alias("s"))

    # Stars: each class and the pivots of its min-hashes.
    stars = None
    for h in _MIN_HASHES:
        pivot = classes.groupBy(h).agg(F.min("c").alias("v"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        star = (classes.join(pivot, h).filter("c != v")
                       .select("c", "v", F.xxhash64("v", F.pmod(F.xxhash64("c"), F.ceil(F.col("k") / deal))).alias("g")))
        stars = star if stars is None else stars.unionAll(star)
    stars = _written(stars)

    def test(pairs: DataFrame, payload: DataFrame, exact: bool) -> DataFrame:
        one, two = F.lit(1).alias("size"), F.lit(2).alias("size")            # the pivot counts as larger
        held = pairs.select("g", F.col("v").alias("c"), two, F.col("v").alias("comp")).distinct()
        return _probe(held, pairs.select("g", "c", one, F.col("c").alias("comp")).distinct(), payload, percent, exact)

    likely = _written(test(stars, hists, False))
    stars = stars.join(likely.select(F.col("u").alias("c"), "v").distinct(), ["c", "v"])
    sets = _open(rows, classes, likely.select(F.col("u").alias("c")).unionAll(likely.select(F.col("v").alias("c"))), words)
    links = _written(test(stars, sets, True))
    classes = _grouped(classes, connected_components(links), block)

    # The matrix: prefix tokens of several components, and the groups that hold them.
    w = Window.partitionBy("token")
    tokens = (known.select(F.posexplode("prefix").alias("at", "token"), "c")
                   .select("token", "at", "c", F.min("c").over(w).alias("low"), F.max("c").over(w).alias("high"))
                   .filter("low != high").select("token", "at", "c").distinct())
    # A link of n and m tokens shares percent * (n + m) / (100 + percent): at the
    # first common one (100 + percent) * (n - at) >= percent * (n + m).
    room = (F.col("n") * 100 - F.col("at") * (100 + percent)).alias("room")
    placed = _written(tokens.join(classes.select("c", "comp", "size", "n", "g"), "c").select("token", "c", "comp", "size", "n", "g", room))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("token")
    placed = placed.join(mixed, "token")
    rank = F.struct("size", F.bitwise_not("comp").alias("x"))
    matrix = placed.groupBy("token", F.col("g").alias("mg")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(rank).alias("top"), F.max("room").alias("widest"))
    near = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent)
    enough = (F.col("room") >= F.col("least") * percent) & (F.col("widest") >= F.col("n") * percent)
    pairs = _written(placed.join(matrix, "token").filter(near & enough & (F.col("top") > rank))
                           .select("c", "size", "comp", F.col("mg").alias("g")).distinct())

    def open_groups(pairs: DataFrame, payload: DataFrame, exact: bool) -> DataFrame:
        load = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / deal).alias("deal"))
        dealt = lambda d: F.xxhash64("g", d).alias("g")
        queries = pairs.join(load, "g").select("c", "size", "comp", dealt(F.pmod(F.xxhash64("c"), F.col("deal"))))
        members = (load.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deal") - 1)))
                       .join(classes.select("c", "size", "comp", "g"), "g").select("c", "size", "comp", dealt(F.col("d"))))
        return _probe(members, queries, payload, percent, exact)

    likely = _written(open_groups(pairs, hists, False))
    hit = likely.join(classes.select(F.col("c").alias("v"), "g"), "v").select(F.col("u").alias("c"), "g").distinct()
    pairs = _written(pairs.join(hit, ["c", "g"], "left_semi"))
    needed = pairs.select("c").unionAll(pairs.select("g").distinct().join(classes.select("c", "g"), "g").select("c"))
    edges = links.unionAll(open_groups(pairs, _open(rows, classes, needed, words), True))
    joined = connected_components(edges)

    # Least id of each component, then every document's.
    labelled = classes.select("c", "rep").join(joined, F.col("c") == F.col("node"), "left").select(
        "c", "rep", F.coalesce("component", "c").alias("k"))
    least = labelled.groupBy("k").agg(F.min("rep").alias("component_id"))
    labels = labelled.join(least, "k").select("c", "component_id")
    return signed.select("id", "n", "c").join(labels, "c", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
