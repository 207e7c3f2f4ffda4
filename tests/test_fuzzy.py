"""J7/O3 fuzzy dedup against all-pairs brute force (plain DP LCS)."""

import pandas as pd

from weft.operators import dedup
from tests.conftest import SF001, SF01


def dp_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for ch in a:
        prev = 0
        for j in range(1, len(b) + 1):
            cur = row[j]
            row[j] = prev + 1 if ch == b[j - 1] else max(row[j], row[j - 1])
            prev = cur
    return row[-1]


def brute_removed(rows, t=95):
    """Row r removed iff an earlier row has an identical or >= t similar key."""
    rows = sorted(rows)
    removed = set()
    for i, (ri, si) in enumerate(rows):
        for rj, sj in rows[:i]:
            if si == sj or 200 * dp_lcs(si, sj) >= t * (len(si) + len(sj)):
                removed.add(ri)
                break
    return removed


def _check(spark, rows):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "s"]))
    kept, _ = dedup.fuzzy_dedup(df, "s", "id")
    got = {r.id for r in kept.collect()}
    want = {i for i, _ in rows} - brute_removed(rows)
    assert got == want


def test_lcs_bit_parallel_matches_dp():
    import random
    rnd = random.Random(7)
    for _ in range(500):
        a = "".join(rnd.choice("abé c") for _ in range(rnd.randint(0, 40)))
        b = "".join(rnd.choice("abé c") for _ in range(rnd.randint(0, 40)))
        assert dedup.lcs_length(a, b) == dp_lcs(a, b)
    assert dedup.lcs_length("kitten", "sitting") == 4


def test_edge_strings(spark):
    rows = [(0, ""), (1, ""), (2, "a"), (3, "ab"), (4, "x" * 40), (5, "x" * 41),
            (6, "x" * 38 + "y"), (7, "😀" * 30), (8, "😀" * 29 + "a")]
    _check(spark, rows)


def test_questions_with_near_copies(spark):
    """First turns of sf0.01 plus edited copies (deletions, insertions,
    substitutions) around the 95 threshold."""
    conv = spark.read.parquet(f"{SF01}/conversations.parquet").where("role = 'user'") \
                .orderBy("conv_id", "turn").toPandas()
    firsts = conv.groupby("conv_id").first().reset_index()
    rows = [(int(r.conv_id) * 100, r.text) for r in firsts.itertuples()]
    extra = []
    for k, (i, s) in enumerate(rows[:40]):
        n = max(1, len(s) * (k % 7) // 100)      # 0..6 % edits
        if k % 3 == 0:
            e = s[n:]                              # deletions
        elif k % 3 == 1:
            e = s[: len(s) // 2] + "Z" * n + s[len(s) // 2:]   # insertions
        else:
            e = "".join("Q" if j % max(1, len(s) // n) == 0 else c for j, c in enumerate(s))
        extra.append((i + 1 + (k % 5), e))
        extra.append((i - 1 if k % 2 else i + 9, e))  # some copies come first
    assert len({i for i, _ in rows + extra}) == len(rows + extra)
    _check(spark, rows + extra)


def test_documents_whole_texts(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").toPandas()
    rows = [(int(r.doc_id), r.text) for r in d.itertuples()]
    # brute force on whole texts is quadratic: restrict it to the length band
    rows_sorted = sorted(rows)
    removed = set()
    for i, (ri, si) in enumerate(rows_sorted):
        for rj, sj in rows_sorted[:i]:
            if si == sj:
                removed.add(ri)
                break
            la, lb = len(si), len(sj)
            if 19 * max(la, lb) > 21 * min(la, lb):
                continue
            if 200 * dedup.lcs_length(si, sj) >= 95 * (la + lb):
                removed.add(ri)
                break
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "s"]))
    kept, _ = dedup.fuzzy_dedup(df, "s", "id")
    assert {r.id for r in kept.collect()} == {i for i, _ in rows} - removed
