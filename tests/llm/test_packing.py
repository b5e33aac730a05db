import random
import zlib

import numpy as np
import pytest
from gridcast.llm import packing as P


def test_best_fit_matches_a_plain_search():
    rng = random.Random(2)
    for window in (8, 100, 1024):
        lengths = np.array([rng.randint(1, window) for _ in range(700)])
        where, offset = P.best_fit_decreasing(lengths, window)
        free, slow = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(free[k], k) for k in range(len(free)) if free[k] >= lengths[i]]
            if fits:
                room = min(fits)[0]
                free[next(k for f, k in fits if f == room)] -= lengths[i]
            else:
                free.append(window - lengths[i])
        used = np.zeros(where.max() + 1, int)
        for k in range(len(used)):
            own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(where == k))
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
            used[k] = sum(n for _, n in own)
        assert sorted(window - used) == sorted(free)


TEXTS = [None, "", "  two  spaces\n\n\nand lines \n", "naïve façade — “quotes” 10€", "Tibetan བོད and 漢字 emoji 🙂🙂", "has <|endoftext|> inside", "it's we'll 'S x\t\ty\r\n z ", "word " * 3000, "ab cd ef \x1c\x85 g", "x" * 5000, "same", "same"]


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.tokenizer_path())
    rows = [(i, x, 5) for i, x in enumerate(TEXTS)] + [(None, "null id", 1), (3, TEXTS[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = [r.asDict() for r in P.pack(docs, group_rows=5).collect()]
    used = {}
    for i, x in enumerate(TEXTS):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        if i == 3:
            assert own[0] == own[1] and len(own) == 2
            own = own[1:]
        assert sum(n for _, n, _ in own) == len(ids)
        for start, n, crc in own:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
        assert all(r["doc_tokens"] == len(ids) for r in got if r["doc_id"] == i)
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    assert P.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_fast_ids_are_the_tokenizers(spark, sf):
    e, t = P.Encoder(), P.Encoder(P.tokenizer_path())
    assert t.fast is None
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert e(r["text"]) == t(r["text"])


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = P.op8_packing(spark, sf).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == ids
    whole = {}
    for r in rows:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 1024 for own in whole.values())
    assert sum(n for own in whole.values() for _, n in own) > 0.99 * 1024 * (len(whole) - 1)


def test_groups_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i % 5}") for i in range(200)], "doc_id long, text string").coalesce(1)
    group = lambda df: sorted(tuple(r) for r in P.pieces(df, 9).collect())
    assert group(docs) == group(docs.sortWithinPartitions("text", "doc_id")) and len({r[-1] for r in group(docs)}) == 9
