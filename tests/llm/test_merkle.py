import hashlib
import random
import zlib

import duckdb
import pytest
from gridcast.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows, arity=3):
    """The contract, row by row, over (doc_id, text, lang, source, n_chars)."""
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(put(r[0]), put(r[3]), put(r[2]), put(r[4]), put(text))

    def climb(leaves):
        """The root, and for each leaf the (place, others) of every level."""
        paths, at, now = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(now) > 1:
            for i, path in enumerate(paths):
                run = now[at[i] // arity * arity : at[i] // arity * arity + arity]
                path.append((at[i] % arity, run[: at[i] % arity] + run[at[i] % arity + 1 :]))
                at[i] //= arity
            now = [sha(*now[i : i + arity]) for i in range(0, len(now), arity)]
        return now[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for g, own in groups.items()}
    trees = {g: climb([leaf(r, r[1]) for r in order[g]]) for g in names}
    if not names:
        return []
    root, above = climb([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        for r, path in zip(order[g], trees[g][1], strict=True):
            path = path + up
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            folded = leaf(r, text)
            for place, others in path:
                folded = sha(*others[:place], folded, *others[place:])
            out.append((r[0], leaf(r, r[1]), trees[g][0], root, sha(*[x for _, others in path for x in others]), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, docs, **how):
    found = M.manifest(spark.createDataFrame(docs, SCHEMA).repartition(3), **how).collect()
    for r in found:
        assert hashlib.sha256(r["proof"].encode()).hexdigest() == r["proof_sha256"]
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in found), key=repr)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    return [(i, rng.choice(["é", "a b\nc", "\n", "", None, "plain " * rng.randint(0, 9)]), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, i])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("how", [{}, {"rows": 60}, {"rows": 45, "arity": 2}, {"rows": 100, "arity": 5}])
def test_equals_trees_built_in_order(spark, how):
    rows = rows_of(1, 700, ["hot"] * 4 + ["a", None, "", "é", "z", "Z"]) + [(7, "one", None, "alone", 1), (None, "x\ny", "en", "hot", 2), (None, None, None, None, None)]
    rows += [rows[0], rows[0], (rows[1][0], "another", "en", rows[1][3], 5)]
    found = got(spark, rows, **how)
    assert found == plain(rows, how.get("arity", 3))
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


def test_many_groups_and_one(spark):
    rows = [(i, f"t{i}\n", "en", f"s{i % 211}", i) for i in range(500)]
    assert got(spark, rows, rows=50) == plain(rows)
    rows = [(i, "same", None, "only", 4) for i in range(244)]
    assert got(spark, rows, rows=20) == plain(rows)
    assert got(spark, [(1, None, None, None, None)]) == plain([(1, None, None, None, None)])
    assert got(spark, []) == []


def test_rounds_meet_where_trees_are_high(spark, monkeypatch):
    monkeypatch.setattr(M, "ROUND", 2)
    rows = rows_of(3, 900, ["hot", "hot", "b"])
    assert got(spark, rows, rows=60) == plain(rows)


def test_subtrees_and_offsets():
    for total in (1, 2, 3, 4, 9, 10, 26, 27, 28, 100):
        leaves = [M.node([str(i).encode()]) for i in range(total)]
        whole = M.subtrees(leaves, 0, total)
        assert len(whole) - 1 == M.height(total) and len(whole[-1][1]) == 1
        for first in range(0, total, 4):
            part = M.subtrees(leaves[first : first + 13], first, total)
            for level, (at, own) in enumerate(part):
                assert own == whole[level][1][at : at + len(own)]
    assert M.offsets([(0, "a", 3, "b", 2, 2), (2, "b", 4, "b", 4, 1), (3, "b", 1, None, 5, 3)]) == {0: (0, 3, 7), 2: (2, 7, 7), 3: (6, 7, 5)}


def test_other_columns_do_not_matter(spark):
    rows = rows_of(5, 60, ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS grp", "2 AS digest", "'x' AS f_text", "3 AS leaf", "4 AS root", "5 AS id")
    assert sorted((r["doc_id"], r["leaf"]) for r in M.manifest(docs).collect()) == sorted((r[0], r[1]) for r in plain(rows))


def test_query_equals_its_sql_and_plain(spark):
    sf = "/root/testdata/sf0.001"
    df = M.op12_merkle(spark, sf)
    found = sorted(map(tuple, df.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found == sorted(con.execute(M.SQL).fetchall(), key=repr)
    assert found == plain([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()])
