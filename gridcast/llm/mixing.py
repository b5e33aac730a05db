"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of (source, language, topic) by tokens. The cells' weights are raked: each
marginal in turn is scaled to its target until all hold to ``SETTLED`` (``SETTLED_TABLE`` where it is distributed; or ``ROUNDS`` are over, where targets contradict the cells), which keeps
the interactions of the corpus. A cell's multiplier is its raked over its observed weight; documents are kept with a probability proportional to it.
No document is taken twice, so cells whose chance would pass one are taken whole, which is all that can be had of them: the more is kept, the
more such cells there are and the farther the sample is from the targets. By default the most is kept at which every
expected share is within ``TOLERANCE`` of its raked one, in proportion; with ``rate`` that share of the tokens is kept instead, whatever it does to
the targets. ``shares`` reports target and expected share of every source, language and topic. Whether a document is kept depends on its id and the seed alone.

Targets are given as shares for each marginal, or made from the corpus by a temperature: shares to the power
``ALPHA``, which damps a source that holds a third of all rows and lifts small ones. Tokens are runs of
non-space; the topic is the text's form (``TOPIC``), as documents carry no other: a caller whose documents do gives it by ``topic_of``.

The cell table is an aggregate. Up to ``DRIVER_CELLS`` cells are raked on the driver and come back as a broadcast; more are
raked as a distributed table, with the same result.

Results: null sources and languages count as empty strings, null and empty texts as topic ``empty`` without tokens (cells
without tokens have the multiplier 1). Very long texts are read whole. Rows that agree in id share their fate; a null id is an id. An empty table gives an
empty result. ``sample`` keeps all columns, whatever their names; ``weigh`` replaces columns named as those it adds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, materialize, private, table, uniform

ALPHA = 0.7
ROUNDS = 200
SETTLED = 1e-14
SETTLED_TABLE = 1e-9  # of a distributed cell table, whose rounds are jobs
TOLERANCE = 0.01
DOUBLINGS, HALVINGS = 40, 60
SEED = 17
DRIVER_CELLS = 100_000
DIMS = ("_source", "_lang", "_topic")
MARKS = "0123456789|*%&$#@{}<>=_"


def tokens(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\r\n]+")), F.lit(0)).cast("long")


def topic(text: F.Column) -> F.Column:
    """``empty``, ``symbols`` (a twentieth of the characters or more are marks), ``lists`` (lines under 80 characters) or ``prose``."""
    n = F.length(text)
    marks = n - F.length(F.translate(text, MARKS, ""))
    lines = n - F.length(F.translate(text, "\n", "")) + 1
    return F.when(text.isNull() | (n == 0), "empty").when(marks * 20 >= n, "symbols").when(lines * 80 > n, "lists").otherwise("prose")


def keyed(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of=topic) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.withColumns({"_tokens": tokens(text), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "_topic": topic_of(text)})


def _shares(sums: dict, target: dict | None, alpha: float) -> dict:
    if target is None:
        target = {k: v**alpha for k, v in sums.items() if v > 0}
    live = {k: float(target.get(k, 0.0)) for k, v in sums.items() if v > 0}
    total = sum(live.values())
    return {k: v / total for k, v in live.items()} if total else {}


def rake(cells: list[tuple], weight: list[float], targets: dict[str, dict] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS) -> list[float]:
    """Raked weights of cells (source, language, topic); targets by dimension name. Values without tokens get none."""
    observed = np.asarray(weight, float)
    total = observed.sum()
    w = observed.copy()
    marginals = []
    for d, name in enumerate(DIMS):
        values = sorted({c[d] for c in cells})
        place = {v: i for i, v in enumerate(values)}
        at = np.array([place[c[d]] for c in cells], np.int64)
        sums = np.bincount(at, observed, len(values))
        share = _shares(dict(zip(values, sums.tolist(), strict=True)), (targets or {}).get(name.lstrip("_")), alpha)
        marginals.append((at, np.array([share.get(v, 0.0) for v in values]) * total))
    for _ in range(rounds):
        worst = 0.0
        for at, want in marginals:
            have = np.bincount(at, w, len(want))
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            worst = max(worst, np.abs(factor[have > 0] - 1).max(initial=0.0))
            w = w * factor[at]
        if worst <= SETTLED:
            break
    return w.tolist()


def calibrate(tokens_: list[float], multiplier: list[float], rate: float) -> float:
    """The factor s for which min(1, s * multiplier) keeps ``rate`` of the tokens: cells are taken whole from the largest multiplier down."""
    n, m = np.asarray(tokens_, float), np.asarray(multiplier, float)
    order = np.argsort(-m, kind="stable")
    n, m = n[order], m[order]
    whole = np.concatenate(([0.0], np.cumsum(n)[:-1]))
    rest = np.cumsum((n * m)[::-1])[::-1]
    s = np.divide(rate * n.sum() - whole, rest, out=np.full(len(n), np.inf), where=rest > 0)
    fits = np.flatnonzero(s * m <= 1)
    return float(s[fits[0]]) if len(fits) and rate < 1 else 1e300


def _calibrate_distributed(cells: DataFrame, rate: float) -> float:
    """The same over a table of cells (_sum, _m), by bisection on aggregates."""
    total = cells.agg(F.sum("_sum"), F.max("_m")).first()
    if rate >= 1 or not total[0]:
        return 1e300
    lo, hi = 0.0, 1.0
    kept = lambda s: cells.agg(F.sum(F.col("_sum") * F.least(F.lit(1.0), F.lit(s) * F.col("_m")))).first()[0]
    while kept(hi) < rate * total[0] and hi < 1e12:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) < rate * total[0] else (lo, mid)
    return hi


def widest(total: float, most: float, off) -> float:
    """The largest factor found by bisection at which ``off`` (factor) is at most ``TOLERANCE``; ``most`` is the largest multiplier."""
    if not total or not most:
        return 1.0
    lo, hi = 1.0 / most, 2.0 / most
    for _ in range(DOUBLINGS):  # until a factor misses, or all that can be had is had
        if off(hi) > TOLERANCE:
            break
        lo, hi = hi, hi * 2
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if off(mid) <= TOLERANCE else (lo, mid)
    return lo


def fit(cells: list[tuple], tokens_: list[float], multiplier: list[float]) -> float:
    """The factor that keeps the most while min(1, factor * multiplier) leaves each marginal's shares within ``TOLERANCE`` of the raked ones."""
    n, m = np.asarray(tokens_, float), np.asarray(multiplier, float)
    places = [np.unique([c[d] for c in cells], return_inverse=True)[1] for d in range(len(DIMS))]

    def off(s: float) -> float:
        kept, want = n * np.minimum(1.0, s * m), n * m
        worst = 0.0
        for at in places:
            have, due = np.bincount(at, kept) / kept.sum(), np.bincount(at, want) / want.sum()
            worst = max(worst, np.abs(have[due > 0] / due[due > 0] - 1).max())
        return worst

    return widest(n.sum(), m[n > 0].max(initial=0.0), off)


def _fit_distributed(cells: DataFrame) -> float:
    """The same over a table of cells (_source, _lang, _topic, _sum, _m)."""
    total = cells.agg(F.sum("_sum"), F.max(F.when(F.col("_sum") > 0, F.col("_m"))), F.sum(F.col("_sum") * F.col("_m"))).first()
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("v")) for d in DIMS])).alias("at")

    def off(s: float) -> float:
        kept = F.col("_sum") * F.least(F.lit(1.0), F.lit(s) * F.col("_m"))
        by = cells.select(each, kept.alias("k"), (F.col("_sum") * F.col("_m")).alias("w")).groupBy("at").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))
        whole = cells.agg(F.sum(kept)).first()[0]
        return by.filter("w > 0").agg(F.max(F.abs(F.col("k") / whole / (F.col("w") / total[2]) - 1))).first()[0]

    return widest(total[0], total[1], off)


def _rake_distributed(cells: DataFrame, targets: dict[str, dict] | None, alpha: float, rounds: int) -> DataFrame:
    """The same over a table of cells (_source, _lang, _topic, _sum) of any size."""
    total = cells.agg(F.sum("_sum")).first()[0] or 0
    spark = cells.sparkSession
    wants = []
    for name in DIMS:
        have = cells.groupBy(name).agg(F.sum("_sum").alias("_s")).filter("_s > 0")
        given = (targets or {}).get(name.lstrip("_"))
        share = F.pow(F.col("_s").cast("double"), F.lit(alpha)) if given is None else F.coalesce("_given", F.lit(0.0))
        if given is not None:
            have = have.join(spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{name} string, _given double"), name, "left")
        have = have.withColumn("_share", share)
        whole = have.agg(F.sum("_share")).first()[0] or 1.0
        wants.append(checkpoint(have.select(name, (F.col("_share") / whole * float(total)).alias("_want"))))
    now = cells.withColumn("_w", F.col("_sum").cast("double"))
    for _ in range(rounds):
        before = now
        for name, want in zip(DIMS, wants, strict=True):
            have = now.groupBy(name).agg(F.sum("_w").alias("_have")).join(want, name).select(name, F.try_divide("_want", "_have").alias("_f"))
            now = now.join(have, name, "left").withColumn("_w", F.col("_w") * F.coalesce("_f", F.lit(0.0))).drop("_f")
        now = checkpoint(now)
        moved = now.alias("a").join(before.select(*DIMS, F.col("_w").alias("_last")), list(DIMS)).filter("_last > 0").agg(F.max(F.abs(F.col("_w") / F.col("_last") - 1))).first()[0]
        if (moved or 0.0) <= SETTLED_TABLE:
            break
    return now


def weighed_cells(rows: DataFrame, targets: dict[str, dict] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, rate: float | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Of the rows of ``keyed``: a row for each cell with _sum (tokens), _m (multiplier) and _p (chance to stay)."""
    spark = rows.sparkSession
    cells = rows.groupBy(*DIMS).agg(F.sum("_tokens").alias("_sum"))
    held = cells.limit(driver_cells + 1).collect()
    if len(held) <= driver_cells:
        named, sums = [tuple(r[d] for d in DIMS) for r in held], [r["_sum"] for r in held]
        many = [w / n if n else 1.0 for n, w in zip(sums, rake(named, sums, targets, alpha, rounds), strict=True)]
        factor = 1.0 if not held else fit(named, sums, many) if rate is None else calibrate(sums, many, rate)
        out = spark.createDataFrame([(*c, n, m) for c, n, m in zip(named, sums, many, strict=True)], ", ".join(f"{d} string" for d in DIMS) + ", _sum long, _m double")
        out = F.broadcast(out)  # `driver_cells` rows at most
    else:
        raked = _rake_distributed(checkpoint(cells), targets, alpha, rounds)
        out = checkpoint(raked.select(*DIMS, "_sum", F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum").cast("double")).otherwise(1.0).alias("_m")))
        factor = _fit_distributed(out) if rate is None else _calibrate_distributed(out, rate)
    return out.withColumn("_p", F.when(F.col("_m") > 0, F.least(F.lit(1.0), F.col("_m") * F.lit(factor))).otherwise(0.0))


def shares(cells: DataFrame) -> DataFrame:
    """dimension, value, target and expected (shares of the kept tokens) for the cells of ``weighed_cells``."""
    each = F.explode(F.array(*[F.struct(F.lit(d.lstrip("_")).alias("dimension"), F.col(d).alias("value")) for d in DIMS])).alias("at")
    due, kept = F.col("_sum") * F.col("_m"), F.col("_sum") * F.col("_p")
    by = cells.select(each, due.alias("due"), kept.alias("kept")).groupBy("at").agg(F.sum("due").alias("due"), F.sum("kept").alias("kept"))
    total = cells.agg(F.sum(due).alias("all_due"), F.sum(kept).alias("all_kept"))  # one row
    return by.crossJoin(F.broadcast(total)).select("at.dimension", "at.value", F.try_divide("due", "all_due").alias("target"), F.try_divide("kept", "all_kept").alias("expected"))


def _decided(rows: DataFrame, cells: DataFrame, seed: int, id_col: str) -> DataFrame:
    return rows.join(cells.drop("_sum", "_m"), list(DIMS), "left").withColumn("_kept", uniform(seed, id_col) < F.col("_p"))


def weigh(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of=topic, **how) -> DataFrame:
    """``docs`` with ``_tokens``, ``_source``, ``_lang``, ``_topic``, ``_p`` (chance to stay) and ``_kept``; ``how``: see ``weighed_cells``."""
    rows = keyed(docs.drop("_p", "_kept"), text_col, source_col, lang_col, topic_of)
    return _decided(rows, weighed_cells(rows, **how), seed, id_col)


def sample(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of=topic, **how) -> DataFrame:
    """The documents drawn, with their own columns."""
    row = private(docs) + "row"
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *[F.col(c).alias(name) for c, name in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"), (lang_col, "lang"))])
    return weigh(own, seed, topic_of=topic_of, **how).filter("_kept").select(f"{row}.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance and decision for every document, with the target and the expected share of its source, language and topic."""
    docs = table(spark, sf_dir, "documents")
    # Texts are read once: what the cells and the decisions need is a few short columns.
    rows = materialize(keyed(docs).select("doc_id", "_tokens", *DIMS), "mixing", scan=True)
    cells = weighed_cells(rows)
    told = shares(cells)
    for d in DIMS:
        name = d.lstrip("_")
        own = told.filter(F.col("dimension") == name).select(F.col("value").alias(d), F.round("target", 7).alias(f"{name}_target"), F.round("expected", 7).alias(f"{name}_share"))
        cells = cells.join(own, d, "left")
    cells = materialize(cells, "mixing-cells")
    out = _decided(rows, cells, SEED, "doc_id")
    return out.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_p", 7).alias("probability"), F.col("_kept").alias("kept"), *[f"{d.lstrip('_')}_{x}" for d in DIMS for x in ("target", "share")])


def _sql(rounds: int = ROUNDS, alpha: float = ALPHA, seed: int = SEED) -> str:
    """The same in DuckDB: raking and the search for the factor are recursions over the cell table."""
    marks = MARKS.replace("'", "''")
    share = lambda d: f"CASE WHEN n_{d} > 0 THEN pow(n_{d}, {alpha}) ELSE 0 END"
    want = lambda d: f"{share(d)} / (SELECT sum(x) FROM (SELECT DISTINCT {d}, {share(d)} AS x FROM m)) * (SELECT sum(n) FROM c) AS want_{d}"
    scaled = lambda d, of: f"SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * want_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {of}"
    of_own = lambda d: f"SELECT '{d}' AS d, {d} AS v, n, m FROM p"
    told = lambda d: f"(SELECT v, target, share FROM g WHERE d = '{d}') {d}_"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS BIGINT) AS n,
  CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN (length(text) - length(translate(text, '{marks}', ''))) * 20 >= length(text) THEN 'symbols'
       WHEN (length(text) - length(replace(text, chr(10), '')) + 1) * 80 > length(text) THEN 'lists' ELSE 'prose' END AS t FROM documents),
c AS (SELECT s, l, t, CAST(sum(n) AS DOUBLE) AS n FROM d GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY s) AS n_s, sum(n) OVER (PARTITION BY l) AS n_l, sum(n) OVER (PARTITION BY t) AS n_t FROM c),
w0 AS MATERIALIZED (SELECT 0 AS i, s, l, t, n, {want('s')}, {want('l')}, {want('t')}, n AS w FROM m),
r AS (SELECT * FROM w0 UNION ALL SELECT * REPLACE (i + 1 AS i) FROM ({scaled('t', f"({scaled('l', f'({scaled(chr(115), chr(114))})')})")}) WHERE i < {rounds}),
p AS MATERIALIZED (SELECT s, l, t, n, CASE WHEN n > 0 THEN w / n ELSE 1 END AS m FROM r WHERE i = {rounds}),
e AS MATERIALIZED (SELECT d, v, n, m, sum(n * m) OVER (PARTITION BY d) AS whole FROM ({of_own('s')} UNION ALL {of_own('l')} UNION ALL {of_own('t')})),
b AS (SELECT 0 AS i, false AS near, 1.0 / max(m) AS lo, 2.0 / max(m) AS hi FROM p WHERE n > 0
  UNION ALL SELECT i + 1, near OR off > {TOLERANCE} OR i >= {DOUBLINGS - 1},
    CASE WHEN off <= {TOLERANCE} THEN x ELSE lo END, CASE WHEN near THEN CASE WHEN off <= {TOLERANCE} THEN hi ELSE x END WHEN off > {TOLERANCE} THEN hi ELSE hi * 2 END
  FROM (SELECT any_value(i) AS i, any_value(near) AS near, any_value(lo) AS lo, any_value(hi) AS hi, any_value(x) AS x, max(CASE WHEN due > 0 THEN abs(k / all_k / (due / whole) - 1) ELSE 0 END) AS off
    FROM (SELECT *, sum(k) OVER (PARTITION BY d) AS all_k FROM (SELECT d, v, any_value(i) AS i, any_value(near) AS near, any_value(lo) AS lo, any_value(hi) AS hi, any_value(x) AS x, any_value(whole) AS whole,
      sum(n * least(1.0, x * m)) AS k, sum(n * m) AS due FROM e, (SELECT *, CASE WHEN near THEN (lo + hi) / 2 ELSE hi END AS x FROM b WHERE i < {DOUBLINGS + HALVINGS}) GROUP BY d, v))) WHERE i IS NOT NULL),
q AS (SELECT lo AS f FROM b ORDER BY i DESC LIMIT 1),
g AS (SELECT d, v, round(due / sum(due) OVER (PARTITION BY d), 7) AS target, round(k / sum(k) OVER (PARTITION BY d), 7) AS share FROM (SELECT d, v, sum(n * m) AS due, sum(n * least(1.0, f * m)) AS k FROM e, q GROUP BY ALL))
SELECT doc_id, d.t AS topic, d.n AS tokens, round(least(1, m * f), 7) AS probability,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0 < least(1, m * f) AS kept,
  s_.target AS source_target, s_.share AS source_share, l_.target AS lang_target, l_.share AS lang_share, t_.target AS topic_target, t_.share AS topic_share
FROM d JOIN p USING (s, l, t) JOIN {told('s')} ON s_.v = d.s JOIN {told('l')} ON l_.v = d.l JOIN {told('t')} ON t_.v = d.t, q"""


SQL = _sql()
