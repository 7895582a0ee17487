"""Quality rules: word statistics, then robust multivariate outliers per language and source.

Everything is DataFrame and SQL functions. One pass over the texts yields integer counts per
document; all later steps read only narrow rows made of them.

Vector: log of mean word length, square roots of the shares of capitals and of marks (neither letter
nor digit) among word characters, log of the share of different words, log of the number of words.
It is transformed per group: less the group's median; times sqrt(n / (n + ``STEADY``)) for n words, as
shares of a short text vary more; over the group's median absolute deviation. A dimension in which
most documents agree is scaled by the root mean square of the others' deviations.

Method: a minimum-covariance-determinant estimate per group by concentration steps. A step takes
the ``ALPHA`` share of a group's documents nearest to the current centre, in Mahalanobis distance,
and re-estimates centre and covariance from them. Steps go on from four deterministic starts (mean
and covariance; median and MAD; tanh scores; spatial signs) until the determinant falls no more, and
the estimate of least determinant is taken. The nearest share is found from counts of distance bins,
so no group is sorted or gathered in one task, and sums are of scaled integers, so they do not depend
on the order of rows. ``FLOOR`` only guards against singular covariances: it is a twentieth of a
dimension's own deviation. Groups are (language, source); sources of a language with under
``MIN_GROUP`` documents are pooled, and if still too few, pooled over languages.

Defined cases: null text is an empty text (no words, fails the base rule); null language or source
is a value of its own; a pool with under ``MIN_GROUP`` documents rejects nothing beyond the base
rule; equal rows get equal verdicts; extra columns of any name are ignored (query) or passed on
(filter); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import guarded, keep_rows, released, table, text_hash, written, ws_words

MIN_WORDS = 50
MIN_GROUP = 60
ALPHA = 0.75
#: Concentration steps between two looks at the determinants.
STEPS = 4
#: Starts of the concentration steps, and the fall of a log determinant that counts as one.
STARTS = 4
FALL = 1e-6
#: Share of a Gaussian group that may be rejected by its distance.
TAIL = 1e-9
#: Transformed statistics are kept as integers of 1/SCALE deviations, raw ones of 1/RAW.
SCALE = 1000
RAW = 10_000
BINS_PER_E = 32
#: Words from which a text's shares vary with its kind rather than its length.
STEADY = 300
#: Least deviation of a dimension beside those before it, in units of its own.
FLOOR = 0.05
#: Broadcast bound: a group's parameters are about 200 bytes.
MAX_BROADCAST_GROUPS = 50_000
DIMS = ("x_len", "x_upper", "x_mark", "x_distinct", "x_size")
P = len(DIMS)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma by its power series."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


#: Makes the covariance of the nearest share consistent for a Gaussian.
CONSISTENCY = ALPHA / chi2_cdf(chi2_quantile(ALPHA, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)


def word_stats(docs: DataFrame) -> DataFrame:
    """Adds ``STATS``, ``n_upper``, ``n_mark`` and ``n_distinct`` to each row, row by row and in linear-log time."""
    df = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_w", ws_words(F.col("_t")))
    df = df.withColumn(
        "_h",
        F.when(
            F.size("_w") >= 3,
            F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))"),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_l", F.expr(rf"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    # Windows in hash order, so that equal ones are neighbours; only texts with a repeat pay for it.
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.expr("array_sort(transform(_h, (h, i) -> struct(h, i)))"),
        ),
    )
    df = df.withColumn(
        "_p",
        F.expr(
            "array_sort(filter(transform(_s, (e, i) -> if(coalesce(e.h = get(_s, i - 1).h, false)"
            " or coalesce(e.h = get(_s, i + 1).h, false), e.i, null)), x -> x is not null))"
        ),
    )
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.expr(
                "coalesce(aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))),"
                " 0L, (a, x) -> a + x), 0L)"
            ),
            "n_upper": (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long"),
            "n_mark": F.length(F.regexp_replace("_t", r"[\p{L}\p{N}\x20\x09-\x0D]+", "")).cast("long"),
            "n_distinct": F.size(F.array_distinct("_w")).cast("long"),
        }
    ).drop("_t", "_w", "_h", "_l", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(df: DataFrame) -> DataFrame:
    """Adds the raw statistics of documents with words; null else."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    raw = {
        "x_len": F.log(chars / n),
        "x_upper": F.sqrt(F.col("n_upper") / chars),
        "x_mark": F.sqrt(F.col("n_mark") / chars),
        "x_distinct": F.log(F.col("n_distinct") / n),
        "x_size": F.log(n),
    }
    return df.withColumns({k: F.when(F.col("n_words") > 0, F.round(x * RAW).cast("long")) for k, x in raw.items()})


def transformed(rows: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` (grp, n_words, raw statistics) with the statistics centred and scaled by group, in 1/SCALE deviations."""
    each = lambda f: [f(i, n) for i, n in enumerate(DIMS)]
    known = rows.where(~base_failed())
    medians = written(known.groupBy("grp").agg(*each(lambda i, n: F.percentile(n, F.lit(0.5)).alias(f"med_{i}"))), "medians")
    steady = F.sqrt(F.col("n_words") / (F.col("n_words") + STEADY))
    centred = lambda df: df.join(guarded(medians, n_groups, MAX_BROADCAST_GROUPS), "grp", "left").withColumns(
        {n: F.round((F.col(n) - F.col(f"med_{i}")) * steady).cast("long") for i, n in enumerate(DIMS)}
    ).drop(*each(lambda i, n: f"med_{i}"))
    scales = centred(known).groupBy("grp").agg(
        *each(lambda i, n: F.percentile(F.abs(n), F.lit(0.5)).alias(f"mad_{i}")),
        *each(lambda i, n: F.sqrt(F.sum(F.col(n) * F.col(n)) / F.nullif(F.count_if(F.col(n) != 0), F.lit(0))).alias(f"rms_{i}")),
    )
    scales = written(
        scales.select("grp", *each(lambda i, n: F.when(F.col(f"mad_{i}") > 0, F.col(f"mad_{i}") * 1.4826).otherwise(F.coalesce(f"rms_{i}", F.lit(1.0))).alias(f"sd_{i}"))),
        "scales",
    )
    out = centred(rows).join(guarded(scales, n_groups, MAX_BROADCAST_GROUPS), "grp", "left")
    return out.withColumns({n: F.round(F.col(n) / F.col(f"sd_{i}") * SCALE).cast("long") for i, n in enumerate(DIMS)}).drop(*each(lambda i, n: f"sd_{i}"))


def _groups(stats: DataFrame) -> DataFrame:
    """(lang, source) -> group id, pooling small ones; a few numbers a group, no document rows."""
    sizes = stats.where(~base_failed()).groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.col("n") >= MIN_GROUP
    by_lang = sizes.withColumn(
        "pool", F.sum(F.when(~own, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    )
    return by_lang.select(
        "lang",
        "source",
        F.when(own, F.xxhash64(F.lit(1), F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))))
        .when(F.col("pool") >= MIN_GROUP, F.xxhash64(F.lit(2), F.coalesce("lang", F.lit("\0"))))
        .otherwise(F.lit(0).cast("long"))
        .alias("grp"),
    )


def _moments() -> list[Column]:
    names = DIMS
    return [F.count("*").alias("m")] + [F.sum(n).alias(f"s_{i}") for i, n in enumerate(names)] + [
        F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}")
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if j <= i
    ]


def _estimate(sums: DataFrame, consistency: float) -> DataFrame:
    """Centre and factored covariance of each grp and start from sums."""
    df = sums.withColumns({f"mu_{i}": F.col(f"s_{i}") / F.col("m") / SCALE for i in range(P)})
    return _factored(
        df.withColumns(
            {
                f"c_{i}_{j}": (F.col(f"s_{i}_{j}") / F.col("m") / SCALE / SCALE - F.col(f"mu_{i}") * F.col(f"mu_{j}")) * consistency
                for i in range(P)
                for j in range(i + 1)
            }
        )
    )


def _factored(df: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance c and its log determinant; a dimension's deviation beside those before it is its floor at least."""
    for i in range(P):
        for j in range(i + 1):
            cov = F.col(f"c_{i}_{j}")
            for k in range(j):
                cov = cov - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(cov, F.lit(FLOOR**2))) if i == j else cov / F.col(f"l_{j}_{j}")
            df = df.withColumn(f"l_{i}_{j}", value)
    log_det = sum((F.log(f"l_{i}_{i}") for i in range(1, P)), F.log("l_0_0")) * 2
    return df.select(
        "grp", "start", *[f"mu_{i}" for i in range(P)], *[f"l_{i}_{j}" for i in range(P) for j in range(i + 1)], log_det.alias("log_det")
    )


def _starts(stats: DataFrame) -> DataFrame:
    """The first estimates of each group, by start. Medians are 0 and deviations 1 already."""
    scored = stats.withColumns({f"_z{i}": F.col(n) / SCALE for i, n in enumerate(DIMS)})
    norm = F.sqrt(sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, P)), F.col("_z0") * F.col("_z0")))
    scored = scored.withColumn("_norm", norm)
    version = lambda start, of: F.struct(F.lit(start).alias("start"), *[of(i, n).cast("long").alias(n) for i, n in enumerate(DIMS)])
    versions = scored.select(
        "grp",
        F.explode(
            F.array(
                version(0, lambda i, n: F.col(n)),
                version(2, lambda i, n: F.round(F.tanh(f"_z{i}") * SCALE)),
                version(3, lambda i, n: F.round(F.coalesce(F.try_divide(F.col(f"_z{i}"), F.col("_norm")), F.lit(0.0)) * SCALE)),
            )
        ).alias("v"),
    ).select("grp", "v.*")
    sums = written(versions.groupBy("grp", "start").agg(*_moments()), "starts")
    # Signs have a mean square of 1 / P a dimension.
    factor = F.when(F.col("start") == 3, float(P)).otherwise(1.0)
    plain = sums.where("start = 0").withColumn("start", F.lit(1))
    robust = sums.where("start > 0").unionByName(plain)
    robust = robust.withColumns({f"mu_{i}": F.lit(0.0) for i in range(P)}).withColumns(
        {
            f"c_{i}_{j}": F.when(F.col("start") == 1, F.lit(1.0 if i == j else 0.0)).otherwise(
                F.col(f"s_{i}_{j}") / F.col("m") / SCALE / SCALE * factor
            )
            for i in range(P)
            for j in range(i + 1)
        }
    )
    return _estimate(sums.where("start = 0"), 1.0).unionByName(_factored(robust))


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i, name in enumerate(DIMS):
        z = F.col(name) / SCALE - F.col(f"mu_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"_z{k}")
        df = df.withColumn(f"_z{i}", z / F.col(f"l_{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, P)), F.col("_z0") * F.col("_z0")))


def fit(stats: DataFrame, n_groups: int) -> DataFrame:
    """MCD parameters of each group; ``stats`` has grp and the transformed vector of documents that pass the base rule."""
    params = written(_starts(stats), "mcd0")
    d_bin = F.greatest(F.lit(-400), F.floor(F.log(F.col("d2") + 1e-9) * BINS_PER_E)).cast("int")
    upto = Window.partitionBy("grp", "start").orderBy("bin")
    whole = Window.partitionBy("grp", "start")
    found = last = None
    step = 0
    while True:
        for _ in range(STEPS):
            step += 1
            near = _distance(stats.join(guarded(params, n_groups * STARTS, MAX_BROADCAST_GROUPS), "grp")).select(
                "grp", "start", *DIMS, d_bin.alias("bin")
            )
            # Sums per distance bin: a few hundred rows a group; the nearest ALPHA share is a prefix of its bins.
            bins = near.groupBy("grp", "start", "bin").agg(*_moments())
            kept = bins.withColumns(
                {"before": F.sum("m").over(upto) - F.col("m"), "all": F.sum("m").over(whole)}
            ).where(F.col("before") < ALPHA * F.col("all"))
            sums = kept.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in bins.columns if c not in ("grp", "start", "bin")])
            params = written(_estimate(sums, CONSISTENCY), f"mcd{step}")
        found = params if found is None else found.unionByName(params)
        if last is not None:
            before = last.select("grp", "start", F.col("log_det").alias("was"))
            params = written(params.join(before, ["grp", "start"]).where(F.col("log_det") < F.col("was") - FALL).drop("was"), f"open{step}")
            if params.isEmpty():
                break
        elif params.isEmpty():
            break
        last = params
    best = Window.partitionBy("grp").orderBy(F.round("log_det", 6), "start", "log_det")
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "start", "log_det")


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, th (text hash), STATS, base_failed, distance2, kept."""
    counts = written(
        _vector(word_stats(docs.select("doc_id", "text", "lang", "source", text_hash().alias("th")))).select(
            "doc_id", "th", "lang", "source", *STATS, *DIMS
        ),
        "counts",
    )
    groups = written(_groups(counts), "groups")
    n_groups = groups.count()
    same = F.col("a.lang").eqNullSafe(F.col("g.lang")) & F.col("a.source").eqNullSafe(F.col("g.source"))
    rows = (
        counts.alias("a")
        .join(guarded(groups, n_groups, MAX_BROADCAST_GROUPS).alias("g"), same, "left")
        .select("a.doc_id", "a.th", *[f"a.{n}" for n in (*STATS, *DIMS)], F.col("g.grp"), base_failed().alias("base_failed"))
    )
    rows = written(transformed(rows, n_groups), "vectors")
    released(counts)
    passed = rows.where(~F.col("base_failed")).select("grp", *DIMS)
    params = fit(passed, n_groups)
    size = passed.groupBy("grp").agg(F.count("*").alias("n_group"))
    params = written(params.join(size, "grp"), "params")
    out = _distance(rows.join(guarded(params, n_groups, MAX_BROADCAST_GROUPS), "grp", "left"))
    outlier = F.coalesce((F.col("d2") > CUTOFF) & (F.col("n_group") >= MIN_GROUP), F.lit(False))
    return out.select(
        "doc_id", "th", *STATS, "base_failed", F.col("d2").alias("distance2"), (~F.col("base_failed") & ~outlier).alias("kept")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept, and the squared distance (null without words)."""
    return verdicts(table(spark, sf_dir, "documents")).drop("th")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the rules, columns unchanged. Equal rows share their verdict."""
    return keep_rows(docs, verdicts(docs).where("kept"), "left_semi")
