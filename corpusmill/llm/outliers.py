"""Quality rules: base counts, and robust multivariate outliers by minimum covariance determinant.

DataFrame operations alone. The base counts come from one pass over the texts. The verdict treats five
transformed statistics of a document - mean word length, symbols, repeated words, repeated lines, length - as a point. For
every (language, source) the centre and scatter of the ``share`` of its points with the least determinant are estimated
from three starts: medians with robust scales, mean and covariance of all points, and those of the half that is nearest to
the medians. Each takes two concentration steps, and the one with the least determinant goes on until no determinant
changes any more, ``steps`` steps at most. Points beyond a Mahalanobis cutoff, the 0.999 quantile of chi-square, are rejected.
A step needs two aggregations of a small stored table: a histogram of distances, whose running count gives the threshold
of the tightest share, and the moments of the points within it. Both are partially aggregated, so a source
with a third of all rows costs no more than its share of the scan, and nothing is gathered in one task.

A hundredth of a coordinate's variance over all documents is added to the scatter's diagonal, which keeps it
invertible. Where the tightest points hardly vary in a coordinate - by less than that, as when most documents have no symbols
at all - the estimate says nothing of its scale. Such a coordinate is judged on its own, on the scale of one unit of the
transform, ln 2 / 2: about one symbol in a hundred, a repeated line, a repeated passage.

Cases: null text has no words; documents without words fail the base rules. A null language or
source is a group of its own. Groups with fewer than ``least`` points are judged by the estimate of their language, those
of small languages by that of all documents; if these are fewer than ``least`` too, only the base rules reject. Repeated
rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, let, stored, table, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SHARE = 0.75
#: SHARE / P(chi2 with 7 degrees <= its 5-degree SHARE quantile): undoes the truncation for normal points.
CONSISTENCY = 1.4125
#: Chi-square, 5 degrees of freedom, 0.999 quantile.
CUTOFF = 20.515
#: Variance of a coordinate in which the tightest points do not vary: (ln 2 / 2) squared.
UNIT = 0.12011325347955035
#: Concentration steps of every start, and those of the best at most.
FIRST, STEPS = 2, 8
LEAST = 20
#: Histogram cells a unit, for coordinates and for log distances.
CELLS = 128
DIMS = 5
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more. Windows are compared by 64-bit hash."""

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(m: Column) -> Column:
            twin = lambda x, i: (F.get(m, i - 1)["h"] == x["h"]) | (F.get(m, i + 1)["h"] == x["h"])
            found = F.transform(m, lambda x, i: F.when(F.coalesce(twin(x, i), F.lit(False)), x["p"]))
            return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            reach = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(marked, positions), total)

    def with_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    # F.slice(words, i, window) inside: `words` must be a lambda variable, else it is split anew each time.
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(hashes, with_hashes))


def text_statistics(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    return let(words, of_words)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: The transformed statistics. Fifty words of five characters are added to the mean word length, which
#: steadies it for short texts.
COORDINATES = (
    "ln((word_chars + 250) / (n_words + 50))",
    "ln(1 + 100 * n_symbols / (word_chars + 50))",
    "ln(1 + n_repeat_words / (10 + n_words / 20))",
    "ln(1 + n_dup_lines)",
    "ln(greatest(n_words, 1))",
)
#: A group: its level - 0 for a language and source, 1 for a language, 2 for all - and names, null where they do not count.
GROUP = ["level", "g_lang", "g_source"]
X = [f"x{i}" for i in range(DIMS)]


def _s(i: int, j: int) -> str:
    return f"s{min(i, j)}{max(i, j)}"


def _solved() -> list[str]:
    """Cholesky factor l of the scatter s, its inverse k, the inverse scatter i and the log determinant, each
    expression in terms of those before it."""
    out = []
    for j in range(DIMS):
        out.append(f"sqrt(greatest({' - '.join([_s(j, j), *(f'l{j}{k} * l{j}{k}' for k in range(j))])}, 1e-12)) AS l{j}{j}")
        for i in range(j + 1, DIMS):
            out.append(f"({' - '.join([_s(i, j), *(f'l{i}{k} * l{j}{k}' for k in range(j))])}) / l{j}{j} AS l{i}{j}")
    for j in range(DIMS):
        out.append(f"1 / l{j}{j} AS k{j}{j}")
        for i in range(j + 1, DIMS):
            out.append(f"-({' + '.join(f'l{i}{m} * k{m}{j}' for m in range(j, i))}) / l{i}{i} AS k{i}{j}")
    out += [f"{' + '.join(f'k{m}{i} * k{m}{j}' for m in range(j, DIMS))} AS i{i}{j}" for i, j in PAIRS]
    out.append("2 * (" + " + ".join(f"ln(l{j}{j})" for j in range(DIMS)) + ") AS det")
    return out


ESTIMATE = ["start", "points", *(f"m{i}" for i in range(DIMS)), *(f"v{i}" for i in range(DIMS)), *(_s(i, j) for i, j in PAIRS), *(f"i{i}{j}" for i, j in PAIRS), "det"]
#: Squared Mahalanobis distance of a point from an estimate, and the cell of its logarithm.
DISTANCE = "(" + " + ".join(f"{'' if i == j else '2 * '}(x{i} - m{i}) * (x{j} - m{j}) * i{i}{j}" for i, j in PAIRS) + ")"
CELL = f"CAST(floor(ln(greatest({DISTANCE}, 0) + 1e-9) * {CELLS}) AS BIGINT)"
#: Moments about the last centre, for precision, and what they make.
MOMENTS = [f"avg(x{i} - m{i}) AS a{i}" for i in range(DIMS)] + [f"avg((x{i} - m{i}) * (x{j} - m{j})) AS b{i}{j}" for i, j in PAIRS]
CENTRES = [f"c{i} + a{i} AS m{i}" for i in range(DIMS)]
VARIANCES = [f"(b{i}{i} - a{i} * a{i}) * {CONSISTENCY} AS v{i}" for i in range(DIMS)]
SCATTER = [f"(b{i}{j} - a{i} * a{j}) * {CONSISTENCY}" + (f" + f{i}" if i == j else "") + f" AS {_s(i, j)}" for i, j in PAIRS]
#: Scatter by which points are judged: coordinates that hardly vary stand alone, on the scale of a unit.
JUDGED = [f"CASE WHEN v{i} <= f{i}" + (f" THEN {UNIT} ELSE s{i}{i}" if i == j else f" OR v{j} <= f{j} THEN 0 ELSE s{i}{j}") + f" END AS {_s(i, j)}" for i, j in PAIRS]
#: Variance that is added to each coordinate's.
FLOORS = [f"greatest(var_pop(x{i}) / 100, 1e-9) AS f{i}" for i in range(DIMS)]


def _quantiles(cells: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For each key: the first cell at which the running count reaches each share of the whole.
    ``cells`` has keys, cell, n; a key has as many rows as its values have cells."""
    by = Window.partitionBy(*keys)
    run = cells.withColumn("run", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
    return run.groupBy(*keys).agg(
        *[F.min(F.when(F.col("run") >= F.col("all") * s, F.col("cell"))).alias(name) for name, s in shares.items()],
        F.max("all").alias("points"),
    )


def _with(points: DataFrame, estimate: DataFrame, keys: list[str] = GROUP, how: str = "inner") -> DataFrame:
    e = estimate.toDF(*[f"e_{c}" if c in keys else c for c in estimate.columns])
    on = reduce(lambda a, b: a & b, [points[k].eqNullSafe(e[f"e_{k}"]) for k in keys])
    return points.join(e, on, how).drop(*[f"e_{k}" for k in keys])


def _levels(points: DataFrame) -> DataFrame:
    """Every point in its three groups."""
    none = F.lit(None).cast("string")
    group = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
    lang = F.col("g_lang")
    groups = F.array(group(0, lang, F.col("g_source")), group(1, lang, none), group(2, none, none))
    return points.select(F.explode(groups).alias("g"), *X).select("g.*", *X)


def _solve(frame: DataFrame, floors: DataFrame) -> DataFrame:
    return frame.crossJoin(F.broadcast(floors)).selectExpr("*", *_solved()).select(*GROUP, *ESTIMATE)


def _step(points: DataFrame, estimate: DataFrame, floors: DataFrame, share: float, start: str = "start") -> DataFrame:
    """A concentration step of every estimate: centre and scatter of the ``share`` of points nearest to it."""
    keys = [*GROUP, "start"]
    near = _with(points, estimate).selectExpr(*keys, *X, "points", *(f"m{i}" for i in range(DIMS)), f"{CELL} AS cell")
    limits = _quantiles(near.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")), keys, {"limit": share}).select(*keys, "limit")
    inside = _with(near, stored(limits, "mcd-limit"), keys).filter("cell <= limit")
    moments = inside.groupBy(*keys).agg(F.max("points").alias("points"), *[F.max(f"m{i}").alias(f"c{i}") for i in range(DIMS)], *map(F.expr, MOMENTS))
    made = moments.crossJoin(F.broadcast(floors)).selectExpr(*GROUP, f"{start} AS start", "points", *CENTRES, *VARIANCES, *SCATTER)
    return stored(made.selectExpr("*", *_solved()).select(*GROUP, *ESTIMATE), "mcd")


def _starts(points: DataFrame, floors: DataFrame, share: float) -> DataFrame:
    each = points.select(*GROUP, F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) * CELLS).cast("long").alias("cell")) for i, x in enumerate(X)])).alias("v"))
    cells = each.groupBy(*GROUP, F.col("v.dim").alias("dim"), F.col("v.cell").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    q = _quantiles(cells, [*GROUP, "dim"], {"lo": 0.16, "mid": 0.5, "hi": 0.84})
    pick = lambda i, v: F.max(F.when(F.col("dim") == i, v))
    spread = F.pow((F.col("hi") - F.col("lo")) / (2.0 * CELLS), F.lit(2))
    medians = q.groupBy(*GROUP).agg(
        F.max("points").alias("points"),
        *[pick(i, (F.col("mid") + 0.5) / CELLS).alias(f"m{i}") for i in range(DIMS)],
        *[pick(i, spread).alias(f"v{i}") for i in range(DIMS)],
    )
    diagonal = medians.crossJoin(F.broadcast(floors)).selectExpr(*GROUP, "0 AS start", "points", *(f"m{i}" for i in range(DIMS)), *(f"v{i}" for i in range(DIMS)), *(f"v{i} + f{i} AS s{i}{i}" if i == j else f"0D AS s{i}{j}" for i, j in PAIRS))
    robust = stored(diagonal.selectExpr("*", *_solved()).select(*GROUP, *ESTIMATE), "mcd")
    centred = points.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("points"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[F.expr(f"covar_pop(x{i}, x{j})").alias(f"b{i}{j}") for i, j in PAIRS])
    whole = centred.crossJoin(F.broadcast(floors)).selectExpr(*GROUP, "1 AS start", "points", *(f"m{i}" for i in range(DIMS)), *(f"b{i}{i} AS v{i}" for i in range(DIMS)), *(f"b{i}{j}" + (f" + f{i}" if i == j else "") + f" AS s{i}{j}" for i, j in PAIRS))
    classical = whole.selectExpr("*", *_solved()).select(*GROUP, *ESTIMATE)
    return stored(robust.unionByName(classical).unionByName(_step(points, robust, floors, 0.5, "2")), "mcd-starts")


def floors_of(points: DataFrame) -> DataFrame:
    return stored(points.agg(*[F.coalesce(F.expr(x.rpartition(" AS ")[0]), F.lit(1e-9)).alias(f"f{i}") for i, x in enumerate(FLOORS)]), "mcd-floors")


def mcd_estimates(points: DataFrame, floors: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """The estimate of each group, with the columns GROUP and ESTIMATE. ``points``: GROUP and X."""
    estimate = _starts(points, floors, share)
    for _ in range(FIRST):
        estimate = _step(points, estimate, floors, share)
    best = Window.partitionBy(*GROUP).orderBy("det", "start")
    estimate = stored(estimate.withColumn("turn", F.row_number().over(best)).filter("turn = 1").drop("turn"), "mcd")
    for _ in range(steps):
        after = _step(points, estimate, floors, share)
        before = estimate.select(*GROUP, F.col("det").alias("was"))
        changed = _with(after.select(*GROUP, "det"), before).filter("abs(det - was) > 1e-12").take(1)
        estimate = after
        if not changed:
            break
    return estimate


def judged(estimate: DataFrame, floors: DataFrame) -> DataFrame:
    """The estimates with the scatter by which points are judged, and its inverse."""
    kept = ["points", *(f"m{i}" for i in range(DIMS))]
    made = estimate.crossJoin(F.broadcast(floors)).selectExpr(*GROUP, *kept, *JUDGED)
    return stored(made.selectExpr("*", *_solved()).select(*GROUP, *kept, *(f"i{i}{j}" for i, j in PAIRS)), "judged")


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", share=SHARE, cutoff=CUTOFF, steps=STEPS, least=LEAST) -> DataFrame:
    """One row for each input row: id, the five counts, base_failed, distance (null without an
    estimate) and kept."""
    stats = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("g_lang"), F.col(source_col).cast("string").alias("g_source"), text_statistics(text_of(text_col)).alias("s")
    )
    points = stored(stats.select("id", "g_lang", "g_source", "s.*").selectExpr("*", *(f"{c} AS x{i}" for i, c in enumerate(COORDINATES))), "points")
    usable = points.filter(~base_failed())
    floors = floors_of(usable)
    estimates = judged(mcd_estimates(_levels(usable), floors, share, steps), floors).filter(F.col("points") >= least)
    # The level at which each language and source is judged: the first with points enough.
    names = points.select("g_lang", "g_source").distinct()
    options = reduce(
        lambda a, b: a.unionByName(b),
        [
            _with(names.select(F.lit(k).alias("level"), *(F.col(n).alias(f"o_{n}") for n in ("g_lang", "g_source")), *((F.col(n) if at >= i else F.lit(None).cast("string")).alias(n) for i, n in enumerate(("g_lang", "g_source")))), estimates)
            for k, at in ((0, 1), (1, 0), (2, -1))
        ],
    )
    first = Window.partitionBy("o_g_lang", "o_g_source").orderBy("level")
    chosen = stored(options.withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn", "g_lang", "g_source"), "chosen").withColumnsRenamed({"o_g_lang": "g_lang", "o_g_source": "g_source"})
    placed = _with(points, chosen, ["g_lang", "g_source"], "left").withColumn("distance", F.expr(DISTANCE))
    outlier = F.coalesce(F.col("distance") > cutoff, F.lit(False))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return placed.select("id", *counts, base_failed().alias("base_failed"), "distance", (~base_failed() & ~outlier).alias("kept"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("distance")


def _sql() -> str:
    """The same rules in DuckDB: counts by list functions and windows, the estimate's steps as a chain of CTEs."""
    space = r"[^\x20\x09-\x0D]"
    keys = "level, lang, source, start"

    def solve(inner: str) -> str:
        """``inner`` with the columns of _solved, a subquery for each set of those that need none of the same set."""
        held: list[str] = []
        for e in [*_solved(), ""]:
            made = [x.rpartition(" AS ")[2] for x in held]
            if not e or any(m in e for m in made):
                inner, held = f"SELECT *, {', '.join(held)} FROM ({inner})", []
            held.append(e)
        return inner

    columns = ", ".join(["level", "lang", "source", *ESTIMATE])
    same = lambda a, b: f"{a}.level = {b}.level AND {a}.lang IS NOT DISTINCT FROM {b}.lang AND {a}.source IS NOT DISTINCT FROM {b}.source"
    quantile = lambda share: f"min(cell) FILTER (run >= total * {share})"
    real = lambda x: x.replace("/ (", "/ (0.0::DOUBLE + ")  # noqa: E731  whole numbers divide as doubles
    cells = " UNION ALL ".join(f"SELECT level, lang, source, {i} AS dim, floor(x{i} * {CELLS})::BIGINT AS cell FROM u" for i in range(DIMS))
    names = lambda p: [f"{p}{i}" for i in range(DIMS)]
    medians = ", ".join(f"max((mid + 0.5::DOUBLE) / {CELLS}) FILTER (dim = {i}) AS m{i}, max(power((hi - lo) / {2.0 * CELLS}::DOUBLE, 2)) FILTER (dim = {i}) AS v{i}" for i in range(DIMS))
    diagonal = ", ".join(f"v{i} + f{i} AS s{i}{i}" if i == j else f"0::DOUBLE AS s{i}{j}" for i, j in PAIRS)
    covariance = ", ".join([*(f"avg(x{i}) AS m{i}" for i in range(DIMS)), *(f"covar_pop(x{i}, x{j}) AS b{i}{j}" for i, j in PAIRS)])
    whole = ", ".join([*names("m"), *(f"b{i}{i} AS v{i}" for i in range(DIMS)), *(f"b{i}{j}" + (f" + f{i}" if i == j else "") + f" AS s{i}{j}" for i, j in PAIRS)])
    parts: list[tuple[str, str]] = [
        ("t", "SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents"),
        ("w", f"SELECT *, regexp_extract_all(text, '{space}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{space}')) AS lines FROM t"),
        ("g", f"""SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
          FROM (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w))"""),
        ("r", f"""SELECT doc_id, sum(least({WINDOW}, coalesce(following - i, {WINDOW})))::BIGINT AS n_repeat_words
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM g WHERE n > 1) GROUP BY doc_id"""),
        ("c", f"""SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
          (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - list_unique(lines))::BIGINT AS n_dup_lines,
          coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)"""),
        ("p", f"SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {', '.join(f'{real(c)} AS x{i}' for i, c in enumerate(COORDINATES))} FROM c"),
        ("u", " UNION ALL ".join(f"SELECT {k} AS level, {g} AS source, {', '.join(X)} FROM p WHERE NOT base_failed" for k, g in enumerate(("lang, source", "lang, NULL", "NULL AS lang, NULL")))),
        ("f", f"SELECT {', '.join(FLOORS)} FROM u WHERE level = 0"),
        ("cells", f"SELECT level, lang, source, dim, cell, count(*) AS n FROM ({cells}) GROUP BY ALL"),
        ("runs", "SELECT *, sum(n) OVER (PARTITION BY level, lang, source, dim ORDER BY cell) AS run, sum(n) OVER (PARTITION BY level, lang, source, dim) AS total FROM cells"),
        ("q", f"SELECT level, lang, source, dim, {quantile(0.16)} AS lo, {quantile(0.5)} AS mid, {quantile(0.84)} AS hi, max(total) AS points FROM runs GROUP BY ALL"),
        ("d", f"SELECT level, lang, source, 0 AS start, max(points) AS points, {medians} FROM q GROUP BY level, lang, source"),
        ("a0", f"SELECT {columns} FROM ({solve(f'SELECT *, {diagonal} FROM d, f')})"),
        ("a1", f"SELECT {columns} FROM ({solve(f'SELECT level, lang, source, 1 AS start, points, {whole} FROM (SELECT level, lang, source, count(*) AS points, {covariance} FROM u GROUP BY level, lang, source), f')})"),
    ]

    def step(before: str, after: str, share: float, start: str = "start") -> None:
        point = ", ".join(["u.level", "u.lang", "u.source", "start", "points", *X, *names("m")])
        moved = ", ".join([*CENTRES, *VARIANCES, *SCATTER])
        on = " AND ".join([same("n", "l"), "n.start = l.start"])
        parts.extend([
            (f"n_{after}", f"SELECT {point}, {CELL} AS cell FROM u JOIN {before} e ON {same('u', 'e')}"),
            (f"l_{after}", f"""SELECT {keys}, {quantile(share)} AS most FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY cell) AS run, sum(n) OVER (PARTITION BY {keys}) AS total
              FROM (SELECT {keys}, cell, count(*) AS n FROM n_{after} GROUP BY ALL)) GROUP BY {keys}"""),
            (f"o_{after}", f"SELECT n.level, n.lang, n.source, n.start, max(points) AS points, {', '.join(f'max(m{i}) AS c{i}' for i in range(DIMS))}, {', '.join(MOMENTS)} FROM n_{after} n JOIN l_{after} l ON {on} WHERE cell <= most GROUP BY n.level, n.lang, n.source, n.start"),
            (after, f"SELECT {columns} FROM ({solve(f'SELECT level, lang, source, {start} AS start, points, {moved} FROM o_{after}, f')})"),
        ])

    step("a0", "a2", 0.5, "2")
    parts.append(("b0", f"SELECT {columns} FROM a0 UNION ALL SELECT {columns} FROM a1 UNION ALL SELECT {columns} FROM a2"))
    for k in range(FIRST):
        step(f"b{k}", f"b{k + 1}", SHARE)
    parts.append(("e0", f"SELECT {columns} FROM b{FIRST} QUALIFY row_number() OVER (PARTITION BY level, lang, source ORDER BY det, start) = 1"))
    for k in range(STEPS):
        step(f"e{k}", f"e{k + 1}", SHARE)
    first = lambda c: f"CASE WHEN z0.points IS NOT NULL THEN z0.{c} WHEN z1.points IS NOT NULL THEN z1.{c} ELSE z2.{c} END AS {c}"
    parts += [
        ("j", f"SELECT level, lang, source, points, {', '.join([*names('m'), *(f'i{i}{j}' for i, j in PAIRS)])} FROM ({solve(f"SELECT level, lang, source, points, {', '.join([*names('m'), *JUDGED])} FROM e{STEPS}, f")}) WHERE points >= {LEAST}"),
        ("k", f"""SELECT g.lang, g.source, {', '.join(map(first, [*names('m'), *(f'i{i}{j}' for i, j in PAIRS)]))} FROM (SELECT DISTINCT lang, source FROM p) g
          LEFT JOIN (SELECT * FROM j WHERE level = 0) z0 ON z0.lang IS NOT DISTINCT FROM g.lang AND z0.source IS NOT DISTINCT FROM g.source
          LEFT JOIN (SELECT * FROM j WHERE level = 1) z1 ON z1.lang IS NOT DISTINCT FROM g.lang LEFT JOIN (SELECT * FROM j WHERE level = 2) z2 ON true"""),
    ]
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts) + f"""
SELECT p.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({DISTANCE} > {CUTOFF}, false) AS kept
FROM p JOIN k ON p.lang IS NOT DISTINCT FROM k.lang AND p.source IS NOT DISTINCT FROM k.source
"""


OP9_SQL = _sql()
