r"""Quality rules: robust multivariate outliers among per-document statistics, with DataFrame functions only.

Base rules fail short texts (under 10 words) and texts of which more than 20 % of the words lie in repeated 5-word
windows. The method then judges five transformed statistics (mean word length, shares of symbols, repeated lines beyond
the first, repeated words and capitals) by their Mahalanobis distance from a minimum-covariance-determinant estimate of
the document's (language, source) group. A group of fewer than `min_rows` documents is judged by its whole language, and
by all documents where the language has too few as well.

MCD. Three starts: coordinate medians and MADs; the covariance of spatial signs about the medians; the half of the group
nearest to the medians. Concentration steps keep the 75 % of a group with the smallest distances and estimate mean and
covariance from them; after `STEPS` of them the start with the smallest determinant goes on, and a last reweighting takes
every document within the 97.5 % point of chi-squared. Variances get a floor, since most documents have no symbols or
repeats at all and a document must not be rejected for one; each floor is small enough that its statistic alone can pass
the cutoff.

Scale. All work on a text happens inside its row: a word is hashed once, a window is the hash of five of those, and only
texts with a repeated window sort theirs; no word or window is shuffled. Statistics are whole numbers (1/1000), so sums
are exact, do not depend on the order of rows, and pre-aggregate; medians and the 75 % points are exact percentiles of
values with a few thousand levels, which pre-aggregate as counts. A hot group is therefore some partial sums a task.
Equal windows are told by a 64-bit hash within one document.

Defined cases: null text has no words; null language or source is a group like any other; with fewer than `min_rows`
documents in all none is judged; an empty table gives an empty result; repeated ids are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, text_of, words

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_ROWS = 50
CORE = 0.75
#: Consistency of the covariance of the inner 75 %, and of the inner 97.5 %, in five dimensions.
SCALE, FULL_SCALE = 1.41, 1.055
#: The 97.5 % point of chi-squared with 5 degrees.
INNER = 12.83
#: Standard deviations that are added to the group's own, in thousandths of a natural logarithm.
FLOORS = (120.0, 250.0, 600.0, 600.0, 300.0)
#: Squared distance beyond which a document is rejected; chi-squared with 5 degrees has 99.9 % below it.
CUTOFF = 20.0
STEPS = 2
_D = range(5)

#: Words in windows that occur twice or more; h: hashes of the words.
_WINDOWS = f"CASE WHEN size(h) < {WINDOW} THEN array() ELSE transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'get(h, i + {k})' for k in range(WINDOW))})) END"
_REPEATS = f"""
CASE WHEN size(array_distinct(win)) = size(win) THEN 0 ELSE
  element_at(transform(array(sort_array(transform(win, (x, i) -> named_struct('h', x, 'p', i)))), s ->
    aggregate(
      sort_array(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) OR coalesce(get(s, i + 1).h = x.h, false)), x -> x.p)),
      named_struct('n', 0, 'last', -{WINDOW}),
      (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p),
      a -> a.n)), 1)
END
"""


def base_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper)."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_of().alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    rows = rows.select("doc_id", "lang", "source", "t", F.transform(words(F.col("t")), lambda x: F.xxhash64(x)).alias("h"), lines.alias("lines"))
    rows = rows.select("*", F.expr(_WINDOWS).alias("win"))
    gone = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    out = rows.select(
        "doc_id", "lang", "source", F.size("h").cast("long").alias("n_words"), F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), gone(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.expr(_REPEATS).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), gone(UPPER).cast("long").alias("n_upper"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _thousandths(of: str) -> str:
    return f"CAST(round(1000 * ln({of})) AS BIGINT)"


_STATS = [
    _thousandths("CAST(word_chars AS DOUBLE) / n_words"),
    _thousandths("1 + 100 * CAST(n_symbols AS DOUBLE) / word_chars"),
    _thousandths("1 + 100 * CAST(greatest(n_dup_lines - 1, 0) AS DOUBLE) / n_lines"),
    _thousandths("1 + 100 * CAST(n_repeat_words AS DOUBLE) / n_words"),
    _thousandths("1 + 100 * CAST(n_upper AS DOUBLE) / word_chars"),
]
_X = [f"x{i}" for i in _D]
_BIN = "CAST(floor(256 * ln(1 + d2)) AS BIGINT)"
_SUMS = [f"CAST(sum(x{i}) AS DOUBLE) AS t{i}" for i in _D] + [f"CAST(sum(x{i} * x{j}) AS DOUBLE) AS t{i}{j}" for i in _D for j in range(i + 1)] + ["CAST(count(*) AS DOUBLE) AS n"]
_KEPT = [*(f"m{i}" for i in _D), *(f"l{i}{j}" for i in _D for j in range(i + 1))]


def _means(scale: float) -> list[str]:
    """Mean m{i} and covariance c{i}{j}, with floors, from the sums."""
    return [f"t{i} / n AS m{i}" for i in _D] + [f"{scale}e0 * (t{i}{j} - t{i} * (t{j} / n)) / n" + (f" + {FLOORS[i]}e0 * {FLOORS[i]}e0" if i == j else "") + f" AS c{i}{j}" for i in _D for j in range(i + 1)]


def _cholesky() -> list[list[str]]:
    """Select lists, one for each level of dependence: l{i}{j} from c{i}{j}."""
    levels = []
    for j in _D:
        square = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        levels.append([f"sqrt(c{j}{j}{square}) AS l{j}{j}"])
        if j < 4:
            levels.append([f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, 5)])
    return levels


def _distance() -> list[list[str]]:
    """Forward substitution: y{i}, then d2."""
    steps = [[f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}"] for i in _D]
    return [*steps, [" + ".join(f"y{i} * y{i}" for i in _D) + " AS d2"]]


def _chain(df: DataFrame, levels: list[list[str]]) -> DataFrame:
    for level in levels:
        df = df.selectExpr("*", *level)
    return df


def _model(sums: DataFrame, scale: float, *keys: str) -> DataFrame:
    """The estimate of each group's sums."""
    return _chain(sums.selectExpr(*keys, *_means(scale)), _cholesky()).select(*keys, *_KEPT)


def _inner(rows: DataFrame, model: DataFrame, core: float, *keys: str) -> DataFrame:
    """Sums over the share `core` of each group that is nearest to its model; keys: g, and the start if there are many."""
    far = _chain(rows.join(small(model), "g"), _distance()).selectExpr(*keys, *_X, f"{_BIN} AS bin")
    edge = cut(far.groupBy(*keys).agg(F.expr(f"percentile(bin, {core})").alias("edge")))
    return far.join(small(edge), list(keys)).where("bin <= edge").groupBy(*keys).agg(*map(F.expr, _SUMS))


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, m{i}, l{i}{j}) of three starts for each group."""
    half = cut(rows.groupBy("g").agg(*(F.expr(f"percentile(x{i}, 0.5)").alias(f"m{i}") for i in _D)))
    away = rows.join(small(half), "g").groupBy("g").agg(*(F.expr(f"percentile(abs(x{i} - m{i}), 0.5)").alias(f"s{i}") for i in _D))
    diagonal = cut(half.join(away, "g").selectExpr("g", *(f"m{i}" for i in _D), *(f"greatest({FLOORS[i]}e0, 1.4826e0 * s{i}) AS s{i}" for i in _D)))
    plain = cut(diagonal.selectExpr("g", *(f"m{i}" for i in _D), *(f"s{i} AS l{i}{i}" if i == j else f"0e0 AS l{i}{j}" for i in _D for j in range(i + 1))).select("g", *_KEPT))

    lengths = [[f"(x{i} - m{i}) / s{i} AS z{i}" for i in _D], ["sqrt(" + " + ".join(f"z{i} * z{i}" for i in _D) + ") AS r"], [f"CASE WHEN r > 0 THEN CAST(round(1000 * z{i} / r) AS BIGINT) ELSE 0 END AS u{i}" for i in _D]]
    signs = _chain(rows.join(small(diagonal), "g"), lengths).groupBy("g").agg(*(F.expr(f"CAST(sum(u{i} * u{j}) AS DOUBLE) / count(*)").alias(f"u{i}{j}") for i in _D for j in range(i + 1)))
    turned = signs.join(diagonal, "g").selectExpr("g", *(f"m{i}" for i in _D), *(f"(u{i}{j}" + (" + 50000e0" if i == j else "") + f") * s{i} * s{j} AS c{i}{j}" for i in _D for j in range(i + 1)))
    turned = _chain(turned, _cholesky()).select("g", *_KEPT)

    near = _model(_inner(rows, plain, 0.5, "g"), 1.0, "g")
    return cut(plain.withColumn("start", F.lit(0)).unionByName(turned.withColumn("start", F.lit(1))).unionByName(near.withColumn("start", F.lit(2))))


def mcd(rows: DataFrame, steps: int = STEPS, core: float = CORE) -> DataFrame:
    """Location m{i} and Cholesky factor l{i}{j} of each group; rows: (g, x0..x4), cut."""
    model = _starts(rows)
    for _ in range(steps):
        model = cut(_model(_inner(rows, model, core, "g", "start"), SCALE, "g", "start"))
    det = F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33") * F.col("l44")
    best = model.groupBy("g").agg(F.min(F.struct(det.alias("det"), "start", *_KEPT)).alias("b")).select("g", *(f"b.{c}" for c in _KEPT))
    best = cut(_model(_inner(rows, cut(best), core, "g"), SCALE, "g"))
    inside = _chain(rows.join(small(best), "g"), _distance()).where(F.col("d2") <= INNER)
    return cut(_model(inside.groupBy("g").agg(*map(F.expr, _SUMS)), FULL_SCALE, "g"))


def quality_rules(docs: DataFrame, min_rows: int = MIN_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """base_stats with base_failed, kept and distance (squared; null where a document is not judged)."""
    stats = cut(base_stats(docs).withColumn("row", F.monotonically_increasing_id()))
    judged = stats.where("not base_failed").selectExpr("row", "lang", "source", *(f"{s} AS x{i}" for i, s in enumerate(_STATS)))
    sizes = cut(judged.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    by_lang = sizes.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("in_lang"), (F.min("n") < min_rows).alias("lang_used"))
    by_lang = by_lang.withColumn("lang_used", F.col("lang_used") & (F.col("in_lang") >= min_rows))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = by_lang.where(F.col("in_lang") < min_rows).limit(1).count() > 0 and total >= min_rows
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    own, lang, every = F.concat_ws("\x1f", text("lang"), text("source")), text("lang"), F.lit("all" if rest else None)
    names = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of")))
    names = names.withColumn("is", F.when(F.col("n") >= min_rows, own).when(F.col("in_lang") >= min_rows, lang).otherwise(every))
    groups = F.array(F.when(F.col("n") >= min_rows, own), F.when(F.col("lang_used"), lang), every)
    names = cut(names.select(F.col("lang").alias("l"), F.col("source").alias("s"), "is", F.filter(groups, lambda x: x.isNotNull()).alias("groups")))
    rows = judged.join(small(names, 20_000, F.length(F.coalesce("s", F.lit(""))) + 100), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    rows = cut(rows.select("row", "is", F.explode("groups").alias("g"), *_X))
    far = _chain(rows.where(F.col("is") == F.col("g")).join(small(mcd(rows)), "g"), _distance()).select("row", F.col("d2").alias("distance"))
    out = stats.join(far, "row", "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).drop("row")


def quality_report(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The rules again in DuckDB's SQL, written for themselves: LDL' elimination in lists of columns, plain constants."""
    names = "fuhjq"
    pairs = [p + q for k, p in enumerate(names) for q in names[: k + 1]]
    floor = dict(zip(names, ("120", "250", "600", "600", "300"), strict=True))

    def moments(source: str, by: str, factor: str) -> str:
        raw = f"SELECT {by}, count(*)::DOUBLE AS k, {', '.join(f'sum({p})::DOUBLE AS {p}1' for p in names)}, {', '.join(f'sum({q[0]} * {q[1]})::DOUBLE AS {q}2' for q in pairs)} FROM {source} GROUP BY {by}"
        cov = [f"{factor} * ({q}2 - {q[0]}1 * ({q[1]}1 / k)) / k" + (f" + {floor[q[0]]} * {floor[q[0]]}::DOUBLE" if q[0] == q[1] else "") + f" AS {q}" for q in pairs]
        return f"SELECT {by}, {', '.join(f'{p}1 / k AS {p}m' for p in names)}, {', '.join(cov)} FROM ({raw})"

    def ldl(source: str) -> str:
        """Columns pd (pivots) and qp (unit lower triangle) from the covariance."""
        sql = source
        for k, p in enumerate(names):
            before = names[:k]
            sql = f"SELECT *, {p}{p}" + "".join(f" - {p}{r}u * {p}{r}u * {r}d" for r in before) + f" AS {p}d FROM ({sql})"
            for q in names[k + 1 :]:
                sql = f"SELECT *, ({q}{p}" + "".join(f" - {q}{r}u * {p}{r}u * {r}d" for r in before) + f") / {p}d AS {q}{p}u FROM ({sql})"
        return sql

    def far(source: str) -> str:
        sql = source
        for k, p in enumerate(names):
            sql = f"SELECT *, ({p} - {p}m" + "".join(f" - {p}{r}u * {r}w" for r in names[:k]) + f") AS {p}w FROM ({sql})"
        return f"SELECT *, {' + '.join(f'{p}w * {p}w / {p}d' for p in names)} AS far FROM ({sql})"

    ctes = [r"""
doc AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT r, i, ws[i:i + 4] AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM doc WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM win) WHERE c > 1),
again AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM twice, range(5) x(j) GROUP BY r),
st AS (SELECT doc.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper FROM doc LEFT JOIN again ON doc.r = again.r),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st),
num AS (SELECT r, lang, source, round(1000 * ln(word_chars::DOUBLE / n_words))::BIGINT AS f, round(1000 * ln(1 + 100 * n_symbols::DOUBLE / word_chars))::BIGINT AS u,
        round(1000 * ln(1 + 100 * greatest(n_dup_lines - 1, 0)::DOUBLE / n_lines))::BIGINT AS h, round(1000 * ln(1 + 100 * n_repeat_words::DOUBLE / n_words))::BIGINT AS j,
        round(1000 * ln(1 + 100 * n_upper::DOUBLE / word_chars))::BIGINT AS q FROM base WHERE NOT base_failed),
cnt AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS ns, count(*) OVER (PARTITION BY lang) AS nl, count(*) OVER () AS na FROM num),
lev AS (SELECT *, CASE WHEN ns >= 50 THEN 1 WHEN nl >= 50 THEN 2 WHEN na >= 50 THEN 3 END AS level, min(ns) OVER (PARTITION BY lang) < 50 AND nl >= 50 AS lang_used, min(nl) OVER () < 50 AND na >= 50 AS all_used FROM cnt),
est AS MATERIALIZED (SELECT {'k': 1, 'l': lang, 's': source} AS g, level = 1 AS own, r, f, u, h, j, q FROM lev WHERE ns >= 50
        UNION ALL SELECT {'k': 2, 'l': lang, 's': NULL}, level = 2, r, f, u, h, j, q FROM lev WHERE lang_used
        UNION ALL SELECT {'k': 3, 'l': NULL, 's': NULL}, level = 3, r, f, u, h, j, q FROM lev WHERE all_used)"""]
    ctes.append(f"med AS (SELECT g, {', '.join(f'median({p}) AS {p}m' for p in names)} FROM est GROUP BY g)")
    ctes.append(f"mad AS (SELECT g, {', '.join(f'any_value({p}m) AS {p}m, greatest({floor[p]}::DOUBLE, 1.4826 * median(abs({p} - {p}m))) AS {p}s' for p in names)} FROM est JOIN med USING (g) GROUP BY g)")
    ctes.append(f"s0 AS MATERIALIZED ({ldl('SELECT g, ' + ', '.join(f'{p}m' for p in names) + ', ' + ', '.join(f'{q[0]}s * {q[0]}s AS {q}' if q[0] == q[1] else f'0::DOUBLE AS {q}' for q in pairs) + ' FROM mad')})")
    unit = f"SELECT *, sqrt({' + '.join(f'{p}z * {p}z' for p in names)}) AS len FROM (SELECT *, {', '.join(f'({p} - {p}m) / {p}s AS {p}z' for p in names)} FROM est JOIN mad USING (g))"
    ctes.append(f"sgn AS (SELECT g, {', '.join(f'CASE WHEN len > 0 THEN round(1000 * {p}z / len)::BIGINT ELSE 0 END AS {p}' for p in names)} FROM ({unit}))")
    ctes.append(f"ss AS (SELECT g, {', '.join(f'sum({q[0]} * {q[1]})::DOUBLE / count(*) AS {q}v' for q in pairs)} FROM sgn GROUP BY g)")
    ctes.append(f"s1 AS MATERIALIZED ({ldl('SELECT g, ' + ', '.join(f'{p}m' for p in names) + ', ' + ', '.join(f'({q}v' + (' + 50000' if q[0] == q[1] else '') + f') * {q[0]}s * {q[1]}s AS {q}' for q in pairs) + ' FROM ss JOIN mad USING (g)')})")

    def step(name: str, model: str, by: str, share: str, factor: str) -> None:
        ctes.append(f"{name}f AS MATERIALIZED (SELECT {by}, f, u, h, j, q, floor(256 * ln(1 + far))::BIGINT AS cell FROM ({far(f'SELECT * FROM est JOIN {model} USING (g)')}))")
        ctes.append(f"{name}i AS (SELECT x.* FROM {name}f x JOIN (SELECT {by}, quantile_cont(cell, {share}) AS edge FROM {name}f GROUP BY {by}) y USING ({by}) WHERE cell <= edge)")
        ctes.append(f"{name} AS MATERIALIZED ({ldl(moments(f'{name}i', by, factor))})")

    keep = ", ".join([*(f"{p}m" for p in names), *(f"{p}d" for p in names), *(f"{q}u" for q in pairs if q[0] != q[1])])
    step("s2", "s0", "g", "0.5", "1.0")
    ctes.append(f"c0 AS MATERIALIZED (SELECT g, 0 AS start, {keep} FROM s0 UNION ALL SELECT g, 1, {keep} FROM s1 UNION ALL SELECT g, 2, {keep} FROM s2)")
    step("c1", "c0", "g, start", "0.75", "1.41")
    step("c2", "c1", "g, start", "0.75", "1.41")
    ctes.append(f"best AS MATERIALIZED (SELECT g, {keep} FROM c2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY {' * '.join(f'{p}d' for p in names)}, start) = 1)")
    step("c3", "best", "g", "0.75", "1.41")
    ctes.append(f"near AS (SELECT * FROM ({far('SELECT g, own, r, f, u, h, j, q, ' + keep + ' FROM est JOIN c3 USING (g)')}) WHERE far <= 12.83)")
    ctes.append(f"fin AS MATERIALIZED ({ldl(moments('near', 'g', '1.055'))})")
    ctes.append(f"z AS (SELECT r, far FROM ({far('SELECT * FROM est JOIN fin USING (g) WHERE own')}))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(far <= 20, true) AS kept FROM base LEFT JOIN z ON base.r = z.r"


ORACLE = _oracle()
