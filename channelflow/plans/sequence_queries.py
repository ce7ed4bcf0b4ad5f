"""State-sequence queries over events: a user's event types in time order are its states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelflow.operators import inference as I
from channelflow.operators import sequences as S
from channelflow.operators import spectral as P

from . import hierarchy as H
from .registry import SQL, query, rounded, table

LONG = 10  # users are dealt to so many long sequences where an operator needs length


def states(spark: SparkSession, folder: str) -> DataFrame:
    return S.sequence(table(spark, folder, "events"), "user_id", "event_type", "ts", "event_id")


def long_states(spark: SparkSession, folder: str) -> DataFrame:
    return S.sequence(table(spark, folder, "events"), F.pmod("user_id", F.lit(LONG)), "event_type", "ts", "event_id")


SEQ = "seq AS (SELECT user_id AS subject, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"
LONG_SEQ = f"seq AS (SELECT user_id % {LONG} AS subject, event_type AS state, row_number() OVER (PARTITION BY user_id % {LONG} ORDER BY ts, event_id) - 1 AS t FROM events)"
GRID = "grid AS (SELECT subject, state FROM (SELECT DISTINCT subject FROM seq), (SELECT DISTINCT state FROM seq)), size AS (SELECT subject, count(*) AS n FROM seq GROUP BY subject)"


def runs_sql(source: str = "seq", keys: str = "subject") -> str:
    return f"""marked AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY {keys} ORDER BY t) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS c FROM {source}),
numbered AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY t) AS run FROM marked),
runs AS (SELECT {keys}, run, any_value(state) AS state, min(t) AS start, count(*) AS length, run = 1 AS is_first, run = max(run) OVER (PARTITION BY {keys}) AS is_last FROM numbered GROUP BY {keys}, run)"""


@query(f"WITH {SEQ}, {runs_sql()} SELECT subject, run::BIGINT AS run, state, start, length FROM runs")
def run_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return S.runs(states(spark, folder)).select("subject", "run", "state", "start", "length")


@query(f"WITH {SEQ}, p AS (SELECT subject, state AS s0, lead(state) OVER w AS s1, lead(t) OVER w AS there FROM seq WINDOW w AS (PARTITION BY subject ORDER BY t)), c AS (SELECT subject, s0, s1, count(*) AS n FROM p WHERE there IS NOT NULL GROUP BY ALL) SELECT subject, s0, s1, n, round(n / sum(n) OVER (PARTITION BY subject), 6) AS joint, round(n / sum(n) OVER (PARTITION BY subject, s0), 6) AS p FROM c")
def transition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.transition_matrix(states(spark, folder)))


@query(f"WITH {SEQ}, p AS (SELECT subject, state AS s0, lead(state) OVER w AS s1, lead(state, 2) OVER w AS s2, lead(t, 2) OVER w AS there FROM seq WINDOW w AS (PARTITION BY subject ORDER BY t)), c AS (SELECT subject, s0, s1, s2, count(*) AS n FROM p WHERE there IS NOT NULL GROUP BY ALL) SELECT subject, s0, s1, s2, n, round(n / sum(n) OVER (PARTITION BY subject), 6) AS joint, round(n / sum(n) OVER (PARTITION BY subject, s0, s1), 6) AS p FROM c")
def transition_matrix_order2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.transition_matrix(states(spark, folder), 2))


@query(f"WITH {SEQ}, m AS (SELECT subject, t, CASE WHEN t > 0 AND lag(state) OVER (PARTITION BY subject ORDER BY t) IS DISTINCT FROM state THEN 1 ELSE 0 END AS moved FROM seq) SELECT subject, round(CASE WHEN count(*) <= 1 THEN 0.0 ELSE sum(moved) / (count(*) - 1) END, 6)::DOUBLE AS transition_frequency FROM m GROUP BY subject")
def transition_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.transition_frequency(states(spark, folder)))


@query(f"WITH {SEQ}, {GRID}, f AS (SELECT subject, state, count(*) AS k FROM seq GROUP BY ALL) SELECT subject, state, round(coalesce(k, 0) / n, 6) AS coverage FROM grid LEFT JOIN f USING (subject, state) JOIN size USING (subject)")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.coverage(states(spark, folder)))


@query(f"WITH {SEQ}, {GRID}, f AS (SELECT subject, state, count(*) AS k FROM seq GROUP BY ALL) SELECT subject, state, round(coalesce(k, 0) / ((n - 1) // 10 + 1), 6) AS occurrence FROM grid LEFT JOIN f USING (subject, state) JOIN size USING (subject)")
def occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.occurrence(states(spark, folder), 10))


@query(f"WITH {SEQ}, {runs_sql()} SELECT subject, state, count(*) AS segments FROM runs GROUP BY ALL")
def segments(spark: SparkSession, folder: str) -> DataFrame:
    return S.segments(states(spark, folder))


@query(
    f"""WITH {SEQ}, {GRID}, {runs_sql()},
ends AS (SELECT subject, max(CASE WHEN is_first THEN state END) AS fs, max(CASE WHEN is_last THEN state END) AS ls FROM runs GROUP BY subject),
stored AS (SELECT r.*, fs, ls, row_number() OVER (PARTITION BY r.subject, state ORDER BY run) AS i, count(*) OVER (PARTITION BY r.subject, state) AS n FROM runs r JOIN ends USING (subject) WHERE NOT is_last),
kept AS (SELECT subject, state, avg(length) AS d FROM stored WHERE NOT (CASE WHEN state = fs THEN i = 1 WHEN state = ls THEN i = n ELSE false END) GROUP BY ALL)
SELECT subject, state, round(coalesce(d, 0), 6) AS duration FROM grid LEFT JOIN kept USING (subject, state)"""
)
def duration_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.duration_trimmed(states(spark, folder)))


@query(
    f"""WITH {SEQ}, {GRID}, {runs_sql()},
kept AS (SELECT subject, state, avg(length) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(length) END AS std, quantile_cont(length, 0.5) AS median, count(*) AS n FROM runs WHERE NOT is_first GROUP BY ALL)
SELECT subject, state, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6)::DOUBLE AS median, coalesce(n, 0) AS segments FROM grid LEFT JOIN kept USING (subject, state)"""
)
def duration_label(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.duration_label(states(spark, folder)))


@query(f"WITH {SEQ}, {GRID}, {runs_sql()}, kept AS (SELECT subject, state, avg(length) AS d FROM runs WHERE NOT is_last GROUP BY ALL) SELECT subject, state, round(coalesce(d, 1), 6) AS duration FROM grid LEFT JOIN kept USING (subject, state)")
def duration_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.duration_sequence(states(spark, folder)))


WINDOWED = "win AS (SELECT subject, t // 20 AS w, t % 20 AS t, state FROM seq JOIN (SELECT subject, count(*) AS n FROM seq GROUP BY subject) USING (subject) WHERE t // 20 < n // 20)"


@query(
    f"""WITH {SEQ}, {WINDOWED}, {runs_sql("win", "subject, w")}, kept AS (SELECT subject, w, state, avg(length) AS d FROM runs WHERE NOT is_last GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT subject, w FROM win), (SELECT DISTINCT state FROM seq))
SELECT subject, state, round(avg(coalesce(d, 1)), 6) AS duration FROM grid LEFT JOIN kept USING (subject, w, state) GROUP BY ALL"""
)
def duration_sequence_windowed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.duration_sequence(states(spark, folder), 20))


@query(f"""WITH {SEQ}, {WINDOWED}, {runs_sql("win", "subject, w")}, k AS (SELECT subject, w, state, count(*) AS k FROM runs WHERE NOT is_last GROUP BY ALL) SELECT subject, state, round(avg(k), 6) AS frequency FROM k GROUP BY ALL""")
def frequency_window(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.frequency(states(spark, folder), 20))


def entropy_sql(counted: str, keys: str) -> str:
    return f"SELECT {keys}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM {counted} GROUP BY {keys}"


@query(f"WITH {SEQ}, c AS (SELECT subject, state, count(*) AS n FROM seq GROUP BY ALL), h AS ({entropy_sql('c', 'subject')}) SELECT subject, round(h, 6) + 0.0 AS entropy FROM h")
def shannon_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.shannon_entropy(states(spark, folder)))


@query(f"WITH {SEQ}, c AS (SELECT a.subject, a.state AS x, b.state AS y, count(*) AS n FROM seq a JOIN seq b ON a.subject = b.subject AND b.t = a.t + 2 GROUP BY ALL), h AS ({entropy_sql('c', 'subject')}) SELECT subject, round(h, 6) + 0.0 AS entropy FROM h")
def joint_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.joint_entropy(states(spark, folder), 2))


MI = f"""pairs AS (SELECT a.subject, l.lag, a.state AS x, b.state AS y, count(*) AS n FROM seq a CROSS JOIN (SELECT unnest(range(5)) AS lag) l JOIN seq b ON a.subject = b.subject AND b.t = a.t + l.lag GROUP BY ALL),
px AS (SELECT subject, lag, x, sum(n) AS n FROM pairs GROUP BY ALL), py AS (SELECT subject, lag, y, sum(n) AS n FROM pairs GROUP BY ALL),
hx AS ({entropy_sql('px', 'subject, lag')}), hy AS ({entropy_sql('py', 'subject, lag')}), hxy AS ({entropy_sql('pairs', 'subject, lag')}),
mi AS (SELECT subject, lag, hx.h + hy.h - hxy.h AS mi FROM hx JOIN hy USING (subject, lag) JOIN hxy USING (subject, lag))"""


@query(f"WITH {SEQ}, {MI} SELECT subject, lag::INT AS lag, round(mi, 6) + 0.0 AS mutual_information FROM mi")
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.mutual_information(states(spark, folder), 5))


def block_sql(k: int) -> str:
    cols = ", ".join(f"lead(state, {i}) OVER w AS s{i}" for i in range(k))
    names = ", ".join(f"s{i}" for i in range(k))
    return f"g{k} AS (SELECT subject, t, {cols} FROM seq WINDOW w AS (PARTITION BY subject ORDER BY t)), c{k} AS (SELECT subject, {names}, count(*) AS n FROM g{k} JOIN (SELECT subject, count(*) AS len FROM seq GROUP BY subject) USING (subject) WHERE t < len - {k} GROUP BY ALL), b{k} AS ({entropy_sql(f'c{k}', 'subject')})"


BLOCKS = ", ".join(block_sql(k) for k in range(1, 5)) + ", b AS (" + " UNION ALL ".join(f"SELECT subject, {k} AS k, h FROM b{k}" for k in range(1, 5)) + ")"


@query(f"WITH {SEQ}, {BLOCKS} SELECT subject, k, round(h, 6) + 0.0 AS entropy FROM b")
def block_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.block_entropies(states(spark, folder), 4))


@query(f"WITH {SEQ}, {BLOCKS} SELECT subject, round(regr_slope(h, k), 6) + 0.0 AS entropy_rate, round(regr_intercept(h, k), 6) + 0.0 AS excess_entropy FROM b GROUP BY subject")
def excess_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.excess_entropy(states(spark, folder), 4))


@query(
    f"""WITH {SEQ}, {MI}, {BLOCKS}
SELECT subject, lag::INT AS lag, round(mi, 6) + 0.0 AS partial FROM mi WHERE lag < 2
UNION ALL SELECT a.subject, a.k AS lag, round(2 * a.h - b1.h - c1.h, 6) + 0.0 FROM b a JOIN b b1 ON a.subject = b1.subject AND b1.k = a.k - 1 JOIN b c1 ON a.subject = c1.subject AND c1.k = a.k + 1 WHERE a.k BETWEEN 2 AND 3"""
)
def partial_mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.partial_mutual_information(states(spark, folder), 4))


@query(
    f"""WITH {SEQ}, {GRID}, p AS (SELECT subject, state, lead(state) OVER w AS s1, lead(t) OVER w AS there FROM seq WINDOW w AS (PARTITION BY subject ORDER BY t)),
c AS (SELECT subject, state, s1, count(*) AS n FROM p WHERE there IS NOT NULL GROUP BY ALL), q AS (SELECT subject, state, n / sum(n) OVER (PARTITION BY subject, state) AS p FROM c),
f AS (SELECT subject, state, count(*) AS k FROM seq GROUP BY ALL)
SELECT subject, round(-sum(k / size.n * p * ln(p)), 6) + 0.0 AS entropy_rate FROM q JOIN f USING (subject, state) JOIN size USING (subject) GROUP BY subject"""
)
def entropy_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.entropy_rate(states(spark, folder)))


@query(
    f"""WITH {LONG_SEQ}, ind AS (SELECT a.subject, s.state, a.t, (a.state = s.state)::INT::DOUBLE AS x, count(*) OVER (PARTITION BY a.subject, s.state) AS n FROM seq a, (SELECT DISTINCT state FROM seq) s),
scaled AS (SELECT *, t // size AS block FROM ind, (SELECT unnest([16, 32, 64, 128, 256, 512, 1024]) AS size) WHERE n >= 64 AND size <= greatest(least(n // 4, 1024), 16) AND n // size >= 4 AND t // size < n // size),
walked AS (SELECT *, sum(x) OVER b - row_number() OVER b * avg(x) OVER (PARTITION BY subject, state, size, block) AS z FROM scaled WINDOW b AS (PARTITION BY subject, state, size, block ORDER BY t)),
r AS (SELECT subject, state, size, block, max(z) - min(z) AS r, stddev_samp(x) AS s FROM walked GROUP BY ALL), m AS (SELECT subject, state, size, avg(r / s) AS rs FROM r WHERE s > 0 GROUP BY ALL),
h AS (SELECT subject, state, CASE WHEN count(*) >= 2 THEN regr_slope(ln(rs), ln(size)) END AS h FROM m GROUP BY ALL)
SELECT subject, state, round(h, 6) + 0.0 AS hurst FROM (SELECT DISTINCT subject, state FROM ind) LEFT JOIN h USING (subject, state)"""
)
def hurst_rs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.hurst_states(long_states(spark, folder)))


WALK = "walk AS (SELECT subject, t, CASE WHEN state IN ('click', 'view') THEN 1.0 ELSE -1.0 END::DOUBLE AS x FROM seq)"


@query(f"WITH {SEQ}, {WALK} SELECT subject, t, x FROM walk")
def random_walk(spark: SparkSession, folder: str) -> DataFrame:
    return S.random_walk(states(spark, folder), ["click", "view"])


@query(
    f"""WITH {LONG_SEQ}, {WALK}, y AS (SELECT subject, t, count(*) OVER (PARTITION BY subject) AS n, sum(x) OVER (PARTITION BY subject ORDER BY t) - (t + 1) * avg(x) OVER (PARTITION BY subject) AS y FROM walk),
cut AS (SELECT *, t // scale AS w FROM y, (SELECT unnest([4, 8, 16, 32]) AS scale) WHERE t // scale < n // scale),
rest AS (SELECT subject, scale, w, regr_syy(y, t) - coalesce(regr_sxy(y, t) ** 2 / nullif(regr_sxx(y, t), 0), 0) AS ss FROM cut GROUP BY ALL),
flat AS (SELECT subject, scale, sqrt(avg(greatest(ss, 0) / scale)) AS f FROM rest GROUP BY ALL)
SELECT subject, round(regr_slope(log2(f), log2(scale)), 6) + 0.0 AS dfa FROM flat WHERE f > 0 GROUP BY subject"""
)
def dfa(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.dfa(S.random_walk(long_states(spark, folder), ["click", "view"]), ["subject"], [4, 8, 16, 32]))


def markov_sql(order: int) -> str:
    k = order + 2
    cols = ", ".join(f"lead(state, {i}) OVER w AS s{i}" for i in range(k))
    names = [f"s{i}" for i in range(k)]
    part = lambda x: f"sum(n) OVER (PARTITION BY {', '.join(['subject', *x])})"
    return f"""WITH {SEQ}, g AS (SELECT subject, {cols}, lead(t, {k - 1}) OVER w AS there FROM seq WINDOW w AS (PARTITION BY subject ORDER BY t)),
c AS (SELECT subject, {', '.join(names)}, count(*) AS n FROM g WHERE there IS NOT NULL GROUP BY ALL),
x AS (SELECT subject, n * ln(n * {part(names[1:-1])} / ({part(names[:-1])} * {part(names[1:])})) AS g FROM c), k AS (SELECT count(DISTINCT state) AS k FROM seq)
SELECT subject, round(2 * sum(g), 6) + 0.0 AS g, (SELECT (k ** {2 + order} - 2 * k ** {1 + order} + k ** {order})::INT FROM k) AS df FROM x GROUP BY subject"""


@query(markov_sql(0))
def markov_g0(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.markov_g(states(spark, folder), 0))


@query(markov_sql(1))
def markov_g1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.markov_g(states(spark, folder), 1))


@query(
    f"""WITH {SEQ}, {GRID}, blocked AS (SELECT subject, t // 20 AS b, t, state FROM seq JOIN size USING (subject) WHERE t // 20 < n // 20),
p AS (SELECT *, lead(state) OVER w AS nxt, lead(t) OVER w AS there FROM blocked WINDOW w AS (PARTITION BY subject, b ORDER BY t)), c AS (SELECT subject, b, state, nxt, count(*) AS n FROM p WHERE there IS NOT NULL GROUP BY ALL),
x AS (SELECT subject, n * ln(n * sum(n) OVER (PARTITION BY subject, state) / (sum(n) OVER (PARTITION BY subject, b, state) * sum(n) OVER (PARTITION BY subject, state, nxt))) AS g FROM c), k AS (SELECT count(DISTINCT state) AS k FROM seq)
SELECT subject, round(2 * sum(g), 6) + 0.0 AS g, ((n // 20 - 1) * (SELECT (k - 1) * k FROM k))::BIGINT AS df FROM x JOIN size USING (subject) GROUP BY subject, n"""
)
def homogeneity_g(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.homogeneity_g(states(spark, folder), 20))


@query(f"WITH mi AS ({SQL['mutual_information']}), l AS (SELECT subject, lag, ln(mutual_information) AS y FROM mi WHERE mutual_information > 0 AND lag > 0) SELECT subject, round(exp(regr_intercept(y, lag)), 4) + 0.0 AS a, round(-regr_slope(y, lag), 4) + 0.0 AS b FROM l GROUP BY subject")
def exponential_decay(spark: SparkSession, folder: str) -> DataFrame:
    mi = mutual_information(spark, folder).where("lag > 0").withColumnRenamed("mutual_information", "value")
    found = I.exponential_decay(mi)
    return found.select("subject", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("a", "b")])


@query()
def exponential_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Decay of the mutual information over lags, with an offset, by least squares."""
    mi = mutual_information(spark, folder).where("lag > 0").withColumnRenamed("mutual_information", "value")
    return I.exponential_fit(mi).select("subject", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("a", "b", "c", "left")])


@query(f"SELECT lag, round(quantile_cont(mutual_information, 0.025), 6) + 0.0 AS low, round(quantile_cont(mutual_information, 0.975), 6) + 0.0 AS high FROM ({SQL['mutual_information']}) GROUP BY lag")
def percentile_band(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(I.percentile_band(mutual_information(spark, folder), ["lag"], "mutual_information"))


@query(
    f"""WITH {SEQ}, w AS (SELECT subject, t AS begin, list(state) OVER a AS states, list(state) OVER b AS target, count(*) OVER (PARTITION BY subject) AS n FROM seq WINDOW a AS (PARTITION BY subject ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), b AS (PARTITION BY subject ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT subject, begin, array_to_string(states, ',') AS states, array_to_string(target, ',') AS target FROM w WHERE begin % 5 = 0 AND begin + 11 <= n"""
)
def sequence_windows(spark: SparkSession, folder: str) -> DataFrame:
    return P.windows(states(spark, folder), 10, 5, 1).select("subject", "begin", F.array_join("states", ",").alias("states"), F.array_join("target", ",").alias("target"))


def metric_sql(name: str, query_name: str, value: str, states: tuple[str, ...] = ()) -> str:
    columns = [*states, *["NULL"] * (2 - len(states))]
    return f"SELECT subject, '{name}' AS metric, {columns[0]}::VARCHAR AS state_from, {columns[1]}::VARCHAR AS state_to, {value}::DOUBLE AS value FROM ({SQL[query_name]})"


@query(
    " UNION ALL ".join(
        [
            metric_sql("coverage", "coverage", "coverage", ("state",)),
            metric_sql("duration", "duration_trimmed", "duration", ("state",)),
            metric_sql("segments", "segments", "segments", ("state",)),
            metric_sql("occurrence", "occurrence", "occurrence", ("state",)),
            metric_sql("entropy_rate", "entropy_rate", "entropy_rate"),
            metric_sql("transition_matrix", "transition_matrix", "p", ("s0", "s1")),
        ]
    )
)
def metrics_bundle(spark: SparkSession, folder: str) -> DataFrame:
    chosen = ["coverage", "duration", "segments", "occurrence", "entropy_rate", "transition_matrix"]
    return rounded(H.sequence_metrics(states(spark, folder), 10, chosen))


@query()
def surrogate_chain(spark: SparkSession, folder: str) -> DataFrame:
    return I.surrogates(S.transition_matrix(states(spark, folder)), 100, 2)


@query()
def surrogate_chain_order2(spark: SparkSession, folder: str) -> DataFrame:
    return I.surrogates(S.transition_matrix(states(spark, folder), 2), 100, 2)
