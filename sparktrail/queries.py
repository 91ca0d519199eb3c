"""The registered queries of the engine on the driver's tables, each beside its SQL.

Case = user_id, order = (ts, event_id), atom = event_type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.sequences import common_length
from .functions.text import plain
from .operators import gates, graph, match, metrics, synth, systems, traces
from .plans import scan, temporal
from .sources.tables import events, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CASE, ORDER, ATOM = "user_id", ["ts", "event_id"], "event_type"
SUITE = {
    "exists_purchase": "F purchase",
    "response_error_purchase": "G(error -> F(purchase))",
    "signup_before_purchase": "!purchase W signup",
    "strong_signup_before_purchase": "!purchase U signup",
    "no_error_after_purchase": "G(purchase -> !F(error))",
    "view_or_click_before_purchase": "!purchase W (view | click)",
    "response_error_either": "G(error -> (F(purchase) | F(signup)))",
}
#: first and last position of an atom of a case, then the rules, in SQL.
POSITIONS = """p AS (SELECT user_id, struct_pack(a := ts, b := event_id) AS o, event_type AS e FROM events WHERE user_id IS NOT NULL),
v AS (SELECT user_id, min(o) FILTER (e = 'purchase') AS fp, max(o) FILTER (e = 'purchase') AS lp, max(o) FILTER (e = 'error') AS le, min(o) FILTER (e = 'signup') AS fs, max(o) FILTER (e = 'signup') AS ls,
 min(o) FILTER (e = 'view') AS fv, min(o) FILTER (e = 'click') AS fc FROM p GROUP BY user_id),
r AS (SELECT user_id, lp IS NOT NULL AS exists_purchase, le IS NULL OR coalesce(lp >= le, false) AS response_error_purchase,
 fp IS NULL OR coalesce(fs <= fp, false) AS signup_before_purchase, fs IS NOT NULL AND (fp IS NULL OR fs <= fp) AS strong_signup_before_purchase,
 fp IS NULL OR le IS NULL OR le < fp AS no_error_after_purchase, fp IS NULL OR coalesce(fv <= fp, false) OR coalesce(fc <= fp, false) AS view_or_click_before_purchase,
 le IS NULL OR coalesce(lp >= le, false) OR coalesce(ls >= le, false) AS response_error_either FROM v)"""
NAMES = list(SUITE)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {POSITIONS} SELECT * FROM r")
def ltl_templates_per_case(spark, d):
    return temporal.verdicts(events(spark, d), SUITE, CASE, ORDER, ATOM)


@query(f"WITH {POSITIONS} SELECT rule, CAST(count(*) AS BIGINT) AS n, CAST(count_if(holds) AS BIGINT) AS holds, round(count_if(holds) / count(*), 6) AS rate FROM (UNPIVOT r ON {', '.join(NAMES)} INTO NAME rule VALUE holds) GROUP BY rule")
def ltl_suite_summary(spark, d):
    v = temporal.verdicts(events(spark, d), SUITE, CASE, ORDER, ATOM)
    rows = v.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("h")) for n in SUITE])).alias("x")).select("x.*")
    return rows.groupBy("rule").agg(F.count("*").cast("bigint").alias("n"), F.count_if("h").cast("bigint").alias("holds"), F.round(F.count_if("h") / F.count("*"), 6).alias("rate"))


FOLLOW = "WITH RECURSIVE s AS (SELECT user_id, event_id, event_type AS e, row_number() OVER w AS pos, lead(event_type) OVER w AS nx, lag(event_type) OVER w AS bf FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(FOLLOW + " SELECT event_id, coalesce(nx = 'purchase', false) AS holds FROM s")
def ltl_next(spark, d):
    df = events(spark, d).filter("user_id IS NOT NULL")
    return temporal.at_each_step(df, "X purchase", CASE, ORDER, ATOM).select("event_id", "holds")


@query(FOLLOW + " SELECT event_id, NOT EXISTS (SELECT 1 FROM s t WHERE t.user_id = s.user_id AND t.pos >= s.pos AND t.e = 'error' AND NOT EXISTS (SELECT 1 FROM s u WHERE u.user_id = t.user_id AND u.pos >= t.pos AND u.e = 'purchase')) AS holds FROM s")
def ltl_globally_window(spark, d):
    df = events(spark, d).filter("user_id IS NOT NULL")
    return temporal.at_each_step(df, "G(error -> F purchase)", CASE, ORDER, ATOM).select("event_id", "holds")


@query(FOLLOW + ", k AS (SELECT user_id, pos, event_id, min(CASE WHEN e = 'purchase' THEN pos END) OVER w AS q, min(CASE WHEN e NOT IN ('view', 'click', 'signup') THEN pos END) OVER w AS np FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, q IS NOT NULL AND (np IS NULL OR np >= q) AS holds FROM k")
def ltl_until_window(spark, d):
    df = events(spark, d).filter("user_id IS NOT NULL")
    return temporal.at_each_step(df, "(view | click | signup) U purchase", CASE, ORDER, ATOM).select("event_id", "holds")


@query("""WITH s AS (SELECT event_id, event_type AS e, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events),
k AS (SELECT event_id, pos, min(CASE WHEN e = 'purchase' THEN pos END) OVER w AS q, min(CASE WHEN e NOT IN ('view', 'click', 'signup') THEN pos END) OVER w AS np, max(CASE WHEN e = 'error' THEN pos END) OVER w AS le, max(CASE WHEN e = 'signup' THEN pos END) OVER w AS ls, lead(e) OVER (ORDER BY pos) AS nx
 FROM s WINDOW w AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, q IS NOT NULL AND (np IS NULL OR np >= q) AS until_holds, le IS NULL OR coalesce(ls >= le, false) OR coalesce(nx = 'view', false) AS response_or_next FROM k""")
def ltl_until_scan(spark, d):
    """Two rules at each step of all events as one case."""
    df = events(spark, d).select("event_id", "ts", "event_type", F.lit(0).alias("log"))
    out = scan.at_each_step(df, "(view | click | signup) U purchase", "log", ORDER, ATOM, "until_holds")
    return scan.at_each_step(out, "G(error -> F signup) | X view", "log", ORDER, ATOM, "response_or_next").select("event_id", "until_holds", "response_or_next")


@query(FOLLOW + ", k AS (SELECT user_id, min(CASE WHEN e = 'purchase' THEN pos END) AS q, min(CASE WHEN e NOT IN ('view', 'click') THEN pos END) AS np FROM s GROUP BY user_id) SELECT user_id, q IS NOT NULL AND (np IS NULL OR np >= q) AS holds FROM k")
def ltl_until_fold(spark, d):
    seq = traces.sequences(events(spark, d).filter("user_id IS NOT NULL"), CASE, ORDER, ATOM)
    return seq.select(CASE, temporal.fold(F.col("steps"), "(view | click) U purchase").alias("holds"))


@query(f"WITH {POSITIONS} SELECT user_id, CASE {' '.join(f'WHEN NOT {n} THEN {chr(39)}{n}{chr(39)}' for n in NAMES)} END AS first_failing, CAST(0 AS BIGINT) AS parse_errors FROM r")
def ltl_first_failing_property(spark, d):
    return temporal.audit(events(spark, d).filter("user_id IS NOT NULL"), SUITE, CASE, ORDER, ATOM)


@query(FOLLOW + " SELECT e AS src, nx AS dst, CAST(count(*) AS BIGINT) AS n FROM s WHERE nx IS NOT NULL GROUP BY ALL")
def directly_follows(spark, d):
    return traces.directly_follows(events(spark, d).filter("user_id IS NOT NULL"), CASE, ORDER, ATOM)


@query(FOLLOW + " SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM s WHERE bf IS NULL OR bf <> e GROUP BY user_id")
def destutter(spark, d):
    return traces.destutter(events(spark, d).filter("user_id IS NOT NULL"), CASE, ORDER, ATOM).groupBy(CASE).agg(F.count("*").cast("bigint").alias("n"))


LINES = FOLLOW + ", l AS (SELECT user_id, string_agg(e, '>' ORDER BY pos) AS variant FROM s GROUP BY user_id)"


def _cases(spark, d):
    return events(spark, d).filter("user_id IS NOT NULL")


@query(LINES + " SELECT variant, CAST(count(*) AS BIGINT) AS n_cases, min(user_id) AS representative FROM l GROUP BY variant")
def trace_variants(spark, d):
    return traces.variants(_cases(spark, d), CASE, ORDER, ATOM).drop("singleton")


@query(LINES + " SELECT variant, min(user_id) AS representative FROM l GROUP BY variant HAVING count(*) = 1")
def singleton_variants(spark, d):
    return traces.variants(_cases(spark, d), CASE, ORDER, ATOM).filter("singleton").select("variant", "representative")


@query(LINES + ", a AS (SELECT DISTINCT variant FROM l WHERE user_id % 2 = 0), b AS (SELECT DISTINCT variant FROM l WHERE user_id % 2 = 1), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) SELECT CAST(n AS BIGINT) AS common, CAST(na - n AS BIGINT) AS only_a, CAST(nb - n AS BIGINT) AS only_b, round(2.0 * n / (na + nb), 6) AS f1 FROM c")
def trace_set_agreement(spark, d):
    v = traces.sequences(_cases(spark, d), CASE, ORDER, ATOM).select(CASE, F.array_join("steps", ">").alias("variant"))
    side = v.groupBy("variant").agg(F.bool_or(F.col(CASE) % 2 == 0).alias("a"), F.bool_or(F.col(CASE) % 2 == 1).alias("b"))
    n, a, b = F.count_if(F.col("a") & F.col("b")), F.count_if("a"), F.count_if("b")
    return side.agg(n.cast("bigint").alias("common"), (a - n).cast("bigint").alias("only_a"), (b - n).cast("bigint").alias("only_b"), F.round(2.0 * n / (a + b), 6).alias("f1"))


MUTANT = """SELECT CAST(count(*) AS BIGINT) AS mutants, CAST(count_if(was AND NOT holds) AS BIGINT) AS detected FROM g"""


def _lasts(spark, d):
    """Numbered steps of whole cases, with the last (_1) and last but one (_2) position of an error and of a purchase."""
    case, steps = Window.partitionBy(CASE), traces.numbered(_cases(spark, d), CASE, ORDER)
    for a in ("error", "purchase"):
        at = F.when(F.col(ATOM) == a, F.col("pos"))
        steps = steps.withColumn(f"{a}_1", F.max(at).over(case))
        steps = steps.withColumn(f"{a}_2", F.max(F.when(F.col("pos") < F.col(f"{a}_1"), at)).over(case))
    return steps


def _detected(mutants, moved):
    """Counts of mutants, one a row of _lasts; `moved` gives the last position of an atom after the mutation."""
    holds = lambda e, p: e.isNull() | F.coalesce(p >= e, F.lit(False))
    was, now = holds(F.col("error_1"), F.col("purchase_1")), holds(moved("error"), moved("purchase"))
    return mutants.agg(F.count("*").cast("bigint").alias("mutants"), F.count_if(was & ~now).cast("bigint").alias("detected"))


STEPS = FOLLOW + ", h AS (SELECT * FROM s), w AS (SELECT user_id, max(pos) FILTER (e='error') AS le, max(pos) FILTER (e='purchase') AS lp FROM h GROUP BY user_id)"


@query(STEPS + ", g AS (SELECT m.user_id, m.pos AS mutant, any_value(w.le IS NULL OR coalesce(w.lp >= w.le, false)) AS was, (max(h.pos) FILTER (h.e='error')) IS NULL OR coalesce(max(h.pos) FILTER (h.e='purchase') >= max(h.pos) FILTER (h.e='error'), false) AS holds FROM h m JOIN h ON h.user_id = m.user_id AND h.pos <> m.pos JOIN w ON w.user_id = m.user_id GROUP BY m.user_id, m.pos) " + MUTANT)
def mutant_drop_step(spark, d):
    """A mutant for each step of each case of two steps or more; the rest of the case keeps its order."""
    steps = _lasts(spark, d).withColumn("n", F.count("*").over(Window.partitionBy(CASE))).filter("n > 1")
    return _detected(steps, lambda a: F.when(F.col("pos") == F.col(f"{a}_1"), F.col(f"{a}_2")).otherwise(F.col(f"{a}_1")))


@query(STEPS + ", m AS (SELECT a.user_id, a.pos FROM h a JOIN h b ON a.user_id = b.user_id AND b.pos = a.pos + 1 AND a.e <> b.e), q AS (SELECT m.user_id, m.pos AS mutant, h.e, CASE WHEN h.pos = m.pos THEN h.pos + 1 WHEN h.pos = m.pos + 1 THEN m.pos ELSE h.pos END AS p FROM m JOIN h ON h.user_id = m.user_id), g AS (SELECT q.user_id, mutant, any_value(w.le IS NULL OR coalesce(w.lp >= w.le, false)) AS was, (max(p) FILTER (e='error')) IS NULL OR coalesce(max(p) FILTER (e='purchase') >= max(p) FILTER (e='error'), false) AS holds FROM q JOIN w ON w.user_id = q.user_id GROUP BY q.user_id, mutant) " + MUTANT)
def mutant_swap_adjacent(spark, d):
    """A mutant for each two unequal neighbours of each case."""
    k = F.col("pos")
    steps = _lasts(spark, d).withColumn("next", F.lead(ATOM).over(Window.partitionBy(CASE).orderBy("pos"))).filter(F.col("next") != F.col(ATOM))
    return _detected(steps, lambda a: F.when(k == F.col(f"{a}_1"), k + 1).when(k + 1 == F.col(f"{a}_1"), k).otherwise(F.col(f"{a}_1")))


@query(FOLLOW + """, c AS (SELECT user_id, list(e ORDER BY pos) AS a FROM s GROUP BY user_id), p AS (SELECT x.user_id, x.a, y.a AS b FROM c x JOIN c y ON y.user_id = x.user_id + 1),
d AS (SELECT user_id, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS r FROM p
 UNION ALL SELECT user_id, i, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN a[i] = b[j] THEN r[j] + 1 ELSE r[j + 1] END]), lambda x, y: x || [greatest(x[len(x)], y[1])], [0::BIGINT]) FROM (SELECT p.user_id, p.a, p.b, d.i + 1 AS i, d.r FROM d JOIN p USING (user_id) WHERE d.i < len(p.a)))
SELECT user_id, r[len(r)] AS lcs, round(r[len(r)] / greatest(len(a), len(b)), 6) AS similarity FROM d JOIN p USING (user_id) WHERE i = len(a)""")
def lcs_neighbour_similarity(spark, d):
    """Similarity of each case to the case of the next id, over all their steps."""
    seq = traces.sequences(_cases(spark, d), CASE, ORDER, ATOM)
    other = seq.select((F.col(CASE) - 1).alias(CASE), F.col("steps").alias("other"))
    both = seq.join(other, CASE).select(CASE, F.greatest(F.size("steps"), F.size("other")).alias("longest"), common_length(F.col("steps"), F.col("other")).alias("lcs"))
    return both.select(CASE, "lcs", F.round(F.col("lcs") / F.col("longest"), 6).alias("similarity"))


@query("WITH s AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE user_id IS NOT NULL) SELECT user_id, CAST(count(*) AS BIGINT) AS changes, round(sum(abs(value - b)), 4) AS moved FROM s WHERE b IS NOT NULL AND b <> value GROUP BY user_id")
def state_mutation_audit(spark, d):
    out = traces.state_changes(events(spark, d).filter("user_id IS NOT NULL"), CASE, ORDER, "value")
    return out.groupBy(CASE).agg(F.count("*").cast("bigint").alias("changes"), F.round(F.sum(F.abs(F.col("value") - F.col("before"))), 4).alias("moved"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props_flatten(spark, d):
    df = events(spark, d).select("event_type", F.explode(F.from_json("props", "map<string, bigint>")).alias("name", "v")).filter("name = 'k'")
    return df.groupBy("event_type").agg(F.count("*").cast("bigint").alias("n"), F.sum("v").cast("bigint").alias("k"))


@query("WITH a AS (SELECT DISTINCT p_name AS action, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS x FROM part), t AS (SELECT min(p_partkey) AS pos, p_name || 's' AS task, regexp_replace(lower(p_name || 's'), '[^a-z0-9]', '', 'g') AS y FROM part GROUP BY p_name), c AS (SELECT action, task, CASE WHEN x = y THEN 1 ELSE 2 END AS tier, pos FROM a, t WHERE x = y OR levenshtein(x, y) <= 2) SELECT action, task, CAST(tier AS BIGINT) AS tier FROM c QUALIFY row_number() OVER (PARTITION BY action ORDER BY tier, pos) = 1")
def fuzzy_match_levenshtein(spark, d):
    part = table(spark, d, "part")
    tasks = part.groupBy("p_name").agg(F.min("p_partkey").alias("pos")).select(F.concat("p_name", F.lit("s")).alias("task"), "pos")
    return match.spelling(part.select(F.col("p_name").alias("action")), tasks).withColumn("tier", F.col("tier").cast("bigint"))


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') = 'supplier' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')")
def normalized_exact_match(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", plain(F.col("s_name")).alias("k"))
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("supplier"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("k"))
    return s.join(p, "k").select("s_suppkey", "p_partkey")


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT q.vec_id AS id, i.vec_id AS match, list_cosine_similarity(q.v, i.v) AS s FROM e q JOIN e i ON q.vec_id <> i.vec_id WHERE q.vec_id % 20 = 0) SELECT id, round(max(s), 4) AS similarity FROM c GROUP BY id")
def cosine_best_match(spark, d):
    """The best of all other vectors, for the stated query set: every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return match.by_vector(e.filter("id % 20 = 0"), e, least=-2.0).select("id", F.round("similarity", 4).alias("similarity"))


PRF = "round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 AND (tp + fp > 0 OR tp + fn > 0) AND (tp + fp > 0 AND tp + fn > 0) THEN 0.0 ELSE 2.0 * (CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END) * (CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END) / nullif((CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END) + (CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END), 0) END, 6) AS f1"
COUNTS = "CAST(count_if(t AND g) AS BIGINT) AS tp, CAST(count_if(NOT t AND g) AS BIGINT) AS fp, CAST(count_if(t AND NOT g) AS BIGINT) AS fn, CAST(count_if(NOT t AND NOT g) AS BIGINT) AS tn"


def _scores(df):
    return df.select(*df.columns, *[F.round(c, 6).alias(n) for c, n in zip(metrics.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"), strict=True)])


@query(f"WITH c AS (SELECT {COUNTS} FROM (SELECT quality = 1 AS t, toxic = 0 AS g FROM labels)) SELECT *, {PRF} FROM c")
def prf1_confusion(spark, d):
    return _scores(metrics.confusion(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0))


@query(f"WITH j AS (SELECT lang, quality = 1 AS t, toxic = 0 AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, {COUNTS} FROM j GROUP BY ROLLUP (lang)) SELECT *, {PRF} FROM c")
def prf1_by_stratum(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return _scores(metrics.confusion(df, F.col("quality") == 1, F.col("toxic") == 0, ["lang"], strata=True))


@query("""WITH RECURSIVE c AS (SELECT lang, CAST(sum(quality) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang),
b AS (SELECT lang, k, n, side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM c, (VALUES ('low'), ('high')) s(side)
 UNION ALL SELECT lang, k, n, side, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM (SELECT *, CASE side
  WHEN 'low' THEN list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) < 0.025
  ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) > 0.025 END AS up FROM b WHERE step < 45))
SELECT lang, k, n, round(max(CASE WHEN side = 'low' THEN CASE WHEN k = 0 THEN 0.0 ELSE lo END END), 6) AS low, round(max(CASE WHEN side = 'high' THEN CASE WHEN k = n THEN 1.0 ELSE lo END END), 6) AS high FROM b WHERE step = 45 GROUP BY lang, k, n""")
def clopper_pearson(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    counts = df.groupBy("lang").agg(F.sum("quality").cast("bigint").alias("k"), F.count("*").cast("bigint").alias("n"))
    return metrics.with_interval(counts, "k", "n").select("lang", "k", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY l_returnflag")
def pearson(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, d):
    return metrics.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"))


@query("WITH c AS (SELECT l_linestatus, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_linestatus, CAST(n AS BIGINT) AS n, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS high FROM c")
def fisher_z(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_linestatus").agg(metrics.pearson("l_quantity", "l_extendedprice").alias("r"), F.count("*").cast("bigint").alias("n"))
    low, high = metrics.fisher_z(F.col("r"), F.col("n"))
    return c.select("l_linestatus", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("WITH s AS (SELECT round(value / 500, 3) AS s, event_type = 'error' AS p FROM events), c AS (SELECT DISTINCT s AS tau FROM s UNION SELECT 0.0 UNION SELECT 1.0), b AS (SELECT s, count_if(p) AS np, count_if(NOT p) AS nn FROM s GROUP BY s), j AS (SELECT tau, coalesce(sum(np) FILTER (s < tau), 0) / (SELECT sum(np) FROM b) - coalesce(sum(nn) FILTER (s < tau), 0) / (SELECT sum(nn) FROM b) AS j FROM c, b GROUP BY tau) SELECT CAST(tau AS DOUBLE) AS tau, round(CAST(j AS DOUBLE), 6) AS j FROM j ORDER BY round(j, 12) DESC, tau LIMIT 1")
def youden_threshold(spark, d):
    df = events(spark, d).withColumn("s", F.round(F.col("value") / 500, 3))
    return metrics.youden(df, "s", F.col("event_type") == "error").select("tau", F.round("j", 6).alias("j"))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('1234' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, k <= n // 2 AS calibration FROM r")
def stratified_split(spark, d):
    return traces.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", "1234")


@query("WITH c AS (SELECT CAST(count(*) AS BIGINT) AS a, CAST(count_if(lang = 'en') AS BIGINT) AS b, CAST(count_if(lang = 'en' AND n_chars >= 500) AS BIGINT) AS c, CAST(count_if(lang = 'en' AND n_chars >= 500 AND source <> 'src0') AS BIGINT) AS e FROM documents) SELECT CAST(u.o AS BIGINT) AS ord, u.s AS stage, u.n AS n FROM c, LATERAL (VALUES (0, 'all', c.a), (1, 'english', c.b), (2, 'long', c.c), (3, 'other source', c.e)) u(o, s, n)")
def funnel(spark, d):
    return metrics.funnel(table(spark, d, "documents").select("lang", "n_chars", "source"), {"all": F.lit(True), "english": F.col("lang") == "en", "long": F.col("n_chars") >= 500, "other source": F.col("source") != "src0"})


#: A graph over part keys: each key points to its half and its third.
EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2)"


def _keys(spark, d):
    k = table(spark, d, "part").select("p_partkey")
    half = k.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return half.unionByName(k.filter("p_partkey > 2").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst"))).distinct()


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT max(src) AS node, 0 AS depth FROM e UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def graph_reach(spark, d):
    edges = _keys(spark, d)
    return graph.reachable(edges, edges.agg(F.max("src").alias("node"))).select("node", "depth")


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT max(src) AS node, CAST(max(src) AS VARCHAR) AS path FROM e UNION ALL SELECT e.dst, r.path || '>' || e.dst FROM r JOIN e ON e.src = r.node) SELECT path FROM r WHERE node = 1")
def graph_paths(spark, d):
    edges = _keys(spark, d)
    ends = spark.createDataFrame([(1,)], "node long")
    return graph.simple_paths(edges, edges.agg(F.max("src").alias("node")), ends).select(F.array_join("path", ">").alias("path"))


@query(FOLLOW + ", f AS (SELECT DISTINCT e AS src, nx AS dst FROM s WHERE nx IS NOT NULL) SELECT src, CAST(count(*) AS BIGINT) AS out_degree FROM f GROUP BY src HAVING count(*) > 1")
def branch_points(spark, d):
    return graph.branch_points(traces.directly_follows(events(spark, d).filter("user_id IS NOT NULL"), CASE, ORDER, ATOM))


@query("SELECT event_type AS node_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def node_census(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("node_type")).agg(F.count("*").cast("bigint").alias("n"))


RING = "e AS (SELECT n_nationkey AS src, (n_nationkey * 2) % 25 AS dst FROM nation)"


def _ring(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_nationkey") * 2 % 25).cast("bigint").alias("dst"))


@query(f"WITH RECURSIVE {RING}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), b AS (SELECT a.src AS node, a.dst AS mate FROM c a JOIN c z ON a.src = z.dst AND a.dst = z.src UNION SELECT src, src FROM e) SELECT CAST(node AS BIGINT) AS node, CAST(min(mate) AS BIGINT) AS component, CAST(count(DISTINCT mate) AS BIGINT) AS size FROM b GROUP BY node")
def scc_closure(spark, d):
    return graph.strong_components(_ring(spark, d)).select("node", "component", "size")


@query(f"WITH RECURSIVE {RING}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), l AS (SELECT src FROM c WHERE src = dst) SELECT DISTINCT CAST(c.src AS BIGINT) AS node FROM c JOIN l ON c.dst = l.src UNION SELECT CAST(src AS BIGINT) FROM l")
def divergence(spark, d):
    return graph.divergence(_ring(spark, d))


#: x: numbered orders of a customer. e: moves between them, with the atom of the order that is left.
ORDERS = """WITH RECURSIVE x AS (SELECT o_custkey AS graph, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS last FROM orders),
e AS (SELECT graph, r AS src, r + h AS dst, CASE st WHEN 'P' THEN NULL ELSE st END AS label FROM x, (VALUES (1), (2)) v(h) WHERE r + h <= last AND (h = 1 OR r % 3 = 0))"""


def _order_graphs(spark, d):
    """A graph a customer with orders: orders in time, with a short cut past every third one.

    A customer with one order gives one row without dst: a node without edges. Node numbers have two digits, or as many as the last one of their graph."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.row_number().over(by).alias("k"))
    last = F.max("k").over(Window.partitionBy("o_custkey"))
    o = o.withColumn("last", last)
    hop = F.when(F.col("k") % 3 == 0, F.array(F.col("k") + 1, F.col("k") + 2)).otherwise(F.array(F.col("k") + 1))
    hop = F.when(F.col("last") == 1, F.array(F.lit(None).cast("int"))).otherwise(F.filter(hop, lambda x: x <= F.col("last")))
    e = o.select(F.col("o_custkey").cast("string").alias("graph"), F.col("k"), "o_orderstatus", "last", F.explode(hop).alias("to"))
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(F.col("last").cast("string"))), F.lit("0")))
    return e.select("graph", name(F.col("k")).alias("src"), name(F.col("to")).alias("dst"), name(F.lit(1)).alias("root"), F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array(F.col("o_orderstatus"))).alias("label"))


@query(ORDERS + """, u AS (SELECT graph, r AS n FROM x), q AS (SELECT a.graph, b.n AS gone, 1::BIGINT AS n FROM (SELECT DISTINCT graph FROM u) a JOIN u b USING (graph) WHERE b.n <> 1 UNION SELECT q.graph, q.gone, e.dst FROM q JOIN e ON e.graph = q.graph AND e.src = q.n AND e.dst <> q.gone),
dom AS (SELECT u.graph, u.n, d.n AS d FROM u JOIN u d USING (graph) WHERE u.n = d.n OR d.n = 1 OR NOT EXISTS (SELECT 1 FROM q WHERE q.graph = u.graph AND q.gone = d.n AND q.n = u.n)),
size AS (SELECT graph, n, count(*) AS c FROM dom GROUP BY ALL),
up AS (SELECT dom.graph, dom.n, arg_max(dom.d, size.c) AS i FROM dom JOIN size ON size.graph = dom.graph AND size.n = dom.d WHERE dom.d <> dom.n GROUP BY ALL),
fr AS (SELECT DISTINCT e.graph, dom.d AS n, e.dst AS f FROM e JOIN dom ON dom.graph = e.graph AND dom.n = e.src WHERE dom.d = e.dst OR NOT EXISTS (SELECT 1 FROM dom z WHERE z.graph = e.graph AND z.n = e.dst AND z.d = dom.d)),
nm AS (SELECT graph, r AS n, 'n' || lpad(CAST(r AS VARCHAR), CAST(greatest(2, len(CAST(last AS VARCHAR))) AS INTEGER), '0') AS name FROM x)
SELECT CAST(u.graph AS VARCHAR) AS graph, m.name AS node, i.name AS immediate, (SELECT string_agg(y.name, ',' ORDER BY y.name) FROM dom JOIN nm y ON y.graph = dom.graph AND y.n = dom.d WHERE dom.graph = u.graph AND dom.n = u.n) AS dominators,
 coalesce((SELECT string_agg(y.name, ',' ORDER BY y.name) FROM fr JOIN nm y ON y.graph = fr.graph AND y.n = fr.f WHERE fr.graph = u.graph AND fr.n = u.n), '') AS frontier
FROM u JOIN nm m USING (graph, n) LEFT JOIN up USING (graph, n) LEFT JOIN nm i ON i.graph = u.graph AND i.n = up.i""")
def dominators(spark, d):
    return graph.dominators(_order_graphs(spark, d)).select("graph", "node", "immediate", F.array_join("dominators", ",").alias("dominators"), F.array_join("frontier", ",").alias("frontier"))


def _systems(spark, d):
    g = _order_graphs(spark, d)
    return g.select(F.col("graph").alias("sys"), "src", "label", "dst", F.col("root").alias("initial"))


#: k: the class of each state, from the last one back, as these graphs have no cycle. A silent state is one with a state behind it
#: that can do all it does besides; l1, l2 and m1, m2 are classes and moves of the next state and of the one after it.
CLASSES = ORDERS + """, lab AS (SELECT graph, last, list(st ORDER BY r) AS sts FROM x GROUP BY graph, last),
b AS (SELECT graph, last, last AS r, sts, md5('') AS l1, CAST([] AS VARCHAR[]) AS m1, CAST(NULL AS VARCHAR) AS l2, CAST([] AS VARCHAR[]) AS m2 FROM lab
 UNION ALL SELECT graph, last, r, sts, coalesce(same, md5(array_to_string(own, ' '))), CASE same WHEN c1 THEN k1 WHEN c2 THEN k2 ELSE own END, c1, k1 FROM (
 SELECT *, CASE WHEN st = 'P' AND (c2 IS NULL OR c1 = c2 OR list_contains(k1, ':' || c2)) THEN c1 WHEN st = 'P' AND list_contains(k2, ':' || c1) THEN c2 END AS same,
 list_sort(list_distinct(list_transform(list_filter([c1, c2], lambda c: c IS NOT NULL), lambda c: CASE st WHEN 'P' THEN '' ELSE st END || ':' || c))) AS own FROM (
 SELECT graph, last, r - 1 AS r, sts, sts[r - 1] AS st, l1 AS c1, m1 AS k1, CASE WHEN (r - 1) % 3 = 0 THEN l2 END AS c2, m2 AS k2 FROM b WHERE r > 1))),
k AS (SELECT graph, r, l1 AS class, last, 'n' || lpad(CAST(r AS VARCHAR), CAST(greatest(2, len(CAST(last AS VARCHAR))) AS INTEGER), '0') AS state FROM b),
n AS (SELECT *, min(state) OVER (PARTITION BY graph, class) AS block FROM k)"""


@query(CLASSES + " SELECT CAST(graph AS VARCHAR) AS sys, state, block, false AS divergent FROM n")
def partition_refinement(spark, d):
    """Blocks are named by their least state."""
    return systems.stuttering(_systems(spark, d))


@query(CLASSES + " SELECT DISTINCT CAST(e.graph AS VARCHAR) AS sys, a.block AS src, coalesce(e.label, '') AS label, z.block AS dst FROM e JOIN n a ON a.graph = e.graph AND a.r = e.src JOIN n z ON z.graph = e.graph AND z.r = e.dst WHERE e.label IS NOT NULL OR a.block <> z.block")
def quotient(spark, d):
    q = systems.quotients(_systems(spark, d))
    return q.select("sys", "src", F.array_join("label", "&").alias("label"), "dst")


@query(CLASSES + ", s AS (SELECT n.graph, CAST(n.graph AS VARCHAR) AS sys, n.class, n.last, (SELECT count(*) FROM e WHERE e.graph = n.graph) AS moves FROM n WHERE r = 1) SELECT sys, first(sys) OVER (PARTITION BY class ORDER BY last, moves, sys) AS representative, count(*) OVER (PARTITION BY class) = 1 AS singleton FROM s")
def quotient_clusters(spark, d):
    return systems.clusters(_systems(spark, d)).drop("signature")


@query(ORDERS + """, own AS (SELECT x.graph, list(DISTINCT label) FILTER (label IS NOT NULL) AS atoms FROM x LEFT JOIN e ON e.graph = x.graph AND e.src = x.r GROUP BY x.graph),
z AS (SELECT graph, max(r) AS stop FROM x GROUP BY graph),
t AS (SELECT graph, 1::BIGINT AS n, CAST([] AS VARCHAR[]) AS run FROM z UNION SELECT t.graph, e.dst, CASE WHEN label IS NULL THEN run ELSE run || [label] END FROM t JOIN e ON e.graph = t.graph AND e.src = t.n),
runs AS (SELECT t.graph, run FROM t JOIN z ON z.graph = t.graph AND z.stop = t.n),
j AS (SELECT graph, 'open_then_filled' AS rule, run, len(run) > 0 AND coalesce(list_last(list_filter(run, lambda a: a IN ('O', 'F'))), 'F') = 'F' AS ok FROM runs UNION ALL SELECT graph, 'no_open_first', run, len(run) > 0 AND coalesce(list_filter(run, lambda a: a IN ('O', 'F'))[1], 'F') = 'F' FROM runs),
w AS (SELECT graph, rule, min({'n': len(run), 'r': run}) FILTER (NOT ok) AS bad FROM j GROUP BY ALL),
m AS (SELECT w.*, list_sort(list_filter(['F', 'O'], lambda a: NOT coalesce(list_contains(atoms, a), false))) AS missing FROM w JOIN own USING (graph))
SELECT CAST(graph AS VARCHAR) AS sys, rule, CASE WHEN len(missing) > 0 THEN 'INCONCLUSIVE' WHEN bad IS NULL THEN 'COMPLIANT' ELSE 'VIOLATION' END AS verdict, CASE WHEN len(missing) > 0 OR bad IS NULL THEN '' ELSE array_to_string(bad.r, ' > ') END AS counterexample, array_to_string(missing, ',') AS unmatched, false AS cyclic FROM m""")
def monitor_product(spark, d):
    c = systems.conformance(_systems(spark, d), {"open_then_filled": 'G("O" -> F("F"))', "no_open_first": '!"O" W "F"'})
    return c.select("sys", "rule", "verdict", F.array_join("counterexample", " > ").alias("counterexample"), F.array_join("unmatched", ",").alias("unmatched"), "cyclic")


@query("WITH a AS (SELECT event_type AS x FROM events UNION SELECT o_orderstatus FROM orders UNION SELECT role FROM conversations) SELECT 'F ' || x AS rule, CASE WHEN x IN (SELECT event_type FROM events) THEN NULL ELSE x END AS unmatched FROM a UNION ALL SELECT 'G(' || x || ' -> F purchase)', CASE WHEN x IN (SELECT event_type FROM events) THEN NULL ELSE x END FROM a")
def atom_gate(spark, d):
    """Rules on the atoms of three logs against the atoms of one of them."""
    known = events(spark, d).select(F.col("event_type").alias("atom")).distinct()
    others = [table(spark, d, "orders").select("o_orderstatus"), table(spark, d, "conversations").select("role")]
    every = known.union(others[0]).union(others[1]).distinct()
    rules = every.select(F.inline(F.array(F.struct(F.concat(F.lit("F "), "atom").alias("rule"), F.array("atom").alias("atoms")), F.struct(F.concat(F.lit("G("), "atom", F.lit(" -> F purchase)")).alias("rule"), F.array_distinct(F.array("atom", F.lit("purchase"))).alias("atoms")))))
    return gates.atom_gate(rules, known).select("rule", F.nullif(F.array_join("unmatched", ","), F.lit("")).alias("unmatched"))


@query("""WITH p AS (SELECT p_partkey AS ord, ['P0', 'P1', 'P2', 'P4'][p_size % 4 + 1] AS tier, p_partkey % 5 AS k, 'b' || replace(p_brand, 'Brand#', '') AS b FROM part),
f AS (SELECT *, CASE k WHEN 0 THEN 'F(done(' || b || '))' WHEN 1 THEN 'F node(' || b || ')' WHEN 2 THEN 'G(' || b || ' <= 10)' WHEN 3 THEN 'G(start(' || b || ') -> F(done(' || b || ')))' ELSE '!start(' || b || ') W done(a)' END AS formula FROM p),
r AS (SELECT *, CASE WHEN tier = 'P2' THEN 'tier is not checked' WHEN k = 1 THEN 'node atom' WHEN k = 3 THEN 'vacuous conditional' WHEN k = 2 THEN 'comparison' END AS reason FROM f),
t AS (SELECT *, row_number() OVER w AS n, first(tier) OVER w AS lead FROM r WINDOW w AS (PARTITION BY formula, reason IS NULL ORDER BY tier, ord))
SELECT tier, ord, coalesce(reason, CASE WHEN n > 1 AND lead = tier THEN 'repeated in tier' WHEN n > 1 THEN 'repeated from ' || lead END) AS reason FROM t""")
def tier_gate_reasons(spark, d):
    """Five kinds of rules on the brands of parts, in four tiers."""
    part, b = table(spark, d, "part"), F.concat(F.lit("b"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")))
    tier = F.element_at(F.array(*map(F.lit, ("P0", "P1", "P2", "P4"))), F.col("p_size") % 4 + 1)
    kinds = [F.concat(F.lit("F(done("), b, F.lit("))")), F.concat(F.lit("F node("), b, F.lit(")")), F.concat(F.lit("G("), b, F.lit(" <= 10)")), F.concat(F.lit("G(start("), b, F.lit(") -> F(done("), b, F.lit(")))")), F.concat(F.lit("!start("), b, F.lit(") W done(a)"))]
    rows = part.select(tier.alias("tier"), F.col("p_partkey").alias("ord"), F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int")).alias("formula"))
    policy = spark.createDataFrame([("P0", True), ("P1", True), ("P2", False), ("P4", True)], "tier string, conformance_check boolean")
    return gates.gate(rows, policy).select("tier", "ord", "reason")


@query(FOLLOW + ", f AS (SELECT DISTINCT e AS src, nx AS dst FROM s WHERE nx IS NOT NULL AND e <> nx) SELECT min(src) AS src, dst, '!' || dst || ' W ' || min(src) AS formula FROM f GROUP BY dst HAVING count(DISTINCT src) = 1")
def synth_precedence(spark, d):
    f = traces.directly_follows(_cases(spark, d), CASE, ORDER, ATOM)
    return synth.precedence_from_follows(f.filter("src <> dst").select("src", "dst"))


@query("WITH s AS (SELECT conv_id, role AS e, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations), f AS (SELECT DISTINCT e AS src, nx AS dst FROM s WHERE nx IS NOT NULL AND e <> nx) SELECT min(src) AS src, dst, '!' || dst || ' W ' || min(src) AS formula FROM f GROUP BY dst HAVING count(DISTINCT src) = 1")
def synth_precedence_turns(spark, d):
    """As synth_precedence, on the turns of conversations: events follow each other in every order and give no rule, turns don't."""
    f = traces.directly_follows(table(spark, d, "conversations"), "conv_id", ["turn"], "role")
    return synth.precedence_from_follows(f.filter("src <> dst").select("src", "dst"))


@query("SELECT event_type AS atom, CASE WHEN count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events) THEN 'F(' || event_type || ')' ELSE 'G(' || event_type || ' -> F(' || event_type || '))' END AS formula FROM events GROUP BY event_type")
def synth_coverage(spark, d):
    return synth.coverage_rules(events(spark, d), CASE, ATOM)


@query("SELECT p_partkey AS k FROM part INTERSECT SELECT s_suppkey FROM supplier")
def setops_intersect(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT s_suppkey FROM supplier")
def setops_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("SELECT CAST(count(*) AS BIGINT) AS matched FROM (SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer)")
def setops_multiset(spark, d):
    return metrics.multiset_matches(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), ["k"])


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_resume(spark, d):
    """What is left to do: documents that have no label yet."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_filter(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("WITH a AS (SELECT p_partkey AS id, p_type AS kind, p_name AS text FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS id, p_type AS kind, p_name AS text FROM part WHERE p_partkey % 2 = 1), x AS (SELECT *, row_number() OVER (PARTITION BY kind, text ORDER BY id) AS rn FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY kind, text ORDER BY id) AS rn FROM b), m AS (SELECT x.id AS left_id, y.id AS right_id, 'text' AS how FROM x JOIN y USING (kind, text, rn)), u AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM a WHERE id NOT IN (SELECT left_id FROM m)), v AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM b WHERE id NOT IN (SELECT right_id FROM m)) SELECT * FROM m UNION ALL SELECT u.id, v.id, 'position' FROM u JOIN v USING (kind, rn)")
def greedy_text_match(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("text"))
    return match.greedy(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), "kind", "text")


@query("SELECT p_brand, arg_min(p_partkey, struct_pack(a := p_size, b := p_partkey)) AS representative, CAST(count(*) AS BIGINT) AS members FROM part GROUP BY p_brand")
def representative_topk(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("representative"), F.count("*").cast("bigint").alias("members"))


#: Turns of a conversation as a second log.
@query("WITH s AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, turn FROM conversations), v AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS lu, max(turn) FILTER (role = 'assistant') AS la FROM s GROUP BY conv_id) SELECT conv_id, lu IS NULL OR coalesce(la >= lu, false) AS answered FROM v")
def conversation_answered(spark, d):
    return temporal.verdicts(table(spark, d, "conversations"), {"answered": "G(user -> F(assistant))"}, "conv_id", ["turn"], "role")


from . import queries_more  # noqa: E402, F401  (registers further queries in the same dictionaries)
