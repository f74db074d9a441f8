"""URL filter: rules first, then a character language-model ratio.

A rule (host and path, allow or block) fits its host and all subdomains if
the url's path starts with the rule's; the longest fitting rule decides.
The urls that rules allow and block, less a held-out quarter (by the url's
md5), train two variable-order Markov models over a folded alphabet:
Witten-Bell smoothing from ``ORDER`` characters of context down to none, so a
context that was not seen escapes to the next shorter one.  A url without a
rule is judged by the difference of its log-likelihoods per character.  The
threshold is the cut with the best balanced accuracy on the held-out quarter,
which the models have not seen; of equal cuts the widest gap wins, then the
lowest.

Only strings that occur in some url are stored.  They are counted with
map-side combination; shorter strings follow from the longer ones, and every
join of two lengths meets at most one string per symbol.  Of the strings of
full length, those that make up more than one in ``HEAD`` of all places (so
fewer than ``HEAD``) are broadcast; the rest, none of them frequent, are
joined.  Sums are whole numbers of millionths, so the order of rows does not
matter.  DataFrame functions only.

NULL urls and urls without ``://`` have empty host and path; a NULL or empty
url scores 0.  A model without training urls is uniform; without held-out
urls of both kinds the threshold is 0.  Repeated rows train as often as they
occur.  Between rules of equal length the first wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

# The rules (verdict, rule).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER, PAD = "~", "^"
# Symbols of a folded url: 0 stands for every digit, OTHER for all else.
ALPHABET = LOWER + "0./-_?=&%:#" + OTHER
A = len(ALPHABET)
ORDER = 5  # characters of context
HEAD = 1 << 16  # strings broadcast, at most
UNIT = 1_000_000  # scores are summed in millionths
STEP = 10_000  # of them: a bucket of the calibration, clipped to CLIP buckets on either side
CLIP = 10_000


def lower(c: Column) -> Column:
    """A-Z in lower case; nothing else changes."""
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s).*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower(host), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``verdict, rule`` of the longest rule that fits, else NULL."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def strings(url: Column, order: int = ORDER) -> Column:
    """The strings of ``order + 1`` symbols that end at each character."""
    rest = F.regexp_replace(lower(F.coalesce(url, F.lit(""))), r"^(?s).*?://", "")
    folded = F.regexp_replace(F.regexp_replace(rest, "[0-9]", "0"), r"[^a-z0./\-_?=&%:#]", OTHER)
    return F.regexp_extract_all(F.concat(F.lit(PAD * order), folded), F.lit(f"(?=(.{{{order + 1}}}))"), 1)


def smoothed(n, context, kinds, shorter) -> Column:
    """Witten-Bell: a seen context gives its new symbols the weight of its kinds."""
    return F.when(context > 0, (n + kinds * shorter) / (context + kinds)).otherwise(shorter)


def model(places: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, n, delta`` of every string of ``places`` (``gram, verdict``; a NULL verdict does not train): how often it
    occurs, and the accepted model's log probability of its last symbol after the others less the rejected model's."""
    longest = (
        places.groupBy("gram")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("verdict") == "allow").alias("g"),
            F.count_if(F.col("verdict") == "block").alias("r"),
        )
        .checkpoint()
    )
    levels = [longest]
    for _ in range(order):
        shorter = levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram"))
        levels.append(shorter.agg(*[F.sum(c).alias(c) for c in "ngr"]))
    rows = None
    for length, level in enumerate(reversed(levels), 1):
        # A context has at most as many rows as there are symbols.
        context = Window.partitionBy(F.substring("gram", 1, length - 1))
        level = level.select(
            F.col("gram"),
            F.expr("substring(gram, 2)").alias("tail"),
            "n",
            *[c for k in "gr" for c in (F.col(k), F.sum(k).over(context).alias(f"all_{k}"), F.count_if(F.col(k) > 0).over(context).alias(f"kinds_{k}"))],
        )
        if rows is None:
            level = level.withColumns({f"p_{k}": F.lit(1.0 / A) for k in "gr"})
        else:
            level = level.join(rows.select(F.col("gram").alias("tail"), "p_g", "p_r"), "tail")
        rows = level.select(
            "gram", "n", *[smoothed(F.col(k), F.col(f"all_{k}"), F.col(f"kinds_{k}"), F.col(f"p_{k}")).alias(f"p_{k}") for k in "gr"]
        )
    delta = F.round((F.log("p_g") - F.log("p_r")) * UNIT).cast("long")
    return rows.select("gram", "n", delta.alias("delta"))


def sums(places: DataFrame, deltas: DataFrame) -> DataFrame:
    """``row, score``: the mean of the deltas of each row of ``places`` (``row, gram``), in whole millionths."""
    total = deltas.agg(F.sum("n")).scalar()
    marked = deltas.select("gram", "delta", (F.col("n") * HEAD > total).alias("often"))
    often = marked.where("often").drop("often")  # fewer than HEAD rows, whatever the table
    seldom = marked.where("NOT often").drop("often")
    common = places.join(F.broadcast(often), "gram").select("row", "delta")
    rare = places.join(F.broadcast(often.select("gram")), "gram", "left_anti").join(seldom, "gram").select("row", "delta")
    both = common.union(rare).groupBy("row").agg(F.sum("delta").alias("sum"), F.count(F.lit(1)).alias("count"))
    return both.select("row", F.floor(F.col("sum") / F.col("count")).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (``least``): the cut of the held-out scores (``score, verdict``) with the best balanced accuracy, else 0."""
    bucket = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-CLIP)), F.lit(CLIP))
    # At most 2 * CLIP + 1 rows from here on.
    counts = scored.groupBy(bucket.alias("bucket")).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")])
    up = Window.orderBy("bucket")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cuts = counts.select(
        "bucket",
        F.lag("bucket").over(up).alias("last"),
        F.try_divide(F.sum("block").over(before), F.sum("block").over(whole)).alias("out"),
        F.try_divide(F.sum("allow").over(before), F.sum("allow").over(whole)).alias("lost"),
    ).where("out IS NOT NULL AND lost IS NOT NULL AND last IS NOT NULL")
    best = F.max_by("cut", F.struct(F.round(F.col("out") - F.col("lost"), 9), F.col("bucket") - F.col("last"), -F.col("bucket")))
    return cuts.withColumn("cut", (F.col("last") + 1 + F.col("bucket")) * (STEP // 2)).agg(F.coalesce(best, F.lit(0)).alias("least"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = ORDER,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row."""
    ensure_checkpoint_dir(pages.sparkSession)
    url = F.col(url_col).cast("string")
    host, path = split_url(url)
    rows = (
        pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
        .select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), F.monotonically_increasing_id().alias("row"))
        .withColumn("held_out", F.coalesce(F.substring(F.md5("url"), 1, 1) < "4", F.lit(False)))
        .checkpoint()
    )
    learnt = F.when(~F.col("held_out"), F.col("fit.verdict")).alias("verdict")
    deltas = model(rows.select(learnt, F.explode(strings(F.col("url"), order)).alias("gram")), order).checkpoint()
    scores = sums(rows.select("row", F.explode(strings(F.col("url"), order)).alias("gram")), deltas)
    scored = rows.join(scores, "row", "left").withColumn("score", F.coalesce("score", F.lit(0))).checkpoint()
    least = threshold(scored.where("held_out AND fit IS NOT NULL").select("score", "fit.verdict")).scalar()
    return scored.withColumn("least", least).select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("score") >= F.col("least"), F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        (F.col("score") / UNIT).alias("score"),
    )


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> str:
    """The same in DuckDB, over the table ``pages``."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, _, rest = rule.partition("/")
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}')", verdict, rule))
    verdicts = " ".join(f"WHEN {c} THEN '{v}'" for c, v, _ in fits)
    names = " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in fits)

    # Every level straight from the places: counts of strings, of contexts, and the chain of probabilities.
    levels = []
    for k in range(order + 1):
        at = order + 1 - k  # the string of k + 1 symbols starts here
        p = {
            c: f"CASE WHEN all_{c} > 0 THEN ({c} + kinds_{c} * {f'p_{c}' if k else f'(1.0::DOUBLE / {A})'}) "
            f"/ CAST(all_{c} + kinds_{c} AS DOUBLE) ELSE {f'p_{c}' if k else f'(1.0::DOUBLE / {A})'} END"
            for c in "gr"
        }
        shorter = f"JOIN (SELECT gram AS tail, p_g, p_r FROM p{k}) USING (tail)" if k else ""
        levels.append(f"""
n{k} AS (
  SELECT substr(gram, {at}) AS gram, substr(gram, {at + 1}) AS tail, substr(gram, {at}, {k}) AS context,
    count(*) FILTER (learnt = 'allow') AS g, count(*) FILTER (learnt = 'block') AS r
  FROM grams GROUP BY ALL),
c{k} AS (
  SELECT context, sum(g) AS all_g, sum(r) AS all_r, count(*) FILTER (g > 0) AS kinds_g, count(*) FILTER (r > 0) AS kinds_r
  FROM n{k} GROUP BY context),
p{k + 1} AS (SELECT gram, {p['g']} AS p_g, {p['r']} AS p_r FROM n{k} JOIN c{k} USING (context) {shorter}),""")
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS row, page_id, url, coalesce(substr(md5(url), 1, 1) < '4', false) AS held_out,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
    regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '^(?s).*?://', '') AS low
  FROM pages),
named AS (
  SELECT row, page_id, held_out, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(low, '[0-9]', '0', 'g'), '[^a-z0./\\-_?=&%:#]', '{OTHER}', 'g') AS folded
  FROM cut),
judged AS (SELECT *, CASE {verdicts} END AS fit, CASE {names} END AS rule FROM named),
grams AS (
  SELECT row, CASE WHEN NOT held_out THEN fit END AS learnt, substr('{PAD * order}' || folded, i, {order + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(folded) + 1)) AS i FROM judged)),{"".join(levels)}
deltas AS (SELECT gram, CAST(round((ln(p_g) - ln(p_r)) * {UNIT}) AS BIGINT) AS delta FROM p{order + 1}),
means AS (
  SELECT row, CAST(floor(CAST(sum(delta) AS DOUBLE) / count(*)) AS BIGINT) AS micro FROM grams JOIN deltas USING (gram) GROUP BY row),
scored AS (SELECT j.*, coalesce(m.micro, 0) AS micro FROM judged j LEFT JOIN means m USING (row)),
counts AS (
  SELECT CAST(least(greatest(floor(micro / {STEP}.0), {-CLIP}), {CLIP}) AS BIGINT) AS bucket,
    count(*) FILTER (fit = 'allow') AS good, count(*) FILTER (fit = 'block') AS bad
  FROM scored WHERE held_out AND fit IS NOT NULL GROUP BY bucket),
cuts AS (
  SELECT bucket, lag(bucket) OVER up AS last,
    CAST(sum(bad) OVER before AS DOUBLE) / nullif(sum(bad) OVER (), 0) AS out,
    CAST(sum(good) OVER before AS DOUBLE) / nullif(sum(good) OVER (), 0) AS lost
  FROM counts WINDOW up AS (ORDER BY bucket), before AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
least AS (
  SELECT coalesce((
    SELECT (last + 1 + bucket) * {STEP // 2} FROM cuts WHERE last IS NOT NULL AND out IS NOT NULL AND lost IS NOT NULL
    ORDER BY round(out - lost, 9) DESC, bucket - last DESC, bucket LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule,
  coalesce(fit, CASE WHEN micro >= least THEN 'allow' ELSE 'block' END) AS verdict, micro / {UNIT}.0::DOUBLE AS score
FROM scored CROSS JOIN least
"""
