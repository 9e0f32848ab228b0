"""URL filter: rules first, for the rest the ratio of two character language models.

The text of a URL is its host and path, digits counting as one symbol. URLs that a rule allows train the model of accepted ones, those
that a rule blocks the model of rejected ones. Both are Markov models of variable order: the probability of a character after up to
``ORDER`` others mixes all shorter contexts, by Witten and Bell's weights (a context seen n times with t distinct successors leaves
t / (n + t) to the next shorter one, the empty context to a uniform choice among all characters). A URL scores the logarithm of the
ratio of its two probabilities, divided by its symbols; the threshold is calibrated on the labelled texts that were held out of both models.

The table of n-grams has a row for every n-gram of any URL, seen in training or not, so each place of a text meets one row, and no
context has to be looked for while scoring. Logarithms are whole millionths, so sums do not depend on the order of rows.
Only DataFrame functions are used.

Defined cases: a null URL, or one without ``://``, has empty host and path, which no rule fits and the models judge; rows with a null or
repeated page_id stay as they are; equal host and path (digits aside) get one verdict of the method; a URL of any length is taken whole;
without training texts of both kinds everything is allowed, without held-out ones of both kinds the threshold is 0; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save, table

#: Verdicts and rules (host and path) of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Characters of context at most; parts of a nat in a score.
ORDER, SCALE = 4, 1_000_000
#: First hex digits of the MD5 of texts that calibrate and do not train.
HELD = "012"
#: Width of the classes of scores that thresholds are looked for between, and the number of them on each side of 0.
WIDTH, CLASSES = 1000, 10_000
#: Rows up to which the table of n-grams is sent to all tasks; a larger one is joined.
BROADCAST_ROWS = 200_000
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Begin a text ORDER times, and end it.
BEGIN, END = "\x02", "\x03"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _sorted(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """verdict, rule, host and path, the longest rule first; of equally long ones the one with the longer host."""
    split = [(v, r, r.partition("/")[0].lower(), "".join(r.partition("/")[1:])) for v, r in rules]
    return sorted(split, key=lambda x: (-len(x[1]), -len(x[2]), x[1]))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does. The rules are a short list."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")))
        for v, r, h, p in _sorted(rules)
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def texts_of(urls: DataFrame) -> DataFrame:
    """text, accepted, rejected (rows that a rule allows or blocks) and held for each distinct text of ``urls`` (text, verdict)."""
    g = urls.groupBy("text").agg(F.count_if(F.col("verdict") == "allow").alias("accepted"), F.count_if(F.col("verdict") == "block").alias("rejected"))
    return g.withColumn("held", F.substring(F.md5("text"), 1, 1).isin(*HELD))


def grams_of(text: Column) -> Column:
    """Every ORDER + 1 characters in a row of a text between its marks, one for each character and the end."""
    return F.regexp_extract_all(F.concat(F.lit(BEGIN * ORDER), text, F.lit(END)), F.lit("(?s)(?=(.{%d}))." % (ORDER + 1)), F.lit(1))


def model(texts: DataFrame) -> DataFrame:
    """gram, delta: millionths of a nat by which the accepted texts' model gives the last character of ``gram`` more than the other one."""
    counted = lambda name: F.when(F.col("held"), 0).otherwise(F.col(name)).alias(name)
    each = texts.select(F.explode(grams_of(F.col("text"))).alias("gram"), counted("accepted"), counted("rejected"))
    grams = save(each.groupBy("gram").agg(F.sum("accepted").alias("n0"), F.sum("rejected").alias("n1")), "grams")
    symbols = grams.select(F.right("gram", F.lit(1))).distinct().count()
    below = None
    for k in range(ORDER + 1):
        level = grams if k == ORDER else grams.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        of = Window.partitionBy(F.substring("gram", 1, k))
        level = level.select("gram", *("n0", "n1"), *(F.sum(f"n{c}").over(of).alias(f"all{c}") for c in (0, 1)), *(F.count_if(F.col(f"n{c}") > 0).over(of).alias(f"kinds{c}") for c in (0, 1)))
        if k:
            level = level.withColumn("shorter", F.right("gram", F.lit(k))).join(below, "shorter")
        rest = lambda c: F.col(f"below{c}") if k else F.lit(1.0) / symbols  # noqa: B023, E731
        mixed = [F.when(F.col(f"all{c}") > 0, (F.col(f"n{c}") + F.col(f"kinds{c}") * rest(c)) / (F.col(f"all{c}") + F.col(f"kinds{c}"))).otherwise(rest(c)) for c in (0, 1)]
        below = level.select(F.col("gram").alias("shorter"), mixed[0].alias("below0"), mixed[1].alias("below1"))
    return below.select(F.col("shorter").alias("gram"), F.round((F.log("below0") - F.log("below1")) * SCALE).cast("long").alias("delta"))


def scores(texts: DataFrame, deltas: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """text, accepted, rejected, held and score (millionths of a nat a symbol, whole). ``deltas`` is a written table."""
    few = deltas.count() <= broadcast_rows
    each = texts.select("*", F.explode(grams_of(F.col("text"))).alias("gram")).join(F.broadcast(deltas) if few else deltas, "gram")
    return each.groupBy(*texts.columns).agg(F.floor(F.sum("delta").cast("double") / F.count(F.lit(1))).alias("score"))


def threshold(scored: DataFrame) -> int:
    """The score from which held-out texts are accepted: between two neighbouring classes of scores, where the share of accepted rows
    above less that of rejected rows above is largest (ties: nearest to 0, then the smaller)."""
    at = F.greatest(F.least(F.floor(F.col("score") / WIDTH), F.lit(CLASSES)), F.lit(-CLASSES)).alias("class")
    g = scored.where("held and accepted + rejected > 0").groupBy(at).agg(F.sum("accepted").alias("n0"), F.sum("rejected").alias("n1"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("class"))  # 2 * CLASSES + 1 rows at most
    everything = Window.partitionBy(F.lit(1))
    share = lambda c: F.try_divide(F.sum(f"n{c}").over(w), F.sum(f"n{c}").over(everything))
    cut = F.floor((F.col("class") * WIDTH + (F.coalesce(F.lead("class").over(w), F.col("class") - 1) + 1) * WIDTH) / 2)
    best = g.select(cut.alias("cut"), (share(0) - share(1)).alias("gain")).where("gain is not null").orderBy(F.desc("gain"), F.abs("cut"), "cut").first()
    return best["cut"] if best else 0


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row of ``pages`` (page_id, url)."""
    told = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    told = told.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "_r.rule", "_r.verdict")
    text = F.translate(F.concat("host", "path"), DIGITS, DIGITS[0] * 10).alias("text")
    texts = save(texts_of(told.select(text, "verdict")), "texts")
    kinds = texts.where("not held").agg(F.sum("accepted"), F.sum("rejected")).first()
    open_rows = told.where("rule is null")
    if all(kinds):
        scored = save(scores(texts, save(model(texts), "model")), "scores")
        cut = threshold(scored)
        verdict = F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict")
        open_rows = open_rows.drop("verdict").withColumn("text", text).join(scored.select("text", verdict), "text")
    else:
        open_rows = open_rows.withColumn("verdict", F.lit("allow"))
    return told.where("rule is not null").unionByName(open_rows.select(*told.columns))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'" for _, r, h, p in _sorted(RULES))
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES)
    levels = []
    for k in range(ORDER + 1):
        rest = (lambda c: f"b.p{c}") if k else (lambda c: "(SELECT 1.0::DOUBLE / COUNT(DISTINCT right(gram, 1)) FROM grams)")
        mixed = ", ".join(f"CASE WHEN all{c} > 0 THEN (n{c} + kinds{c} * {rest(c)}) / (all{c} + kinds{c}) ELSE {rest(c)} END AS p{c}" for c in (0, 1))
        sums = ", ".join(f"SUM(n{c}) OVER w AS all{c}, COUNT(*) FILTER (n{c} > 0) OVER w AS kinds{c}" for c in (0, 1))
        levels.append(f"""c{k} AS (SELECT right(gram, {k + 1}) AS gram, CAST(SUM(n0) AS DOUBLE) AS n0, CAST(SUM(n1) AS DOUBLE) AS n1 FROM grams GROUP BY 1),
p{k} AS (SELECT c.gram, {mixed} FROM (SELECT *, {sums} FROM c{k} WINDOW w AS (PARTITION BY substr(gram, 1, {k}))) c {f"JOIN p{k - 1} b ON b.gram = right(c.gram, {k})" if k else ""})""")
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(COALESCE(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(COALESCE(url, ''), '{PARTS}', 2) AS path FROM pages),
r AS (SELECT *, CASE {cases} END AS rule, translate(host || path, '{DIGITS}', '{DIGITS[0] * 10}') AS text FROM u),
v AS (SELECT *, CASE rule {verdicts} END AS told FROM r),
texts AS (SELECT text, COUNT(*) FILTER (told = 'allow') AS accepted, COUNT(*) FILTER (told = 'block') AS rejected, md5(text)[1] IN ({", ".join(f"'{x}'" for x in HELD)}) AS held FROM v GROUP BY text),
places AS (SELECT text, held, accepted, rejected, substr(repeat(chr(2), {ORDER}) || text || chr(3), i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(generate_series(1, length(text) + 1)) AS i FROM texts)),
grams AS (SELECT gram, SUM(CASE WHEN held THEN 0 ELSE accepted END) AS n0, SUM(CASE WHEN held THEN 0 ELSE rejected END) AS n1 FROM places GROUP BY gram),
{", ".join(levels)},
d AS (SELECT gram, CAST(round((ln(p0) - ln(p1)) * {SCALE}) AS BIGINT) AS delta FROM p{ORDER}),
s AS (SELECT text, held, accepted, rejected, CAST(floor(CAST(SUM(delta) AS DOUBLE) / COUNT(*)) AS BIGINT) AS score FROM places JOIN d USING (gram) GROUP BY ALL),
g AS (SELECT greatest(least(CAST(floor(score / {WIDTH}.0::DOUBLE) AS BIGINT), {CLASSES}), -{CLASSES}) AS class, CAST(SUM(accepted) AS DOUBLE) AS n0, CAST(SUM(rejected) AS DOUBLE) AS n1 FROM s WHERE held AND accepted + rejected > 0 GROUP BY 1),
h AS (SELECT CAST(floor((class * {WIDTH} + (COALESCE(LEAD(class) OVER w, class - 1) + 1) * {WIDTH}) / 2.0::DOUBLE) AS BIGINT) AS cut, SUM(n0) OVER w / SUM(n0) OVER () - SUM(n1) OVER w / SUM(n1) OVER () AS gain FROM g WINDOW w AS (ORDER BY class DESC)),
t AS (SELECT COALESCE((SELECT cut FROM h WHERE gain IS NOT NULL AND NOT isnan(gain) ORDER BY gain DESC, abs(cut), cut LIMIT 1), 0) AS cut, (SELECT SUM(accepted) > 0 AND SUM(rejected) > 0 FROM texts WHERE NOT held) AS both_kinds)
SELECT page_id, host, path, rule, COALESCE(told, CASE WHEN NOT COALESCE(both_kinds, false) OR score >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM v JOIN s USING (text), t
"""


SQL = _sql()
