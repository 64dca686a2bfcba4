"""Secret scan: format rules, and a randomness test battery for tokens that no rule knows.

Rules give the base spans (assign, access, hex). Beside them, every token of 20 or more characters
of an encoding's alphabet, outside base spans, is tested for being random text of that encoding:

* chi-squared test that the alphabet's symbols are equally frequent,
* runs test on symbols in the upper and the lower half of the alphabet,
* serial correlation of neighbouring symbols.

The smallest of the three p-values times three is the token's. Tokens are then dismissed as *not*
random by Benjamini and Hochberg's procedure at level ``q``, in each band of length by itself: long
tokens have power to be dismissed at tiny p-values and would otherwise set the bar for short ones.
So of the dismissed tokens of any length no more than about q were random. What is left is a span of
kind random. The procedure's ranks come from a histogram of p-values per band (a fixed number of
bins, p rounded up to its bin's edge), so that no task sorts all tokens.

Everything is DataFrame operations. Positions come from marking matches in the text with a
character that the text no longer holds, and adding up the lengths of the parts between marks: in
groups of GROUP parts, so that the work grows with the number of matches and hardly with its square.
Which tokens lie outside base spans comes from running greatest and least bounds over a text's spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, needed, text_or_empty
from ledgerlens.sources.tables import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
TOKEN = r"((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2})"
KINDS = ("assign", "access", "hex", "random")

# The alphabets of encodings, by the order in which they are inferred.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
Q = 0.05
BANDS = (20, 24, 32, 40, 64, 128, 512)
BINS_PER_E, BINS = 32, 2048
GROUP = 128
MARK, CUT, NEITHER = "\u0001", "\u0002", "\u0003"


def _with_spans(df: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """df (with a column text) and for each (name, pattern, replacement) a column of that name: the
    leftmost matches that don't overlap, as array<struct<start,end,value>>. What stands after a CUT in
    the replacement is the value. The steps are columns of their own, so that each is computed once."""
    names = [n for n, _, _ in patterns]
    kept = [c for c in df.columns if c != "text"]
    df = df.select(*kept, *[F.split(F.regexp_replace("text", F.lit(p), F.lit(r)), MARK).alias(f"{n}_parts") for n, p, r in patterns])
    parts = [f"{n}_parts" for n in names]
    df = df.select(*kept, *parts, *[F.transform(f"{n}_parts", lambda p: F.length(F.replace(p, F.lit(CUT), F.lit("")))).alias(f"{n}_lens") for n in names])
    df = df.select(*kept, *parts, *[f"{n}_lens" for n in names], *[_group_starts(f"{n}_lens").alias(f"{n}_from") for n in names])
    return df.select(*kept, *[_placed(n).alias(n) for n in names])


def _group_starts(lens: str) -> Column:
    """Where each group of GROUP parts starts in the text, and where the last ends."""
    groups = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / GROUP).cast("int"))
    sums = F.transform(groups, lambda g: F.aggregate(F.slice(lens, g * GROUP + 1, GROUP), F.lit(0), lambda t, x: t + x))
    return F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _placed(name: str) -> Column:
    """Every second part is a match."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    parts, lens, starts = F.col(f"{name}_parts"), F.col(f"{name}_lens"), F.col(f"{name}_from")

    def group(g: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            end = acc["at"] + F.get(lens, i)
            found = F.struct(acc["at"].alias("start"), end.alias("end"), F.substring_index(F.get(parts, i), CUT, -1).alias("value"))
            return F.struct(end.alias("at"), F.when(i % 2 == 1, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

        last = F.least(F.size(parts), (g + 1) * GROUP) - 1
        return F.aggregate(F.sequence(g * GROUP, last), F.struct(F.get(starts, g).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    return F.when(F.size(parts) > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts) - 2), group))).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by a rational approximation of erfc (relative error under 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    # Coefficients of the Chebyshev fit, highest power first.
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        fit = fit * t + F.lit(c)
    tail = t * F.exp(-x * x - 1.26551223 + t * fit) / 2
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def encoding(token: Column) -> Column:
    """The first encoding whose alphabet holds the token, null for text of digits only or of no
    encoding. Hexadecimal and base32 need both a digit and a letter."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return (
        F.when(~token.rlike("[^0-9]"), F.lit(None).cast("string"))
        .when(mixed & ~token.rlike("[^0-9a-f]"), F.lit("hex"))
        .when(mixed & ~token.rlike("[^0-9A-F]"), F.lit("hex_upper"))
        .when(mixed & ~token.rlike("[^A-Z2-7]"), F.lit("base32"))
        .when(~token.rlike("[^A-Za-z0-9]"), F.lit("base62"))
        .when(~token.rlike("[^A-Za-z0-9+/]"), F.lit("base64"))
        .when(~token.rlike("[^A-Za-z0-9_-]"), F.lit("base64url"))
    )


def battery(tokens: DataFrame) -> DataFrame:
    """tokens with a column token, one encoding's text without padding: adds encoding, n and p."""
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    t = tokens.withColumn("encoding", encoding(F.col("token"))).where("encoding is not null")
    t = t.withColumn("alphabet", F.element_at(alphabets, F.col("encoding")))
    t = t.withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("token").cast("double"))
    t = t.withColumn("codes", F.transform(F.split("token", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")))
    t = t.withColumn("codes", F.filter("codes", lambda c: c >= 0))
    squares = F.aggregate(
        F.split("alphabet", ""), F.lit(0.0), lambda acc, c: acc + F.pow((F.col("n") - F.length(F.replace(F.col("token"), c, F.lit("")))).cast("double"), F.lit(2.0))
    )
    t = t.withColumn("chi2", squares * F.col("k") / F.col("n") - F.col("n"))
    df = F.col("k") - 1
    spread = F.lit(2.0) / (df * 9)
    t = t.withColumn("p_chi", _upper_tail((F.pow(F.col("chi2") / df, F.lit(1.0 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread)))

    pairs = F.zip_with(F.slice("codes", 1, F.size("codes") - 1), F.slice("codes", 2, F.size("codes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    t = t.withColumn("pairs", pairs)
    high = F.aggregate("codes", F.lit(0.0), lambda acc, c: acc + F.when(c * 2 >= F.col("k"), 1.0).otherwise(0.0))
    t = t.withColumn("n1", high).withColumn("n0", F.col("n") - F.col("n1"))
    runs = F.aggregate("pairs", F.lit(1.0), lambda acc, p: acc + F.when((p["a"] * 2 >= F.col("k")) != (p["b"] * 2 >= F.col("k")), 1.0).otherwise(0.0))
    both = F.col("n1") * F.col("n0") * 2
    t = t.withColumn("runs", runs).withColumn("mean_runs", both / F.col("n") + 1)
    variance = (F.col("mean_runs") - 1) * (F.col("mean_runs") - 2) / (F.col("n") - 1)
    z_runs = F.when((F.col("n1") > 0) & (F.col("n0") > 0) & (variance > 0), (F.col("runs") - F.col("mean_runs")) / F.sqrt(variance)).otherwise(F.lit(40.0))
    t = t.withColumn("p_runs", _upper_tail(F.abs(z_runs)) * 2)

    t = t.withColumn("mean", F.aggregate("codes", F.lit(0.0), lambda acc, c: acc + c) / F.col("n"))
    t = t.withColumn("dev2", F.aggregate("codes", F.lit(0.0), lambda acc, c: acc + (c - F.col("mean")) * (c - F.col("mean"))))
    cov = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    z_serial = F.when(F.col("dev2") > 0, (cov / F.col("dev2") + F.lit(1.0) / F.col("n")) * F.sqrt("n")).otherwise(F.lit(40.0))
    t = t.withColumn("p_serial", _upper_tail(F.abs(z_serial)) * 2)
    return t.withColumn("p", F.least(F.lit(1.0), F.least("p_chi", "p_runs", "p_serial") * 3)).drop("alphabet", "codes", "pairs", "k", "chi2", "n1", "n0", "runs", "mean_runs", "mean", "dev2")


def false_discovery_bins(tested: DataFrame, q: float = Q) -> DataFrame:
    """tested: band, bin. The lowest bin of each band that Benjamini and Hochberg dismiss; bands
    without one are absent. Holds at most BINS rows a band."""
    counts = tested.groupBy("band", "bin").agg(F.count("*").alias("c"))
    down = Window.partitionBy("band").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("band")
    ranked = counts.withColumn("rank", F.sum("c").over(down)).withColumn("m", F.sum("c").over(every))
    return ranked.where(F.exp(-F.col("bin") / F.lit(float(BINS_PER_E))) <= F.lit(q) * F.col("rank") / F.col("m")).groupBy("band").agg(F.min("bin").alias("dismissed_from"))


def _band(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * BINS_PER_E)).cast("int")


def secret_spans(docs: DataFrame, q: float = Q) -> DataFrame:
    """One row per document: rid, doc_id and spans, array<struct<start, kind_no, end>> in order of
    start, then kind. Texts are whole; null counts as empty."""
    texts = needed(docs, "doc_id", "text").select("doc_id", F.replace(F.replace(text_or_empty(F.col("text")), F.lit(MARK), F.lit(NEITHER)), F.lit(CUT), F.lit(NEITHER)).alias("text"))
    found = _with_spans(texts, [("assign", ASSIGN, f"{MARK}$1{CUT}$2{MARK}"), ("access", ACCESS, f"{MARK}$1{MARK}"), ("hex", HEX, f"{MARK}$1{MARK}"), ("tokens", TOKEN, f"{MARK}$1{MARK}")])
    found = found.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= 6)).withColumn("rid", F.monotonically_increasing_id())
    found = materialize(found, "secret-found")

    def numbered(kind_no: int) -> Column:
        return F.transform(KINDS[kind_no], lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end")))

    base = F.concat(*[numbered(i) for i in range(3)])
    rows = found.select("rid", "doc_id", "tokens", F.array_sort(base).alias("base"))

    some = rows.where(F.size("tokens") > 0)
    spans = some.select("rid", F.explode("tokens").alias("t")).select("rid", "t.start", "t.end", "t.value", F.lit(1).alias("is_token"))
    spans = spans.unionByName(some.select("rid", F.explode("base").alias("b")).select("rid", "b.start", "b.end", F.lit(None).cast("string").alias("value"), F.lit(0).alias("is_token")))
    down = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("is_token").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("rid").orderBy("start", "is_token").rowsBetween(Window.unboundedPreceding, 0)
    of_base = lambda c: F.when(F.col("is_token") == 0, F.col(c))
    placed = spans.withColumn("next", F.min(of_base("start")).over(down)).withColumn("reach", F.max(of_base("end")).over(up))
    free = placed.where("is_token = 1 and coalesce(reach, 0) <= start and coalesce(next, end) >= end")
    tokens = free.select("rid", "start", "end", F.rtrim("value", F.lit("=")).alias("token"))
    tested = materialize(battery(tokens).select("rid", "start", "end", _band(F.col("n")).alias("band"), _bin(F.col("p")).alias("bin")), "secret-tested")
    bars = false_discovery_bins(tested, q)  # at most one row per band
    random = (
        tested.join(F.broadcast(bars), "band", "left")
        .where("dismissed_from is null or bin < dismissed_from")
        .groupBy("rid")
        .agg(F.collect_list(F.struct("start", F.lit(3).alias("kind_no"), "end")).alias("random"))
    )
    spans = F.array_sort(F.concat("base", F.coalesce("random", F.array().cast("array<struct<start:int,kind_no:int,end:int>>"))))
    return rows.join(random, "rid", "left").select("rid", "doc_id", spans.alias("spans"))


def secret_scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans. Null and repeated ids come back as they are, a row for each
    input row; an empty table gives no rows; further columns are ignored. Which random spans stay
    depends on all tokens of the table, as false-discovery control does; base spans don't."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def digest(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")

    return secret_spans(docs, q).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(digest(F.filter("spans", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    anyhow = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(anyhow(w) for w in ("password", "passwd", "secret", "token")) + "|" + anyhow("api") + "_?" + anyhow("key")
    patterns = [
        ("assign", rf"""((?:{words})["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)""", r"\1' || chr(2) || '\2"),
        ("access", ACCESS, r"\1"),
        ("hex", HEX, r"\1"),
        ("tokens", r"([A-Za-z0-9+/_-]{20,}={0,2})", r"\1"),
    ]
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {i} AS kind_no, string_split(regexp_replace(t, '{pattern}', chr(1) || '{to}' || chr(1), 'g'), chr(1)) AS parts FROM texts" for i, (kind, pattern, to) in enumerate(patterns)
    )
    alphabet = "CASE encoding " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALPHABETS.items()) + " END"
    band = "CASE " + " ".join(f"WHEN n >= {least} THEN {i}" for i, least in reversed(list(enumerate(BANDS)))) + " ELSE 0 END"
    fit = "0.17087277::DOUBLE"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        fit = f"({fit} * q + ({c}))"
    return rf"""
WITH texts AS (
  SELECT doc_id, replace(replace(coalesce(text, ''), chr(1), chr(3)), chr(2), chr(3)) AS t FROM documents
), parts AS ({parts}), lens AS (
  SELECT *, list_transform(parts, lambda p: length(replace(p, chr(2), ''))) AS lens FROM parts WHERE len(parts) > 1
), found AS (
  SELECT doc_id, kind, kind_no, coalesce(list_sum(lens[1:i - 1]), 0)::BIGINT AS s, coalesce(list_sum(lens[1:i]), 0)::BIGINT AS e, string_split(parts[i], chr(2))[-1] AS v
  FROM (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM lens)
), base AS (
  SELECT * FROM found WHERE kind <> 'tokens' AND (kind <> 'assign' OR length(v) >= 6)
), token0 AS (
  SELECT doc_id, s, e, rtrim(v, '=') AS tok FROM found f WHERE kind = 'tokens' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)
), token1 AS (
  SELECT *, regexp_matches(tok, '[0-9]') AND regexp_matches(tok, '[A-Za-z]') AS mixed FROM token0
), token2 AS (
  SELECT doc_id, s, e, tok, length(tok)::DOUBLE AS n,
    CASE WHEN NOT regexp_matches(tok, '[^0-9]') THEN NULL WHEN mixed AND NOT regexp_matches(tok, '[^0-9a-f]') THEN 'hex' WHEN mixed AND NOT regexp_matches(tok, '[^0-9A-F]') THEN 'hex_upper'
         WHEN mixed AND NOT regexp_matches(tok, '[^A-Z2-7]') THEN 'base32' WHEN NOT regexp_matches(tok, '[^A-Za-z0-9]') THEN 'base62' WHEN NOT regexp_matches(tok, '[^A-Za-z0-9+/]') THEN 'base64'
         WHEN NOT regexp_matches(tok, '[^A-Za-z0-9_-]') THEN 'base64url' END AS encoding FROM token1
), token3 AS (
  SELECT *, {alphabet} AS alphabet FROM token2 WHERE encoding IS NOT NULL
), token4 AS (
  SELECT *, length(alphabet)::DOUBLE AS k, list_transform(string_split(tok, ''), lambda c: (instr(alphabet, c) - 1)::DOUBLE) AS codes,
    list_sum(list_transform(string_split(alphabet, ''), lambda c: pow(n - length(replace(tok, c, '')), 2))) * length(alphabet) / n - n AS chi2 FROM token3
), token5 AS (
  SELECT *, list_sum(list_transform(codes, lambda c: CASE WHEN c * 2 >= k THEN 1.0::DOUBLE ELSE 0 END)) AS n1, list_sum(codes) / n AS mean,
    1 + list_sum(list_transform(range(2, len(codes) + 1), lambda i: CASE WHEN (codes[i] * 2 >= k) <> (codes[i - 1] * 2 >= k) THEN 1.0::DOUBLE ELSE 0 END)) AS runs FROM token4
), token6 AS (
  SELECT *, 2 * n1 * (n - n1) / n + 1 AS mean_runs, list_sum(list_transform(codes, lambda c: (c - mean) * (c - mean))) AS dev2,
    list_sum(list_transform(range(2, len(codes) + 1), lambda i: (codes[i - 1] - mean) * (codes[i] - mean))) AS cov, 2.0::DOUBLE / ((k - 1) * 9) AS spread FROM token5
), zs AS (
  SELECT doc_id, s, e, n, [(pow(chi2 / (k - 1), 1.0::DOUBLE / 3) - (1 - spread)) / sqrt(spread),
    abs(CASE WHEN n1 > 0 AND n1 < n AND (mean_runs - 1) * (mean_runs - 2) / (n - 1) > 0 THEN (runs - mean_runs) / sqrt((mean_runs - 1) * (mean_runs - 2) / (n - 1)) ELSE 40 END),
    abs(CASE WHEN dev2 > 0 THEN (cov / dev2 + 1 / n) * sqrt(n) ELSE 40 END)] AS z FROM token6
), qs AS (
  SELECT doc_id, s, e, n, i, z[i] AS z, abs(z[i]) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + abs(z[i]) / sqrt(2.0::DOUBLE) * 0.5) AS q FROM zs, (VALUES (1), (2), (3)) AS w(i)
), ps AS (
  SELECT doc_id, s, e, n, least(1, min((CASE WHEN i = 1 THEN 1 ELSE 2 END) * CASE WHEN z >= 0 THEN h ELSE 1 - h END) * 3) AS p FROM (SELECT *, q * exp(-x * x - 1.26551223 + q * {fit}) / 2 AS h FROM qs) GROUP BY 1, 2, 3, 4
), tested AS (
  SELECT doc_id, s, e, {band} AS band, least({BINS - 1}, floor(-ln(greatest(p, 1e-300)) * {BINS_PER_E}))::INTEGER AS bin FROM ps
), counts AS (
  SELECT band, bin, count(*) AS c FROM tested GROUP BY 1, 2
), ranked AS (
  SELECT band, bin, sum(c) OVER (PARTITION BY band ORDER BY bin DESC) AS r, sum(c) OVER (PARTITION BY band) AS m FROM counts
), bars AS (
  SELECT band, min(bin) AS bar FROM ranked WHERE exp(-bin / {float(BINS_PER_E)}::DOUBLE) <= {Q} * r / m GROUP BY 1
), spans AS (
  SELECT doc_id, kind, kind_no, s, e FROM base UNION ALL SELECT doc_id, 'random', 3, s, e FROM tested LEFT JOIN bars USING (band) WHERE bar IS NULL OR bin < bar
), listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind <> 'random') AS base_list, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS all_list FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base_list, '')) AS base_sha256, coalesce(all_list, '') AS spans FROM documents d LEFT JOIN listed USING (doc_id)
"""


ORACLE_SQL = _oracle()
