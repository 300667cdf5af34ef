"""Operator 12, URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides. DataFrame functions and Spark's own trees only."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scale import written

#: Labelled URLs that the trees are fitted on, about; drawn by hash. Statistics of suffixes count all rows.
TRAIN_ROWS = 10_000
#: Suffixes are counted by hash in this many buckets a kind, so the table of counts has a fixed size and may be broadcast.
BUCKETS = 4096
FOLDS = 5
KINDS = ("top", "site", "ending")
#: Rules up to this many are one expression; more are joined.
IN_LINE = 100
PLAIN = ("length", "host_length", "path_length", "labels", "depth", "digits", "hyphens", "entropy", "parameters")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``. Both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    pattern = r"^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, pattern, 1), ascii_uppercase, ascii_lowercase), F.regexp_extract(rest, pattern, 2)


def with_rule(df: DataFrame, rules: list[Rule], in_line: int = IN_LINE) -> DataFrame:
    """``df`` (with host and path) and the longest rule that fits: its name as ``rule``, its verdict as ``ruled``; null where none does.

    A few rules are one expression. Many are joined: each different (host,
    path) gives its host suffixes with each length that rule paths have, which
    meet the rules by equality; only different pairs are shuffled.
    """
    rules = sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.verdict))
    if len(rules) <= in_line:
        name = verdict = F.lit(None).cast("string")
        for r in reversed(rules):
            fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
            name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
        return df.withColumns({"rule": name, "ruled": verdict})
    table = df.sparkSession.createDataFrame([(r.host, r.path, -k, r.name, r.verdict) for k, r in enumerate(rules)], "h string, p string, rank long, rule string, ruled string")
    lengths = F.array(*map(F.lit, sorted({len(r.path) for r in rules})))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pairs = df.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("h")).select("host", "path", "h", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
    hits = pairs.withColumn("p", F.substring("path", F.lit(1), F.col("n"))).join(table, ["h", "p"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "ruled")).alias("b")).select("host", "path", "b.rule", "b.ruled")
    return df.join(best, ["host", "path"], "left")


def entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution, all characters beyond ASCII taken as one; 0 for an empty text."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "¿")
    n = F.length(plain)
    seen = F.array_distinct(F.filter(F.split(plain, ""), lambda c: c != ""))

    def more(total: Column, c: Column) -> Column:
        k = n - F.length(F.replace(plain, c, F.lit("")))
        return total + k * F.log2(k)

    return F.when(n > 0, F.log2(n) - F.aggregate(seen, F.lit(0.0), more) / n).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with _url, host and path) and the lexical features, the keys of its suffixes and the fold of its host."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    end = F.regexp_extract(F.substring_index("path", "/", -1), r"\.([A-Za-z0-9]+)$", 1)
    bucket = lambda kind, c: F.pmod(F.xxhash64(F.lit(kind), c), F.lit(BUCKETS)).cast("int")
    return urls.withColumns({
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "labels": F.size(F.split("host", r"\.")), "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "hyphens": count(url, "[^A-Za-z0-9./:?#&=%]"), "entropy": entropy(url), "parameters": F.size(F.filter(F.split(asked, "&"), lambda s: s != "")),
        "top": bucket("top", F.substring_index("host", ".", -1)), "site": bucket("site", F.substring_index("host", ".", -2)), "ending": bucket("ending", F.lower(end)), "fold": F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(FOLDS)).cast("int"),
    })


@dataclass(frozen=True)
class UrlModel:
    """Trees, or a constant where the labels know one verdict only; the counts of suffixes, and the share of label 1."""

    trees: GBTClassificationModel | None
    counts: DataFrame
    share: float


def suffix_counts(rows: DataFrame) -> DataFrame:
    """(kind, bucket, rows, n, ones): a suffix bucket's rows, and its labelled rows and those of label 1 by fold. At most 3 x 4,096 rows."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("bucket")) for k in KINDS]))
    each = rows.select(keys.alias("s"), "fold", "_y").groupBy("s.kind", "s.bucket", "fold").agg(F.count(F.lit(1)).alias("rows"), F.count("_y").alias("n"), F.sum("_y").alias("y"))
    fold = lambda c, f: F.sum(F.when(F.col("fold") == f, F.coalesce(F.col(c), F.lit(0))).otherwise(0))
    return each.groupBy("kind", "bucket").agg(F.sum("rows").alias("rows"), F.array(*[fold("n", f) for f in range(FOLDS)]).alias("n"), F.array(*[fold("y", f) for f in range(FOLDS)]).alias("ones"))


def featured(rows: DataFrame, counts: DataFrame, share: float, smooth: float = 20.0) -> tuple[DataFrame, list[str]]:
    """Rows with a vector ``features``, and the features' names.

    A suffix gives its count and its share of label 1 in the other folds of
    hosts, drawn to the general share by ``smooth`` rows: a host's own labels
    never speak for it.
    """
    names = list(PLAIN)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    for kind in KINDS:
        some = counts.where(F.col("kind") == kind).select(F.col("bucket").alias(kind), F.col("rows").alias(f"_r_{kind}"), F.col("n").alias(f"_n_{kind}"), F.col("ones").alias(f"_o_{kind}"))
        rows = rows.join(F.broadcast(some), kind, "left")  # 4,096 rows at most
        others = lambda c: F.coalesce(total(F.col(c)) - F.get(F.col(c), F.col("fold")), F.lit(0))  # noqa: B023, E731
        rows = rows.withColumns({f"{kind}_count": F.log1p(F.coalesce(F.col(f"_r_{kind}"), F.lit(0))), f"{kind}_share": (others(f"_o_{kind}") + smooth * share) / (others(f"_n_{kind}") + smooth)}).drop(f"_r_{kind}", f"_n_{kind}", f"_o_{kind}")
        names += [f"{kind}_count", f"{kind}_share"]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows), names


def fit_urls(urls: DataFrame, label: Column, url_col: str = "url", train_rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit on ``label`` (1 block, 0 allow, null unlabelled), a column over ``urls`` with ``host``, ``path``, ``rule`` and ``ruled`` if those are there.

    Suffix counts take all rows; the trees about ``train_rows`` different
    labelled URLs, drawn by hash, so copies of a URL neither fill the sample
    nor outvote others; of several labels of one URL the largest counts.
    """
    rows = lexical(_urls(urls.withColumn("_y", label.cast("int")), url_col, "_y"))
    counts = written(suffix_counts(rows), "suffixes")
    seen = rows.where("_y is not null").agg(F.approx_count_distinct("_url").alias("urls"), F.avg("_y").alias("share")).first()
    share = float(seen.share or 0.0)
    if share in (0.0, 1.0):
        return UrlModel(None, counts, share)
    drawn = rows.where(F.col("_y").isNotNull() & F.col("_url").isNotNull() & (F.pmod(F.xxhash64(F.lit("draw"), "_url"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, train_rows / seen.urls))))
    some = drawn.groupBy("_url", "host", "path").agg(F.max("_y").alias("_y"))
    vectors, _ = featured(lexical(some), counts, share)
    vectors = written(vectors.select("_url", "features", F.col("_y").cast("double").alias("label")).orderBy("_url"), "labelled")
    if vectors.select(F.min("label") == F.max("label")).first()[0] is not False:
        return UrlModel(None, counts, share)
    return UrlModel(GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, maxBins=64, seed=1).fit(vectors), counts, share)


def _urls(df: DataFrame, url_col: str, *keep: str) -> DataFrame:
    url = F.col(url_col).cast("string")
    host, path = parts(url)
    return df.select(*keep, url.alias("_url"), host.alias("host"), path.alias("path"))


def ruled_urls(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """(url, ruled): the URLs with the verdict of the longest rule that fits, or null."""
    return with_rule(_urls(urls, url_col), rules).select(F.col("_url").alias(url_col), "ruled")


def judge_urls(urls: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (id, host, path, rule, verdict, score) for each row: the longest rule's verdict, else the trees'.

    ``score`` is the trees' likelihood of block, for ruled rows too; a rule
    always wins. A null URL or one without ``://`` has an empty host and path,
    which no rule fits, and is judged by its features. Repeated rows are judged
    each; other columns are ignored whatever their names; an empty table gives
    an empty result. Rows are never shuffled but by more than 100 rules.
    """
    rows = lexical(with_rule(_urls(urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_raw")), "_raw", "_id"), rules))
    if model.trees is None:
        out = rows.withColumn("score", F.lit(float(round(model.share))))
    else:
        vectors, _ = featured(rows, model.counts, model.share)
        out = model.trees.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    judged = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
