"""URL filter: rules by host and path, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import fresh
from cellweave.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule): a rule is a host, and after its first slash the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(_after(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, and the path starts with the rule's path."""
    fits = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = rule.partition("/")
        under = (host == domain) | host.endswith(f".{domain}")
        fits = F.when(under & path.startswith(f"/{start}"), F.lit(rule)).otherwise(fits)
    return fits


def _entropy(text: Column) -> Column:
    """Bits per character. Each place adds log2 of the share of its character."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    total = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - F.when(c != "", F.log2(share(c)) / n).otherwise(0.0))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign)))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the url's letters alone. The host's name is not among them, only its shape."""
    whole = F.coalesce(url, F.lit(""))
    digits = F.length(F.regexp_replace(whole, r"[^0-9]", ""))
    part = lambda text, sign: F.greatest(F.size(F.split(text, sign)) - 1, F.lit(0))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    return {
        "f_length": F.length(whole),
        "f_host_length": F.length(host),
        "f_path_length": F.length(path),
        "f_depth": _count(path, "/"),
        "f_labels": part(host, r"\."),
        "f_digits": digits,
        "f_digit_ratio": digits / F.greatest(F.length(whole), F.lit(1)),
        "f_dashes": _count(host, "-"),
        "f_entropy": _entropy(host),
        "f_path_entropy": _entropy(path),
        "f_parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0),
        "f_fragment": F.contains(whole, F.lit("#")).cast("int"),
        "f_secure": whole.startswith("https").cast("int"),
    }


#: What suffix statistics are kept for: the host's last label, its last two, the path's first part, the file ending.
def suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {
        "s_top": F.substring_index(host, ".", -1),
        "s_site": F.substring_index(host, ".", -2),
        "s_first": F.regexp_extract(path, r"\A/([^/]*)", 1),
        "s_ending": F.regexp_extract(path, r"\.([^./]*)\z", 1),
    }


class UrlFilter:
    """Trees learned from urls labelled 1 (block) or 0 (allow), and block rates per suffix."""

    def __init__(self, prior: float, rates: dict[str, tuple[DataFrame, DataFrame | None]], model: PipelineModel | None):
        self.prior, self.rates, self.model = prior, rates, model

    def score(self, urls: DataFrame) -> DataFrame:
        """Add `score`, the chance of a block, from `url`, `host` and `path`. Without labelled urls, or with one label only, it is their rate."""
        if self.model is None:
            return urls.withColumn("score", F.lit(self.prior))
        [whole] = fresh(urls, "url_row")
        found = self.model.transform(_featured(urls.select("url", "host", "path", F.struct("*").alias(whole)), self.rates, self.prior))
        return found.select(f"{whole}.*", F.element_at(vector_to_array("probability"), 2).alias("score"))


#: Copies of the rates that are joined by a shuffle.
SALTS = 8


def _featured(urls: DataFrame, rates: dict[str, tuple[DataFrame, DataFrame | None]], prior: float) -> DataFrame:
    parts = {**lexical(F.col("url"), F.col("host"), F.col("path")), **suffixes(F.col("host"), F.col("path"))}
    out = urls.withColumns(parts)
    for name, (common, others) in rates.items():
        values = [f"{name}_rate", f"{name}_seen"]
        out = out.join(F.broadcast(common), name, "left")
        if others is not None:
            # Rows that have their rate are spread and meet nothing; the others meet one of the copies of theirs.
            salt, any_ = fresh(out, "salt", "any_row")
            out = out.withColumn(any_, F.xxhash64("url")).withColumn(
                salt, F.when(F.col(values[0]).isNotNull(), F.col(any_)).otherwise(F.pmod(any_, F.lit(SALTS)))
            )
            more = others.select(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias(salt), *[F.col(v).alias(f"{v}_more") for v in values])
            out = out.join(more, [name, salt], "left").withColumns({v: F.coalesce(v, f"{v}_more") for v in values})
            out = out.drop(salt, any_, *[f"{v}_more" for v in values])
        out = out.withColumns({values[0]: F.coalesce(values[0], F.lit(prior)), values[1]: F.coalesce(values[1], F.lit(0.0))})
    return out.withColumns({n: F.col(n).cast("double") for n in parts if n.startswith("f_")})


def learn(labelled: DataFrame, max_rows: int = 20_000, max_suffixes: int = 2_000, trees: int = 20, depth: int = 4) -> UrlFilter:
    """Learn from `(url, host, path, label)`; null urls are left out.

    The trees are fitted on at most `max_rows` distinct urls, those with the
    smallest hashes, each weighted by its rows. Rates are counted over all labelled rows, smoothed
    towards the overall rate by ten rows' weight, and kept for every suffix: the
    `max_suffixes` most frequent ones of each kind are sent to tasks, the others are joined.
    """
    labelled = labelled.filter(F.col("url").isNotNull())
    whole = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    prior = float(whole["rate"] or 0.0)
    if not whole["n"] or prior in (0.0, 1.0):
        return UrlFilter(prior, {}, None)
    rates = {}
    for name, suffix in suffixes(F.col("host"), F.col("path")).items():
        counted = cut_lineage(labelled.groupBy(suffix.alias(name)).agg(F.count("*").alias("n"), F.sum("label").alias("ones")))
        common = counted.orderBy(F.desc("n"), name).limit(max_suffixes)
        others = None
        if counted.count() > max_suffixes:
            others = counted.join(F.broadcast(common.select(name)), name, "left_anti")
        made = [
            name,
            ((F.col("ones") + 10 * prior) / (F.col("n") + 10)).alias(f"{name}_rate"),
            F.log1p("n").alias(f"{name}_seen"),
        ]
        rates[name] = (common.select(made), None if others is None else others.select(made))
    names = [*lexical(F.lit(""), F.lit(""), F.lit("")), *[f"{n}_rate" for n in rates], *[f"{n}_seen" for n in rates]]
    urls = labelled.groupBy("url", "host", "path", "label").agg(F.count("*").cast("double").alias("weight"))
    sample = urls.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(_featured(sample, rates, prior))
    trees_model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1, weightCol="weight").fit(rows.select("features", "label", "weight"))
    return UrlFilter(prior, rates, PipelineModel([VectorAssembler(inputCols=names, outputCol="features"), trees_model]))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Add `host`, `path`, `rule`, `verdict` and `score` to each row of `(url, ...)`.

    Urls that a rule fits are the labelled ones: they get its verdict, and the
    trees learn from them. The others are blocked where the trees give a block
    0.5 or more. A null url, or one without `://`, has an empty host and path and
    so no rule. Columns of the new names are replaced; an empty table gives an
    empty one; without labelled urls everything else is allowed.
    """
    names = ("host", "path", "rule", "verdict", "score")
    base = pages.drop(*[c for c in pages.columns if c.lower() in names])
    placed = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn(
        "rule", rule_of(F.col("host"), F.col("path"), rules)
    )
    blocks = [rule for verdict, rule in rules if verdict == "block"]
    is_block = F.col("rule").isin(blocks)
    known = placed.filter(F.col("rule").isNotNull()).select("url", "host", "path", is_block.cast("double").alias("label"))
    by_rule = F.when(F.col("rule").isNotNull(), F.when(is_block, "block").otherwise("allow"))
    by_score = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return learn(known).score(placed).withColumn("verdict", F.coalesce(by_rule, by_score))
