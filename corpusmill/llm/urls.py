"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs only; in op2_urls those are the URLs that a rule decides. Both labels weigh the same in
total, as rules say nothing about how often the URLs without a rule are bad. A fifth of the sample, chosen by hash, is
kept from the trees: on it the score is shifted so that 0.5 tells the labels apart best, and precision and recall are
measured. Suffix statistics (how often a host's last label occurs, and which share of its labelled URLs is blocked) are counted over all
rows in SUFFIX_BUCKETS hash buckets, so that they fit a broadcast whatever hosts there are; a labelled URL never counts its own label.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick, table

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Bound of the labelled URLs that the trees are grown and calibrated on.
SAMPLE = 20_000
#: Score from which an URL without a rule is blocked; scores are calibrated for it.
THRESHOLD = 0.5
SUFFIX_BUCKETS = 1 << 16
FEATURES = ("length", "host_length", "path_length", "depth", "parameters", "digit_ratio", "letter_ratio", "entropy", "hyphens", "host_labels", "longest_token", "https", "fragment", "suffix_count", "suffix_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to /, ? or #, A-Z lower-cased; path from there up to ? or #. Both are empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lexical(url: str | None, host: str, path: str, count: float, share: float) -> list[float]:
    url = url or ""
    n = max(1, len(url))
    freq = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in freq.values())
    body, _, fragment = url.partition("#")
    query = body.partition("?")[2]
    tokens = "".join(c if c.isalnum() else " " for c in host + path).split()
    return [
        len(url), len(host), len(path), sum(map(bool, path.split("/"))), sum(map(bool, query.split("&"))), sum(c.isdigit() for c in url) / n, sum(c.isalpha() for c in url) / n, entropy,
        url.count("-"), host.count(".") + bool(host), max(map(len, tokens), default=0), url[:6].lower() == "https:", bool(fragment), math.log1p(count), share,
    ]


@dataclass
class Trees:
    """Boosted regression trees for the log-odds of a binary label."""

    bias: float = 0.0
    rate: float = 0.2
    nodes: list[list[tuple]] = field(default_factory=list)  # per tree: (feature, threshold, left, right) or (value,)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.nodes:
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                node = tree[at]
                if len(node) == 1:
                    out[rows] += self.rate * node[0]
                else:
                    left = x[rows, node[0]] <= node[1]
                    stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 40, depth: int = 4, bins: int = 32, least: int = 20, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on binned features; equal weights by default."""
    weight = np.ones(len(y)) if weight is None else weight
    share = float(np.clip((weight * y).sum() / weight.sum() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    model = Trees(bias=math.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    margin = np.full(len(y), model.bias)
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        tree: list[tuple] = []

        def build(rows: np.ndarray, left: int) -> int:
            at = len(tree)
            tree.append(())
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, -1)
            if left and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), j, k))
            if best[1] < 0:
                tree[at] = (gs / (hs + l2),)
                margin[rows] += model.rate * tree[at][0]
            else:
                _, j, k = best
                side = binned[rows, j] <= k
                a = build(rows[side], left - 1)
                tree[at] = (j, float(cuts[j][k]), a, build(rows[~side], left - 1))
            return at

        build(np.arange(len(y)), depth)
        model.nodes.append(tree)
    return model


@dataclass
class Filter:
    """Trees, the suffix statistics they need, and how well they did on labelled URLs that they had not seen (nan where there were none)."""

    trees: Trees | None
    count: np.ndarray  # by suffix bucket: URLs
    labelled: np.ndarray
    blocked: np.ndarray
    cut: float = 0.0  # the margin that a score of 0.5 stands for
    precision: float = math.nan
    recall: float = math.nan

    def features(self, rows: pa.RecordBatch) -> np.ndarray:
        """label is null, allow or block; a labelled URL is left out of its suffix's share."""
        get = {n: rows.column(rows.schema.get_field_index(n)) for n in ("url", "host", "path", "bucket", "label")}
        at = np.array(get["bucket"])
        own = np.array([v is not None for v in get["label"].to_pylist()], float)
        block = np.array([v == "block" for v in get["label"].to_pylist()], float)
        # a share is drawn towards one half, so that rare suffixes say little
        share = (self.blocked[at] - block + 5) / (self.labelled[at] - own + 10)
        text = [get[n].to_pylist() for n in ("url", "host", "path")]
        return np.array([lexical(*r) for r in zip(*text, self.count[at].tolist(), share.tolist())], float).reshape(-1, len(FEATURES))

    def scores(self, rows: pa.RecordBatch) -> np.ndarray:
        if self.trees is None:
            return np.zeros(rows.num_rows)
        return 1 / (1 + np.exp(-np.clip(self.trees.margin(self.features(rows)) - self.cut, -30, 30)))


def balance(y: np.ndarray) -> np.ndarray:
    """Weights by which both labels count the same."""
    ones = y.sum()
    return np.where(y > 0, len(y) / (2 * max(1.0, ones)), len(y) / (2 * max(1.0, len(y) - ones)))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(cut, precision, recall): the cut that tells balanced labels apart best, the highest of equals; midway to the next lower margin."""
    if not 0 < y.sum() < len(y):
        return 0.0, math.nan, math.nan
    weight = balance(y)
    values = np.unique(margin)[::-1]
    gain = [float((weight * np.where(y > 0, margin >= v, margin < v)).sum()) for v in values]
    k = int(np.argmax(gain))
    cut = float((values[k] + values[k + 1]) / 2 if k + 1 < len(values) else values[k])
    hit = margin >= cut
    return cut, float((hit & (y > 0)).sum() / max(1, hit.sum())), float((hit & (y > 0)).sum() / y.sum())


def prepared(pages: DataFrame, rules: list[tuple[str, str, str]], labels: Column | None) -> DataFrame:
    """(page_id, url, host, path, rule, decided, label, bucket): decided is the rule's verdict, label what may be learned."""
    urls = pick(pages, "page_id", "url") if labels is None else pages
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("decided", verdict).withColumn("label", F.col("decided") if labels is None else labels)
    label = F.when(F.col("label").isin("allow", "block"), F.col("label"))
    bucket = F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIX_BUCKETS)).cast("int")
    return urls.select("page_id", "url", "host", "path", "rule", "decided", label.alias("label"), bucket.alias("bucket"))


def learn(urls: DataFrame, sample: int = SAMPLE) -> Filter:
    """Statistics over all rows of prepared() URLs, and trees from at most `sample` of the labelled ones, chosen by a hash."""
    stats = urls.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked")).toArrow()
    columns = [np.zeros(SUFFIX_BUCKETS) for _ in range(3)]
    for column, name in zip(columns, ("n", "labelled", "blocked")):
        column[np.array(stats.column("bucket"))] = np.array(stats.column(name))
    found = Filter(None, *columns)
    chosen = urls.where("label is not null").withColumn("h", F.xxhash64("url", "page_id")).orderBy("h", "url", "page_id").limit(sample)
    rows = chosen.select("url", "host", "path", "bucket", "label", "h").toArrow().combine_chunks()
    if not rows.num_rows:
        return found
    batch = rows.to_batches()[0]
    x, y = found.features(batch), np.array([v == "block" for v in batch.column(4).to_pylist()], float)
    held = (np.array(batch.column(5)) >> 7) % 5 == 0  # equal URLs of one page fall on one side
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    if len(set(y.tolist())) < 2:  # URLs of one label don't tell what the other looks like
        return found
    found.trees = grow(x[~held], y[~held], balance(y[~held]))
    found.cut, found.precision, found.recall = calibrate(found.trees.margin(x[held]), y[held])
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: Column | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages(page_id, url).

    labels: what the trees learn, block or allow or null for an unlabelled URL; by default the rules' verdicts. The
    verdict is the rule's, else block where the score reaches the threshold. Of equally long rules that fit, the
    later in the list counts. Without URLs of both labels the score is 0 and what no rule decides is allowed. Null, empty and malformed URLs
    have empty host and path, and are judged like others. Repeated rows each get a row. No rows give no rows.
    """
    urls = prepared(pages, rules, labels)
    shared = pages.sparkSession.sparkContext.broadcast(learn(urls, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            p = shared.value.scores(rows)
            kept = [rows.column(rows.schema.get_field_index(n)) for n in ("page_id", "host", "path", "rule")]
            own = rows.column(rows.schema.get_field_index("decided")).to_pylist()
            verdicts = [v or ("block" if q >= threshold else "allow") for v, q in zip(own, p)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(verdicts, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return urls.mapInArrow(score, "page_id bigint, host string, path string, rule string, verdict string, score double")


def op2_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"))
