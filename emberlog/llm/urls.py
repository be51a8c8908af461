"""URL filters: host and path rules, and for the rest gradient-boosted trees on lexical features, in DataFrame functions only.

A rule is a host and a path; it fits URLs on that host and its subdomains whose path starts with the rule's, and the longest
fitting rule decides.  URLs that no rule fits are judged by boosted regression trees on length, depth, digit ratio, entropy,
parameter counts, spam words and suffix statistics.  The trees are trained on labelled URLs.  By default the labels are lexical
evidence and no function of the rules' hosts: URLs with spam words are bad, those with none that no rule blocks are good, others
have no label; half of the training rows hide their words, so the trees learn the shape of such URLs as well.  Statistics of
suffixes count all labelled rows but those of the row's own group of hosts, in a fixed number of hashed bins; a suffix that no
other group has is neutral.  The trees are fitted on a bounded sample of ``TRAINING_ROWS`` (documented limit) and then applied as one SQL expression.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged on its other features.  Equal
rows are judged alike.  Without labelled rows of both kinds the trees say allow.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import sampled
from emberlog.llm.quality import count_of, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (at most twice as many) that the trees are fitted on, bins of the suffix statistics, and the model's size.
TRAINING_ROWS, SUFFIX_BINS = 5_000, 256
#: Groups of hosts; the suffix statistics of a host leave its own group out.
GROUPS = 8
TREES, DEPTH, RATE, CUTS, MIN_LEAF = 30, 3, 0.3, 16, 5
#: Words of a host or path that show spam, and words of a host that do so only together.
SPAM_WORDS = "casino casinos poker bet bets betting jackpot roulette lottery pill pills viagra cialis pharma adult porn porno xxx escort escorts webcam spam adserver ads warez keygen torrent torrents malware phishing payday"
DOUBTFUL_WORDS = "free win winner cheap bonus prize track tracker tracking click clicks farm deals loan loans replica slots hot sex"
EVIDENCE = 2
#: The trees block a URL only when they are this sure; lexical labels miss some bad URLs, and the rest shall stay.
BLOCK_AT = 0.9

#: The rules of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/?[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    chosen = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = chosen.when(fits, value)
    return chosen


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""

    def of(chars: Column) -> Column:
        def bits(c: Column) -> Column:
            return let(F.size(F.filter(chars, lambda x: x == c)) / F.size(chars), lambda p: -p * F.log2(p))

        return F.when(F.size(chars) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + bits(c))).otherwise(0.0)

    return let(F.filter(F.split(text, ""), lambda x: x != ""), of)


def word_evidence(host: Column, path: Column) -> Column:
    """Twice the spam words of host and path, and the doubtful words of the host."""

    def count(text: Column, words: str) -> Column:
        return F.regexp_count(text, F.lit(f"(?i)(?<![a-z])(?:{'|'.join(words.split())})(?![a-z])"))

    return EVIDENCE * count(F.concat(host, path), SPAM_WORDS) + count(host, DOUBTFUL_WORDS)


def suffix_bin(host: Column, labels: int) -> Column:
    """The hashed bin of a host's last labels."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -labels)), F.lit(SUFFIX_BINS)).cast("int")


def with_features(pages: DataFrame) -> DataFrame:
    """Add the columns f0, f1, ..., the group of the host and the two suffix bins."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    length = F.length(url)
    features = [
        length,
        F.length(host),
        F.length(path),
        count_of(path, "/"),
        count_of(host, "."),
        count_of(url, "0123456789") / F.greatest(length, F.lit(1)),
        count_of(host, "0123456789") / F.greatest(F.length(host), F.lit(1)),
        count_of(host, "-"),
        count_of(path, "-_"),
        entropy(url),
        entropy(host),
        F.when(query == "", 0).otherwise(count_of(query, "&") + 1),
        count_of(url, "="),
        F.length(query),
        url.contains("#").cast("int"),
        url.startswith("https://").cast("int"),
        count_of(url, "%@~"),
        F.length(F.substring_index(host, ".", 1)),
        word_evidence(host, path),
    ]
    return pages.withColumns({f"f{k}": f.cast("double") for k, f in enumerate(features)} | {"group": F.pmod(F.xxhash64(host, F.lit(5)), F.lit(GROUPS)).cast("int"), "bin1": suffix_bin(host, 1), "bin2": suffix_bin(host, 2)})


FEATURES = [f"f{k}" for k in range(19)] + ["s1", "s2"]
WORDS = FEATURES[18]


def suffix_statistics(labelled: DataFrame, name: str) -> list[float]:
    """Smoothed share of blocked rows per bin and group of hosts (at bin * GROUPS + group), over the labelled rows of all other groups."""
    rows = labelled.groupBy(name, "group").agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n")).collect()  # at most SUFFIX_BINS * GROUPS
    share = sum(r["blocked"] for r in rows) / max(1, sum(r["n"] for r in rows))
    blocked, n = [0] * (SUFFIX_BINS * GROUPS), [0] * (SUFFIX_BINS * GROUPS)
    for r in rows:
        for group in range(GROUPS):
            if group != r["group"]:
                blocked[r[name] * GROUPS + group] += r["blocked"]
                n[r[name] * GROUPS + group] += r["n"]
    return [(b + 10 * share) / (k + 10) for b, k in zip(blocked, n, strict=True)]


def fit_trees(rows: list[list[float]], labels: list[int]) -> tuple[float, list]:
    """Boosted trees for log-odds: (start, trees); a tree is a leaf value or (feature, cut, low, high)."""
    import numpy as np

    x, y = np.array(rows, float).reshape(len(rows), len(FEATURES)), np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return (-4.0 if len(y) == 0 or y[0] == 0 else 4.0), []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    start = math.log(y.mean() / (1 - y.mean()))
    score, trees = np.full(len(y), start), []

    def grow(at, g, h, depth):
        G, H = g[at].sum(), h[at].sum()
        best = (1e-6, None)
        if depth:
            for k, options in enumerate(cuts):
                for c in options:
                    low = x[at, k] <= c
                    n = int(low.sum())
                    if min(n, len(at) - n) < MIN_LEAF:
                        continue
                    gl, hl = g[at][low].sum(), h[at][low].sum()
                    gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                    if gain > best[0]:
                        best = (gain, (k, float(c), low))
        if best[1] is None:
            return float(RATE * G / (H + 1))
        k, c, low = best[1]
        return k, c, grow(at[low], g, h, depth - 1), grow(at[~low], g, h, depth - 1)

    def value(tree, r):
        while isinstance(tree, tuple):
            tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score += np.array([value(tree, r) for r in x])
    return start, trees


def tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    k, c, low, high = tree
    return f"CASE WHEN {FEATURES[k]} <= {c!r}D THEN {tree_sql(low)} ELSE {tree_sql(high)} END"


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score) for ``pages`` (page_id, url).

    ``labelled`` (url, label; 1 is block) trains the trees; by default lexical evidence labels ``pages`` itself.  The score is
    the log-odds of block.
    """

    def parsed(frame: DataFrame) -> DataFrame:
        return frame.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})

    rows = parsed(pages.select("page_id", "url")).withColumn("decided", rule_of(F.col("host"), F.col("path"), rules))
    lexical = labelled is None
    if lexical:
        evidence = word_evidence(F.col("host"), F.col("path"))
        blocked = F.coalesce(F.col("decided")["verdict"] == "block", F.lit(False))
        labelled = rows.select("url", F.when(evidence >= EVIDENCE, 1).when((evidence == 0) & ~blocked, 0).alias("label"))
    known = with_features(parsed(labelled.select("url", "label").where(F.col("label").isNotNull())))
    tables = [suffix_statistics(known, "bin1"), suffix_statistics(known, "bin2")]

    def filled(frame: DataFrame) -> DataFrame:
        return frame.withColumns({f"s{n + 1}": F.get(F.array(*map(F.lit, t)), F.col(f"bin{n + 1}") * GROUPS + F.col("group")) for n, t in enumerate(tables)})

    sample = filled(sampled(known, [F.col("url")], TRAINING_ROWS))
    if lexical:
        sample = sample.withColumn(WORDS, F.when(F.pmod(F.xxhash64("url", F.lit(11)), F.lit(2)) == 0, F.col(WORDS)).otherwise(0.0))
    sample = sample.select(*FEATURES, "label").orderBy(*FEATURES, "label").collect()
    start, trees = fit_trees([list(r)[:-1] for r in sample], [r["label"] for r in sample])
    scored = filled(with_features(rows)).withColumn("score", F.expr(" + ".join([f"{start!r}D", *map(tree_sql, trees)])))
    verdict = F.coalesce(F.col("decided")["verdict"], F.when(F.col("score") > math.log(BLOCK_AT / (1 - BLOCK_AT)), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("decided")["rule"].alias("rule"), verdict.alias("verdict"), "score")
