"""The deciding parts of operators against slow versions of their own, and registered SQL on awkward texts."""

from __future__ import annotations

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import packing, queries, toxicity, urls

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None,
    "",
    " \n\t\v\f\r ",
    "one\vtwo\fthree\rfour\r\nfive six\tseven eight nine ten eleven",
    "a b c d e a b c d e a b c d e\n\r\n\va b\na b",
    "é ü 😀 \x00 <|endoftext|> it's we'LL don't   x　y   z\n\n\n",
    "\x85next​line᠎" + " the of and" * 40 + " <>#*$%&|" * 9,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents of odd texts beside ordinary ones."""
    folder = str(tmp_path_factory.mktemp("odd"))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    first = documents.agg(F.max("doc_id")).first()[0] + 1
    more = spark.createDataFrame([(first + k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    documents.unionByName(more, allowMissingColumns=True).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_on_odd_texts(spark, odd, name):
    """Words end at the six ASCII white-space characters and at no others, in queries and in SQL."""
    found = queries.QUERIES[name](spark, odd)
    columns = sorted(found.columns)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name].strip().rstrip(';')})").fetchall()

    def rows(some):
        return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in some)

    assert rows(found.select(*columns).collect()) == rows(expected)


# 2 packing


def test_ids_are_those_of_the_vocabulary_file(spark):
    """The faster library that packing uses gives the same ids as the tokenizer that the vocabulary file is written for."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    alphabet = list("aAbZ09 \t\n\r\v\f'.,!-_sStT") + [" ", " ", "　", "é", "ß", "Ω", "漢", "😀", "́", "\x00", "\x7f", "​"]
    drawn = ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(3_000)]
    texts = [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    encode = packing.default_encoder()
    for text in texts + drawn + [t or "" for t in ODD_TEXTS]:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, text[:200]


# 5 URLs


def _int_hash(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _host(url: str) -> str:
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if "://" in url else ""


def _path(url: str) -> str:
    return re.split(r"[?#]", url.split("://", 1)[1][len(_host(url)) :], maxsplit=1)[0] if "://" in url else ""


def _entropy(text: str) -> float:
    return -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))


def _evidence(host: str, path: str) -> int:
    def count(text: str, words: str) -> int:
        return sum(m.lower() in words.split() for m in re.findall("[A-Za-z]+", text))

    return urls.EVIDENCE * count(host + path, urls.SPAM_WORDS) + count(host, urls.DOUBTFUL_WORDS)


def _features(url: str) -> list[float]:
    host, path = _host(url), _path(url)
    query = re.search(r"(?s)\?([^#]*)", url)
    query = query[1] if query else ""
    digits = lambda t: sum(c in "0123456789" for c in t)
    return [
        len(url),
        len(host),
        len(path),
        path.count("/"),
        host.count("."),
        digits(url) / max(1, len(url)),
        digits(host) / max(1, len(host)),
        host.count("-"),
        path.count("-") + path.count("_"),
        _entropy(url),
        _entropy(host),
        query.count("&") + 1 if query else 0,
        url.count("="),
        len(query),
        int("#" in url),
        int(url.startswith("https://")),
        sum(map(url.count, "%@~")),
        len(host.split(".")[0]),
        _evidence(host, path),
    ]


def test_url_scores_match_slow_trees(spark, monkeypatch):
    """Features, suffix statistics and the sum of the trees, recomputed URL by URL."""
    fitted = []
    fit = urls.fit_trees
    monkeypatch.setattr(urls, "fit_trees", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    names = ["casino-royal", "news", "shop24", "cheap-pills", "a.b.library", "poker", "m.garden"]
    rows = [(k, f"http{'s' * (k % 2)}://{names[k % 7]}{k % 11}.Example.{('com', 'net', 'org')[k % 3]}/p{k % 13}/{'x_y-' * (k % 4)}{'?q=1&r=%20' * (k % 5 == 0)}{'#top' * (k % 9 == 0)}") for k in range(700)]
    rows += [(700, ""), (701, "no scheme"), (702, "http://h?only=query"), (703, "http://")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(u, int(_evidence(_host(u), _path(u)) >= 2)) for _, u in rows], "url string, label int")
    found = {r.page_id: r for r in urls.judge(frame, rules=(), labelled=labelled).collect()}
    start, trees = fitted[0]
    assert trees

    def group(host: str) -> int:
        return _signed(_int_hash(5, xxhash.xxh64_intdigest(host.encode(), 42))) % urls.GROUPS

    def bin_of(host: str, labels: int) -> int:
        return _signed(xxhash.xxh64_intdigest(".".join(host.split(".")[-labels:]).encode(), 42)) % urls.SUFFIX_BINS

    known = [(_host(r.url), r.label) for r in labelled.collect()]
    share = sum(y for _, y in known) / len(known)

    def suffix(host: str, labels: int) -> float:
        others = [y for h, y in known if bin_of(h, labels) == bin_of(host, labels) and group(h) != group(host)]
        return (sum(others) + 10 * share) / (len(others) + 10)

    def walk(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for k, url in rows:
        x = [*_features(url), suffix(_host(url), 1), suffix(_host(url), 2)]
        score = start + sum(walk(t, x) for t in trees)
        assert math.isclose(found[k].score, score, rel_tol=1e-9, abs_tol=1e-9), url
        assert found[k].verdict == ("block" if 1 / (1 + math.exp(-score)) > urls.BLOCK_AT else "allow")


# 10 toxicity


def _slow_clause(words: list[str], entries: dict[str, float]) -> tuple[float, bool]:
    """A clause's weight with the four machines run side by side, each in its own state."""
    machines = [toxicity.TARGETING, toxicity.NEGATING, toxicity.REPORTING, toxicity.REPEATING]
    states, weight, matched = [0] * 4, 0.0, False
    for word in words:
        symbol, own = toxicity.OTHER, 0.0
        for name, listed, w in ((toxicity.INSULT, toxicity.INSULTS, 4.0), (toxicity.THREAT, toxicity.THREATS, 4.0), (toxicity.TARGET, toxicity.TARGETS, 0.0), (toxicity.NEGATION, toxicity.NEGATIONS, 0.0), (toxicity.REPORT, toxicity.REPORTS, 0.0)):
            if word in listed:
                symbol, own = name, w
        if word in entries:
            symbol, own = toxicity.INSULT, entries[word]
        if symbol != toxicity.INSULT:
            stems = [w for e, w in entries.items() if e.endswith("*") and word.startswith(e[:-1])]
            if stems:
                symbol, own = toxicity.INSULT, max(stems)
        factor = 1.0
        for k, machine in enumerate(machines):
            states[k], added, times = machine.step(states[k], symbol)
            weight, factor = weight + added, factor * times
        if symbol in (toxicity.INSULT, toxicity.THREAT):
            weight, matched = weight + own * factor, True
    return weight, matched


def test_toxicity_scores_match_a_slow_scorer(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    odd = ["you are NOT an idiot; he said you idiot! kill you", "said idiot moron. not kill", "Idiot's you", None, "...", "not so very much idiot you"]
    some = docs.where("doc_id % 7 = 0").select("doc_id", "text").unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    texts = dict(some.collect())
    scored = toxicity.score(some, model).collect()
    assert len(scored) == len(texts)
    matched_texts = 0
    for r in scored:
        best = total = 0.0
        for clause in re.split(r"[.;:!?\n]+", (texts[r.doc_id] or "").lower()):
            weight, matched = _slow_clause(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause), model.lexicon)
            if matched and weight > 0:
                best, total = max(best, weight), total + weight
        x = model.bias + model.best * best + model.total * math.log1p(total)
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-60.0, min(60.0, x)))), rel_tol=1e-9), texts[r.doc_id]
        matched_texts += total > 0
    assert matched_texts > 10


def test_held_out_rows_are_by_checksum(spark):
    ids = [0, 1, 5, 999, 10**12, -3]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id"))).collect()
    assert [tuple(r) for r in rows] == [(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in ids]
