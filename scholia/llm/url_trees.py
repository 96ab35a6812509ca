"""URL filter: gradient-boosted trees on lexical features of URLs, under fixed host and path rules.

Features: lengths of URL, host and path, depth, digit ratio, entropy of the host's and path's bytes, parameters,
hyphens, labels of the host, and statistics of the host's suffixes: how many labelled URLs end in the same two and
three labels, and the smoothed share of blocked ones among them; and the same for the words of the host's name and for those of
path and query (the largest share).  A labelled URL's own host is left out of its statistics.  Boosting fits histogram trees of depth
``DEPTH`` to the gradient of the log loss, in numpy.

Labelled URLs are a table (url, blocked), of which a bounded sample is taken: at most ``SAMPLE`` distinct URLs, those
of the smallest hashes.  Without a table they are ``made_up`` ones: URLs of our own making, of unwanted and of harmless
sites, made by no table's pattern.  The rules' verdicts are no labels; rules always decide the URLs they fit.
``Filter.auc`` is the area under the curve over the hosts of every fifth hash, by trees that didn't see them; ``auc_by_group`` is
that of labels whose words the trees have never seen, with all features and with some.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; URLs of any length are
whole; repeated rows give repeated rows; without labels of both kinds the trees allow; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The rules, as host and path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

# Words by which lists of unwanted sites name gambling, loans, medicines, copies, adult pages, advertising and malware.
UNWANTED = (
    "casino poker bet bets betting slots jackpot roulette lottery gambling sportsbook payday debt loans cashadvance pills viagra cialis pharma steroids replica counterfeit knockoff warez torrent crack keygen "
    "adult porn xxx sex escort camgirls hookup popunder clickbait adserver ads adware tracker spam phishing scam malware trojan hacked botnet fakeid doubler getrich"
).split()
# Words that sites of both kinds use, and words of sites that nobody minds.
COMMON = (
    "free gift deal deals offer offers bonus win winner prize cheap best top discount sale shop store online credit money crypto coin forex trade data track link links promo cash farm hot live club game games "
    "network media world web click page home info group team plus pro direct express secure safe my the new daily"
).split()
HARMLESS = (
    "library museum school college news times post journal garden kitchen recipes weather history science music theatre city river lake forest mountain travel books authors press letters open "
    "code docs guide health clinic family village north south saint old green blue house studio art gallery sport league radio town county state union centre research review church bakery farmers cycling"
).split()
CONSONANTS, VOWELS = "b c d f g h j k l m n p r s t v w z br ch cl cr dr fr gr kl pl pr sch sl sp st str th tr".split(), "a e i o u ai ea ei ie oo ou".split()
PLACES = "en de fr es it news blog articles shop page wiki about view item topics archive category product tag post img".split()
DOMAINS = "com com com net net org info de fr it es nl pl eu io co co.uk com.br co.jp edu gov".split()
CHEAP_DOMAINS = "xyz top click icu loan win bid".split()
PARAMETERS, TRACKING = "id page q lang ref sort view date utm_source utm_campaign".split(), "aff affid clickid subid pid offer_id redirect".split()
MADE_UP = 6000


def made_up(n: int = MADE_UP, seed: int = 6, words=lambda w: True) -> list[tuple[str, int]]:
    """n labelled URLs, half of them unwanted: 1 is block.  words: which words may be used.

    Hosts, hyphens, depths and languages are made alike for both kinds.  An unwanted URL has unwanted words in its host,
    its path or its query, or (one of twelve) only its form: a long host with many digits, many tracking parameters, a cheap domain.
    Common words are in both kinds.
    """
    rng = np.random.default_rng(seed)
    unwanted, common_, harmless = ([w for w in ws if words(w)] for ws in (UNWANTED, COMMON, HARMLESS))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    name = lambda: "".join(pick(CONSONANTS) + pick(VOWELS) + (pick(CONSONANTS) if rng.random() < 0.4 else "") for _ in range(int(rng.integers(1, 4))))
    digits = lambda k: "".join(str(int(rng.integers(10))) for _ in range(k))
    out = []
    for k in range(n):
        blocked = k % 2
        where = rng.choice(["host", "path", "query", "form"], p=[0.62, 0.2, 0.1, 0.08]) if blocked else ""
        good = lambda: pick([pick(harmless), pick(common_), name(), name()])
        host = [good() for _ in range(int(rng.integers(1, 4)))]
        path = [pick([pick(PLACES), pick(PLACES), good(), digits(int(rng.integers(1, 5))), f"{good()}-{good()}"]) for _ in range(int(rng.integers(0, 4)))]
        query = [f"{pick(PARAMETERS)}={pick([good(), digits(3)])}" for _ in range(int(rng.integers(0, 3)))]
        if where == "host":
            host[int(rng.integers(len(host)))] = pick(unwanted)
        elif where == "path":
            path += [pick([f"{pick(unwanted)}-{good()}", pick(unwanted), f"{good()}-{pick(unwanted)}.html"])] + ([pick(unwanted)] if rng.random() < 0.5 else [])
        elif where == "query":
            query += [f"{pick([*PARAMETERS, *TRACKING])}={pick(unwanted)}"]
        elif where == "form":
            host = [name() + digits(int(rng.integers(4, 9))), name() + digits(3)]
            query += [f"{pick(TRACKING)}={digits(int(rng.integers(6, 14)))}" for _ in range(int(rng.integers(3, 7)))]
        if rng.random() < (0.3 if blocked else 0.1):
            query += [f"{pick(TRACKING)}={digits(int(rng.integers(3, 9)))}"]
        tld = pick(CHEAP_DOMAINS) if rng.random() < (0.2 if blocked else 0.01) else pick(DOMAINS)
        joined = pick(["-", "-", ".", "-"]).join(host)
        tail = pick(["", "/", ".html", "#top"]) if path else pick(["", "/"])
        out.append((f"{pick(['http', 'https'])}://{pick(['', '', 'www.', 'm.', 'blog.', 'shop.'])}{joined}.{tld}{'/' if path else ''}{'/'.join(path)}{tail}{'?' + '&'.join(query) if query else ''}", blocked))
    return out


SAMPLE = 20_000
DEPTH = 3
TREES = 40
BINS = 32
RATE = 0.2
FEATURES = ["url_length", "host_length", "path_length", "depth", "digits", "host_entropy", "path_entropy", "parameters", "hyphens", "labels", "https", "suffix_count", "suffix_blocked", "site_count", "site_blocked", "word_count", "word_blocked", "text_count", "text_blocked"]
GROUPS = {"form": FEATURES[:11], "suffixes": FEATURES[11:15], "words of hosts": FEATURES[15:17], "words of paths and queries": FEATURES[17:]}
#: What the smoothed shares of statistics are drawn to the common share by, in URLs.
SMOOTH = 4


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query."""
    full = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(full, "://")
    rest = F.when(at > 0, full.substr(at + 3, F.length(full))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return host, path, query


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):  # the longest is asked first
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    _, n = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(url: str, host: str, path: str, query: str) -> list[float]:
    size = max(1, len(url))
    return [
        len(url), len(host), len(path), path.count("/"), sum(map(str.isdigit, url)) / size, _entropy(host), _entropy(path), query.count("&") + 1 if query else 0, host.count("-"), host.count(".") + 1 if host else 0,
        float(url.startswith("https")),
    ]


def split(url: str) -> tuple[str, str, str]:
    """Host, path and query, as ``parts`` gives them."""
    _, there, rest = url.partition("://")
    before, _, query = rest.partition("#")[0].partition("?")
    host, slash, path = before.partition("/")
    return (host.translate(_LOWER), slash + path, query) if there else ("", "", "")


_LOWER = {k: k + 32 for k in range(65, 91)}


def suffix_keys(host: str) -> tuple[list[str], list[str], list[str]]:
    """What a host's statistics are kept by: two labels, three labels, the words of its name."""
    labels = host.split(".")
    return [".".join(labels[-2:])], [".".join(labels[-3:])], ["-" + w for x in labels[:-1] for w in x.split("-") if len(w) > 1]


_TEXT_WORD = re.compile(r"[a-z]{2,}")


def text_keys(path: str, query: str) -> list[str]:
    """The words of path and query; a path of any length has no more keys than words."""
    return ["/" + w for w in dict.fromkeys(_TEXT_WORD.findall(f"{path} {query}".lower()))]


class Statistics:
    """Labelled URLs and blocked ones by suffix and word; texts: path and query of each URL, if they count."""

    def __init__(self, hosts: list[str], y: np.ndarray, texts: list[tuple[str, str]] | None = None):
        self.rate = (float(y.sum()) + 1) / (len(y) + 2)
        self.hosts: dict[str, list[float]] = {}
        for h, b in zip(hosts, y, strict=True):
            c = self.hosts.setdefault(h, [0, 0])
            c[0] += 1
            c[1] += b
        self.keys: dict[str, list[float]] = {}
        for h, (n, b) in self.hosts.items():
            for key in {k for ks in suffix_keys(h) for k in ks}:
                c = self.keys.setdefault(key, [0, 0])
                c[0] += n
                c[1] += b

        self.texts: dict[str, list[float]] = {}
        for text, b in zip(texts or (), y.tolist() if texts else (), strict=True):
            for key in text_keys(*text):
                c = self.texts.setdefault(key, [0, 0])
                c[0] += 1
                c[1] += b

    def _share(self, kept: dict[str, list[float]], keys: list[str], n0: float, b0: float) -> list[float]:
        """Of the key with the largest share of blocked ones: how many URLs, and the share."""
        share, count = self.rate, 0.0
        for key in keys:
            n, b = kept.get(key, (n0, b0))
            if n > n0:
                s = (b - b0 + SMOOTH * self.rate) / (n - n0 + SMOOTH)
                if not count or s > share:
                    share, count = s, n - n0
        return [float(np.log1p(count)), share]

    def features(self, host: str, leave_out: bool = False) -> list[float]:
        n0, b0 = self.hosts.get(host, (0, 0)) if leave_out else (0, 0)
        return [x for keys in suffix_keys(host) for x in self._share(self.keys, keys, n0, b0)]

    def text_features(self, path: str, query: str, own: float | None = None) -> list[float]:
        """own: the label of a URL that is itself among those counted."""
        return self._share(self.texts, text_keys(path, query), *((0, 0) if own is None else (1, own)))


def auc(y: np.ndarray, p: np.ndarray) -> float:
    """Area under the curve: the share of pairs in order, ties half."""
    _, at, n = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    good = y > 0
    pairs = good.sum() * (~good).sum()
    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / pairs) if pairs else 0.5


class Filter:
    """Statistics and trees of labelled URLs."""

    def __init__(self, labelled: list[tuple[str, int]]):
        labelled = sorted(set(labelled))
        hosts = [split(u)[0] for u, _ in labelled]
        y = np.array([b for _, b in labelled], float)
        held = np.array([zlib.crc32(h.encode()) % 5 == 0 for h in hosts], bool)
        self.auc = 0.5
        if held.any() and not held.all():
            self._fit([u for u, h in zip(labelled, held, strict=True) if not h])
            self.auc = auc(y[held], self.probability([u for (u, _), h in zip(labelled, held, strict=True) if h]))
        self._fit(labelled)

    def _fit(self, labelled: list[tuple[str, int]]) -> None:
        cut = [split(u) for u, _ in labelled]
        y = np.array([b for _, b in labelled], float)
        self.statistics = Statistics([c[0] for c in cut], y, [c[1:] for c in cut])
        x = [lexical(u, *c) + self.statistics.features(c[0], True) + self.statistics.text_features(*c[1:], float(b)) for (u, b), c in zip(labelled, cut, strict=True)]
        self.trees = Trees(np.array(x).reshape(len(x), len(FEATURES)), y)

    def probability(self, urls: list[str], cut: list[tuple[str, str, str]] | None = None) -> np.ndarray:
        cut = [split(u) for u in urls] if cut is None else cut
        return self.trees.probability(self.table(urls, cut))

    def table(self, urls: list[str], cut: list[tuple[str, str, str]]) -> np.ndarray:
        return np.array([lexical(u, *c) + self.statistics.features(c[0]) + self.statistics.text_features(*c[1:]) for u, c in zip(urls, cut, strict=True)]).reshape(len(urls), len(FEATURES))


def auc_by_group(known: list[tuple[str, int]], other: list[tuple[str, int]]) -> dict[str, float]:
    """By trees of ``known``, the area under the curve over ``other``: with all features, and with each group alone."""
    model, y = Filter(known), np.array([b for _, b in other])
    cut, own = [split(u) for u, _ in known], np.array([b for _, b in known], float)
    x = np.array([lexical(u, *c) + model.statistics.features(c[0], True) + model.statistics.text_features(*c[1:], float(b)) for (u, b), c in zip(known, cut, strict=True)])
    z = model.table([u for u, _ in other], [split(u) for u, _ in other])
    out = {"all": auc(y, model.trees.probability(z))}
    for group, names in GROUPS.items():
        at = [FEATURES.index(f) for f in names]
        out[group] = auc(y, Trees(x[:, at], own).probability(z[:, at]))
    return out


class Trees:
    """Boosted histogram trees for the log loss; arrays of heap-ordered nodes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        share = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
        self.start, self.depth, self.trees = float(np.log(share / (1 - share))), depth, []
        if len(set(y.tolist())) < 2:
            self.start = -5.0
            return
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        z = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree = self._grow(bins, edges, g, h)
            self.trees.append(tree)
            z += self._values(tree, x)

    def _grow(self, bins, edges, g, h):
        inner, nodes = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(nodes)
        at = np.zeros(len(g), np.int64)
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            gs, hs = g[here].sum(), h[here].sum()
            value[node] = RATE * gs / (hs + 1)
            if node >= inner or len(here) < 2:
                if node < inner:
                    at[here] = 2 * node + 1
                continue
            best, choice = 1e-9, None
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(bins[here, f], g[here], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[here, f], h[here], len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, choice = gain[k], (f, k)
            if choice:
                feature[node], cut[node] = choice[0], edges[choice[0]][choice[1]]
                at[here] = 2 * node + 1 + (bins[here, choice[0]] > choice[1])
            else:
                at[here] = 2 * node + 1
        return feature, cut, value

    def _values(self, tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for t in self.trees:
            z += self._values(t, x)
        return 1 / (1 + np.exp(-z))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.  labelled: url, blocked (0 or 1)."""
    if labelled is None:
        known = made_up()
    else:
        distinct = labelled.where("url is not null and cast(blocked as int) in (0, 1)").groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("blocked"))
        known = [(r["url"], r["blocked"]) for r in distinct.orderBy(F.xxhash64("url"), "url").limit(sample).collect()]
    model = pages.sparkSession.sparkContext.broadcast(Filter(known))
    host, path, query = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"), query.alias("query"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("decided", decided)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(batches):
            url, host, path, query, decided = (b.column(b.schema.get_field_index(k)).to_pylist() for k in ("url", "host", "path", "query", "decided"))
            p = model.value.probability(url, list(zip(host, path, query, strict=True)))
            verdict = [r or ("block" if q >= 0.5 else "allow") for r, q in zip(decided, p, strict=True)]
            keep = [b.column(b.schema.get_field_index(k)) for k in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(verdict, pa.string()), pa.array(p, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "block_score"])

    return rows.mapInArrow(score, "page_id long, host string, path string, rule string, verdict string, block_score double")
