"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

The regression is trained on a small labelled URL table (the one below, or a DataFrame of url and
label of at most ``LABELLED_ROWS`` rows) and applied to every url. N-grams never cross from host to
path, and the same n-gram counts apart in either.

The host is what stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
the path follows up to ``?``, ``#`` or the end. A rule fits its host and all its subdomains if the path
starts with the rule's path; of several the longest wins, and of equally long ones a block.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
judged by the model as it is (the model's intercept: allowed by the default table); repeated rows are
judged alike; an empty table gives an empty table; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.batches import appended, flat, mix, schema_with

BITS = 14
ORDERS = (3, 4, 5)
#: Most rows of a labelled table.
LABELLED_ROWS = 10_000

#: Hosts of the default table, made up for it. Words of a kind stand in several forms, so that their n-grams carry the label.
BLOCKED_HOSTS = (
    "best-pills-online.example.com", "www.pills-direct.example.net", "pillshop24.example.org", "pills4less.example.com",
    "lucky-casino.example.net", "blog.casino-nights.example.com", "royal-casino.example.org", "m.casino-bonus.example.com",
    "free-bets.example.net", "www.football-bets.example.org", "sport-bets.example.com", "bets24.example.net",
    "adult-chat.example.com", "www.adult-movies.example.net", "adult-video.example.org", "xxx-adult.example.com",
    "spam-mailer.example.org", "blog.spam-links.example.com", "link-spam.example.net", "spamhub.example.com", "spam-site.example.net", "www.buyspam.example.org",
    "click-tracker.example.com", "m.ad-clicks.example.net", "pixel-tracker.example.org", "adserver-track.example.com",
    "payday-loans.example.com", "win-money-fast.example.net", "free-viagra.example.org", "malware-download.example.com",
    "diet-pills.example.net", "pills-without-prescription.example.org", "online-bets.example.net", "casino24.example.org",
    "adult-dating.example.org", "m.adult-pics.example.net", "adultshop.example.com", "www.pills-and-more.example.net", "vegas-casino.example.com",
    "casino-slots.example.net", "horse-bets.example.com", "instant-loans.example.org", "cheap-replica-watches.example.net", "cheap-rx.example.com",
)
ALLOWED_HOSTS = (
    "www.example.com", "blog.example.org", "m.example.net", "news.example.com", "weather.example.org", "docs.example.net",
    "city-library.example.org", "open-data.example.net", "my-garden.example.com", "evening-post.example.org", "schule.example.net",
    "university.example.org", "museum.example.com", "recipes.example.net", "travel-notes.example.com", "forum.example.org",
    "wiki.example.net", "shop.example.com", "blog.harbour-walks.example.com", "m.rowing-club.example.net", "lakeside.example.org",
    "www.owl-watch.example.com", "rathaus.example.net", "blog.wanderung.example.org", "www.bibliotheque.example.com", "m.ayuntamiento.example.net",
    "north-thames.example.com", "southport-theatre.example.org", "www.thornhill.example.net", "the-cathedral.example.com", "ruth-smith.example.org",
    "m.authors.example.com", "blog.otherworld.example.net", "mathematics.example.org", "www.earthworks.example.com", "health-centre.example.net",
    "allotments.example.org", "m.station-hotel.example.com", "www.union-street.example.net", "nation.example.org", "sailing-lessons.example.com",
    "enderby.example.net", "www.tiere.example.org", "leihladen.example.com", "quartier.example.net", "rosa-jardin.example.com",
    "choir.example.org", "stadt-archiv.example.com", "bookshop.example.org", "shop.garden.example.net", "video-archive.example.org", "track-and-field.example.org",
)
LABELLED_PATHS = ("/en/12", "/fr/345.html", "/de/6789/", "/es/1011", "/", "/en/about", "/de/impressum.html", "/es/blog/2")


def labelled_urls() -> list[tuple[str, int]]:
    """The default table: (url, 1 to block or 0)."""
    hosts = [(h, 1) for h in BLOCKED_HOSTS] + [(h, 0) for h in ALLOWED_HOSTS]
    return [(f"https://{h}{LABELLED_PATHS[(i + 3 * k) % len(LABELLED_PATHS)]}", y) for i, (h, y) in enumerate(hosts) for k in range(2)]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def rule_fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def by_rules(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The winning rule as text, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "block"))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    name = F.coalesce(*[F.when(rule_fits(r, host, path), r.host + r.path) for r in ordered])
    return name, F.coalesce(*[F.when(rule_fits(r, host, path), r.verdict) for r in ordered])


def _grams(texts: pa.Array, salt: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every byte n-gram; a text is framed, so its edges are n-grams too."""
    framed = pc.binary_join_element_wise(pa.scalar("^"), pc.fill_null(texts, ""), pa.scalar("$"), pa.scalar(""))
    data, offsets = flat(framed)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    rows, buckets = [], []
    for n in ORDERS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, salt * 8 + n, np.uint64)
        inside = np.ones(len(h), bool)
        for k in range(n):
            part = data[k : k + len(h)]
            h = h * np.uint64(0x100000001B3) + part
            inside &= part != 0
        rows.append(row[: len(h)][inside])
        buckets.append((mix(h) >> np.uint64(64 - bits)).astype(np.int64)[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    bits: int = BITS

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability that a url is to be blocked."""
        total = np.full(len(hosts), self.intercept)
        for salt, column in ((1, hosts), (2, paths)):
            row, bucket = _grams(column, salt, self.bits)
            total += np.bincount(row, weights=self.weights[bucket], minlength=len(hosts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(labelled: list[tuple[str, str, int]], bits: int = BITS, l2: float = 0.02, rounds: int = 400, rate: float = 0.3) -> Model:
    """Logistic regression by gradient descent on (host, path, label) rows."""
    hosts, paths = pa.array([r[0] for r in labelled], pa.string()), pa.array([r[1] for r in labelled], pa.string())
    y = np.array([r[2] for r in labelled], float)
    parts = [_grams(hosts, 1, bits), _grams(paths, 2, bits)]
    row, bucket = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    w, b, gw, gb = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-8), 1e-8
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[bucket], minlength=len(y)), -500, 500)))
        e = (p - y) / len(y)
        g, h = np.bincount(bucket, weights=e[row], minlength=1 << bits) + l2 / len(y) * w, e.sum()
        gw += g * g
        gb += h * h
        w -= rate * g / np.sqrt(gw)
        b -= rate * h / np.sqrt(gb)
    return Model(w, float(b), bits)


def train_from(labelled: DataFrame) -> Model:
    """``train`` on a table of url and label (1 to block, 0 to allow); rows with a null are left out."""
    rows = (
        labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
        .select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("int").alias("label"))
        .orderBy("host", "path", "label")
        .limit(LABELLED_ROWS + 1)
        .collect()
    )
    if len(rows) > LABELLED_ROWS:
        raise ValueError(f"the labelled table has more than {LABELLED_ROWS} rows")
    return train([(r["host"], r["path"], r["label"]) for r in rows])


def judge_urls(pages: DataFrame, rules: list[Rule], model: Model, url: str = "url", least: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, block_score and verdict (allow or block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            score = model.score(batch.column(names.index("host")), batch.column(names.index("path")))
            yield appended(batch, {"block_score": pa.array(score, pa.float64())})

    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    scored = split.mapInArrow(run, schema_with(split, {"block_score": T.DoubleType()}))
    rule, verdict = by_rules(rules, F.col("host"), F.col("path"))
    judged = F.coalesce(verdict, F.when(F.col("block_score") >= least, "block").otherwise("allow"))
    return scored.withColumns({"rule": rule, "verdict": judged})
