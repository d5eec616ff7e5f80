"""Allowing and blocking URLs: rules for hosts and paths first, a learned judge for the rest.

The judge is a logistic regression on hashed character n-grams of host and path, fitted in numpy to a small table of labelled
URLs. Its n-grams are hashed on the executors; only their places come to the driver, for `most` labelled URLs at most. A rule
(host, path) fits the host and all its subdomains, if the URL's path starts with the rule's; of several the longest (host and
path together) wins, of equally long ones the one with the longer host, and block before allow.

Up to MOST_RULES rules are sent to the tasks and the URLs do not move. More rules meet the distinct (host, path) in a join on
(host suffix, path prefix), which AQE splits where one rule fits a large share of them.

Defined cases: null URLs, those without `://` and those without a host have an empty host, and the first two an empty path too;
they have no n-grams, so that the judge's bias decides. Ports and user names stay part of the host. Rows that repeat
get their verdict each; an empty table gives no rows; rules without a host or with another verdict are left out, a null path is
empty; without labelled URLs the judge allows everything. Other columns are handed on if they are named in `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.llm.bytewords import mixed, pieces, texts_of

#: More rules than this are not sent to the tasks.
MOST_RULES = 200_000
RULES = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table to start from: host names of unwanted sites are made of words like these, ordinary ones are not.
UNWANTED = (
    "cheap-meds.example.com buy-pills-online.example.org discount-pills.example.net pharma-deals.example.com no-rx-pills.example.org "
    "casino-royal.example.com online-casino.example.net win-big-slots.example.org lucky-win.example.com jackpot-casino.example.org "
    "free-spins.example.com sports-bets.example.net best-bets-today.example.org poker-win.example.net bets4u.example.com "
    "spam-links.example.com spammy.example.org link-farm.example.net seo-farm.example.com content-farm.example.org "
    "ads-server.example.com popup-ads.example.net ad-track.example.org track-clicks.example.com click-track.example.net "
    "adult-cams.example.com xxx-adult.example.net adult-dating.example.org free-prizes.example.net free-iphone.example.com "
    "cheap-loans.example.org payday-cash.example.com get-rich-quick.example.net crypto-doubler.example.org cheap-replica.example.com"
).split()
WANTED = (
    "news.example.com daily-news.example.org weather.example.net city-library.example.org museum.example.com university.example.net "
    "physics-dept.example.org recipes.example.com garden-club.example.net railway-times.example.org school.example.com travel.example.net "
    "history-blog.example.org photography.example.com music-review.example.net open-data.example.org docs.example.com wiki.example.net "
    "hospital.example.org health-advice.example.com science.example.net parliament.example.org city-council.example.com theatre.example.net "
    "bird-watching.example.org hiking-trails.example.com astronomy.example.net chess-club.example.org books.example.com journal.example.net "
    "northern-herald.example.org harbour.example.com methodist.example.net lantern.example.org stonehouse.example.com riverton.example.net "
    "thornton.example.org entire.example.com thistle.example.net anthem.example.org whether.example.com another.example.net "
    "weathered.example.org southern.example.com rotation.example.net mention.example.org nation.example.com stationers.example.net "
    "leather.example.org gathering.example.com bakery.example.net sheriffs.example.org ringing.example.com blessed.example.net"
).split()
SECTIONS = ("/en/12", "/fr/345?page=2", "/de/78.html", "/es/901/", "/en/4#top", "/fr/56?utm_source=feed", "", "/about", "/de/2024/05/article")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 if unwanted): the hosts above, with sections and subdomains that say nothing about them."""
    fronts = ("https://www.", "http://", "https://blog.", "http://m.")
    return [
        (f"{fronts[(i + j) % 4]}{host}{SECTIONS[(i + 2 * j) % len(SECTIONS)]}", label)
        for label, hosts in ((1, UNWANTED), (0, WANTED))
        for i, host in enumerate(hosts)
        for j in range(3)
    ]


@dataclass(frozen=True)
class UrlSettings:
    """n-gram sizes, places of the hash, most labelled URLs, and how long, fast and smoothly the regression is fitted."""

    sizes: tuple[int, ...] = (3, 4, 5)
    places: int = 1 << 16
    most: int = 5_000
    rounds: int = 300
    rate: float = 0.5
    penalty: float = 1e-3
    threshold: float = 0.5
    seed: int = 23


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


class Grams:
    """Hashed n-grams of the characters of a string column; hosts and paths differ in their salt."""

    def __init__(self, settings: UrlSettings, salt: int):
        self.settings, self.salt = settings, np.uint64(salt)
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        base = 0x5851F42D4C957F2D
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            powers = np.full(n, factor, np.uint64)
            powers[0] = 1
            setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every n-gram; rows begin and end with a mark that counts as a character, empty ones have none."""
        framed = pc.binary_join_element_wise("\x02", column, "\x03", "")
        data, offsets = texts_of(pc.if_else(pc.equal(pc.binary_length(column), 0), "", framed))
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, end in pieces(offsets):
            own = data[offsets[first] : offsets[end]]
            if len(own) > len(self.up):
                self._powers(1 << int(len(own) - 1).bit_length())
            total = np.concatenate([[np.uint64(0)], np.cumsum(self.values[own] * self.up[: len(own)])])
            starts = np.flatnonzero((own & 0xC0) != 0x80)
            row = np.searchsorted(offsets[first : end + 1] - offsets[first], starts, "right") - 1
            stops = np.append(starts, len(own))
            for n in self.settings.sizes:
                at = np.arange(max(0, len(starts) - n + 1))
                at = at[row[at] == row[at + n - 1]]
                hashes = mixed((total[stops[at + n]] - total[stops[at]]) * self.down[starts[at]] + self.salt + np.uint64(n))
                rows.append(row[at] + first)
                found.append((hashes % np.uint64(self.settings.places)).astype(np.int64))
        return np.concatenate(rows), np.concatenate(found)


class Judge:
    """Bias and weights by place; made from labelled n-grams."""

    def __init__(self, settings: UrlSettings, bias: float = 0.0, weights: np.ndarray | None = None):
        self.settings, self.bias = settings, bias
        self.weights = np.zeros(settings.places) if weights is None else weights

    def _sides(self) -> tuple[Grams, Grams]:
        if not hasattr(self, "sides"):
            self.sides = Grams(self.settings, 0), Grams(self.settings, 1 << 40)
        return self.sides

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "sides"}

    def grams(self, hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the n-grams of both."""
        both = [side.of(column) for side, column in zip(self._sides(), (hosts, paths), strict=True)]
        return tuple(np.concatenate(x) for x in zip(*both, strict=True))

    def scores(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """The probability that each of n URLs is unwanted; n-grams weigh 1 over the root of their number."""
        total = np.bincount(rows, self.weights[places], n)
        z = self.bias + total / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def fit(self, rows: np.ndarray, places: np.ndarray, labels: np.ndarray) -> Judge:
        """Full-batch gradient steps with a root-mean-square scale, from the share of the labels."""
        s, n = self.settings, len(labels)
        if not n:
            self.bias = -1.0
            return self
        share = (labels.sum() + 0.5) / (n + 1)
        self.bias = float(np.log(share / (1 - share)))
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
        seen, seen_bias = np.zeros(s.places), 0.0
        for _ in range(s.rounds):
            wrong = self.scores(rows, places, n) - labels
            slope, slope_bias = self.gradient(rows, places, wrong, scale)
            seen += slope * slope
            seen_bias += slope_bias * slope_bias
            self.weights = self.weights - s.rate * slope / (np.sqrt(seen) + 1e-8)
            self.bias -= s.rate * slope_bias / (seen_bias**0.5 + 1e-8)
        return self

    def gradient(self, rows, places, wrong: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean logistic loss and the penalty; `wrong` is score minus label."""
        n = len(wrong)
        slope = np.bincount(places, (wrong * scale)[rows], self.settings.places) / n + self.settings.penalty * self.weights
        return slope, float(wrong.mean())


def learned(labelled: DataFrame, settings: UrlSettings | None = None, url: str = "url", label: str = "label") -> Judge:
    """Fit the judge to a labelled table: of rows without nulls the `most` with the least hashes; equal rows count once."""
    settings = settings or UrlSettings()
    judge = Judge(settings)

    def cut(batches):
        for batch in batches:
            rows, places = judge.grams(batch.column("host"), batch.column("path"))
            # One entry per place and row: no URL sends more than there are places, however long it is.
            pairs, counts = np.unique(rows * settings.places + places, return_counts=True)
            ends = np.searchsorted(pairs // settings.places, np.arange(len(batch) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (pairs % settings.places, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], names=["label", "places", "counts"])

    known = labelled.filter(F.col(url).isNotNull() & F.col(label).isNotNull())
    single = known.select(F.col(url).alias("url"), (F.col(label).cast("int") > 0).cast("int").alias("label")).distinct()
    chosen = single.orderBy(F.xxhash64("url", F.lit(settings.seed)), "url", "label").limit(settings.most)
    sides = chosen.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    found = sides.mapInArrow(cut, "label int, places array<long>, counts array<long>").toArrow().combine_chunks()
    if not found.num_rows:
        return judge.fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    lists, counts = (found.column(c).combine_chunks() for c in ("places", "counts"))
    again = counts.flatten().to_numpy()
    rows = np.repeat(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), again)
    return judge.fit(rows, np.repeat(lists.flatten().to_numpy(), again), found.column("label").to_numpy().astype(float))


class RuleTable:
    """Rules by host, with the verdict of the best rule for a host and a path."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            own = self.by_host.setdefault(host, {})
            own[path] = max(verdict, own.get(path, verdict))  # block before allow
        self.lengths = {host: sorted({len(path) for path in own}, reverse=True) for host, own in self.by_host.items()}

    def hosts(self, host: str) -> list[str]:
        """The host itself and the domains that it is in, longest first, as far as rules name them."""
        found, at = [host] if host in self.by_host else [], host.find(".")
        while at >= 0:
            if host[at + 1 :] in self.by_host:
                found.append(host[at + 1 :])
            at = host.find(".", at + 1)
        return found

    def best(self, hosts: list[str], path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        for host in hosts:
            for n in self.lengths[host]:
                if n <= len(path) and (verdict := self.by_host[host].get(path[:n])) is not None:
                    if best is None or len(host) + n > best[0]:
                        best = len(host) + n, host + path[:n], verdict
                    break
        return best and best[1:]


def matched(sides: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct (host, path) that a rule fits, by a join on host suffix and path prefix."""
    lengths = sorted(row[0] for row in rules.select(F.length("path")).distinct().collect())
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    places = sides.distinct().select("host", "path", F.explode(suffixes).alias("its_host")).withColumn("n", F.explode(ends))
    keyed = places.select("host", "path", "its_host", F.expr("substring(path, 1, n)").alias("its_path"))
    named = rules.select(F.col("host").alias("its_host"), F.col("path").alias("its_path"), "verdict")
    length = F.length("its_host") + F.length("its_path")
    rank = F.struct(length, F.length("its_host"), "verdict", F.concat("its_host", "its_path").alias("rule"))
    best = keyed.join(named, ["its_host", "its_path"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judged(
    pages: DataFrame, rules: DataFrame, judge: Judge, keep: tuple[str, ...] = ("page_id",), url: str = "url", most_rules: int = MOST_RULES
) -> DataFrame:
    """The columns in `keep`, host, path, rule (null where none fits), verdict (allow or block), score (of the judge)."""
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter("host is not null and verdict in ('allow', 'block')")
        .distinct()
    )
    kept = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    sides = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    few = [tuple(row) for row in rules.limit(most_rules + 1).collect()]
    if len(few) <= most_rules:
        ready, extra = sides, ()
        sent = sides.sparkSession.sparkContext.broadcast(few)
    else:
        found = matched(sides.select("host", "path"), rules)
        ready, extra, sent = sides.join(found, ["host", "path"], "left").select(*sides.columns, "rule", "verdict"), ("rule", "verdict"), None
    weights, bias, settings = sides.sparkSession.sparkContext.broadcast(judge.weights), judge.bias, judge.settings

    def decide(batches):
        table, model = sent and RuleTable(sent.value), Judge(settings, bias, weights.value)
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            if table is not None:
                coded = hosts.dictionary_encode()
                named = [table.hosts(host) for host in coded.dictionary.to_pylist()]
                fits: list = [None] * len(batch)
                which = coded.indices.to_numpy()
                ruled = np.flatnonzero(np.array([bool(x) for x in named], bool)[which]) if len(batch) else which
                for i, path in zip(ruled.tolist(), paths.take(pa.array(ruled)).to_pylist(), strict=True):
                    fits[i] = table.best(named[which[i]], path)
                rule = pa.array([x and x[0] for x in fits], pa.string())
                verdict = pa.array([x and x[1] for x in fits], pa.string())
            else:
                rule, verdict = batch.column("rule"), batch.column("verdict")
            score = model.scores(*model.grams(hosts, paths), len(batch))
            by_judge = pc.if_else(pa.array(score >= settings.threshold), "block", "allow")
            own = [batch.column(f"kept{i}") for i in range(len(keep))]
            names = [f"kept{i}" for i in range(len(keep))] + ["host", "path", "rule", "verdict", "score"]
            yield pa.RecordBatch.from_arrays([*own, hosts, paths, rule, pc.coalesce(verdict, by_judge), pa.array(score)], names=names)

    kinds = ", ".join(f"kept{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    result = "host string, path string, rule string, verdict string, score double"
    found = ready.select(*[f"kept{i}" for i in range(len(keep))], "host", "path", *extra).mapInArrow(decide, f"{kinds}, {result}" if keep else result)
    return found.toDF(*keep, "host", "path", "rule", "verdict", "score")
