"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import in_arrow, type_of


class Rule(NamedTuple):
    """Fits its host and all subdomains where the path starts with its path."""

    host: str
    path: str
    action: str

    @property
    def told(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: The labelled table, 75 URLs of either kind or so: unwanted URLs (gambling, adult, pills, spam, advertising, malware) and ordinary ones.
BLOCKED = """
http://casino-royal.example.com/en/12 https://www.casino-jackpot.example.net/play https://m.lucky-casino.example.org/de/77
https://free-bets-now.example.com/signup http://bets-free.example.net/en/431.html https://sport-bets.example.org/fr/88/
https://poker-online.example.com/ https://blog.slot-poker.example.net/es/901 http://win-money.example.com/win https://big-win.example.org/en/3
https://cheap-meds.example.com/order http://blog.cheap-viagra.example.net/en/55 https://pills-store.example.org/fr/19.html https://buy-pills.example.com/de/7/
https://www.diet-pills.example.net/en/621 http://pharmacy-cheap.example.com/es/12 https://adult-video.example.com/en/1 http://www.adult-chat.example.net/fr/42
https://x-adult.example.org/de/812.html https://xxx-tube.example.com/es/5/ http://m.sexcams-live.example.net/en/70 https://hot-xxx.example.org/en/4411
https://spam-mailer.example.com/en/9 http://blog.link-spam.example.net/fr/23 https://content-farm.example.org/en/810 https://www.link-farm.example.com/de/15.html
https://seo-farm.example.net/es/300/ http://ads-server.example.com/en/61 https://track.ads-click.example.net/fr/8 https://m.pop-ads.example.org/de/202
http://ad-tracker.example.com/en/17 https://pixel-track.example.net/es/64.html https://click-tracker.example.org/en/501 https://free-iphone.example.com/prize
http://prize-winner.example.net/en/2 https://quick-loans.example.com/de/93 https://payday-loan.example.org/fr/40/ http://free-crypto.example.net/en/88
https://malware-download.example.com/setup.exe http://crack-keygen.example.net/en/707 https://warez-crack.example.org/es/4 https://phish-login.example.com/en/6.html
http://casino.example.org/en/5 https://royal-casino-win.example.com/fr/66 https://bets-today.example.com/en/90 https://live-bets.example.net/de/4.html
https://poker-win.example.org/en/31/ http://www.jackpot-slots.example.com/es/2 https://win-prize.example.net/en/700 https://cheap-pills-online.example.org/en/41
http://pills24.example.com/fr/8 https://cheap-pharmacy.example.net/de/17/ https://buy-viagra.example.org/en/3 https://meds-cheap.example.com/es/61.html
https://adult-dating.example.com/en/72 http://m.adult-cams.example.org/fr/5 https://xxx-adult.example.net/de/30 https://sex-tube.example.com/en/19/
https://spam-links.example.net/en/28 http://www.spam-blog.example.com/fr/13.html https://farm-links.example.org/en/92 https://ads-track-click.example.com/en/80
http://track-ads.example.net/es/22 https://m.ads-pop.example.com/de/46/ https://click-ads.example.org/fr/11 https://tracker.example.net/en/8.html
https://free-prize.example.org/en/150 https://free-money.example.com/fr/20 http://loans-quick.example.net/en/9 https://payday-cash.example.com/en/33
https://crypto-win.example.org/en/55 https://download-crack.example.net/en/6 https://keygen-warez.example.com/de/18 https://login-phish.example.org/en/73
""".split()
ALLOWED = """
https://www.riverstone.example.org/en/1204.html http://harbour.example.com/fr/33 https://m.lindenhof.example.net/de/871/ https://blog.montclair.example.org/es/46
https://theorem.example.net/en/50713/ https://thenorth.example.com/fr/3018 http://nation.example.org/en/402 https://www.thimble.example.com/de/9921.html
http://m.station.example.net/es/77 https://tinder-box.example.org/en/18/ https://www.athens.example.com/en/6050 https://thonet.example.net/fr/28646.html
https://blog.others.example.com/en/37186 https://motions.example.net/de/1346.html http://www.therapy.example.org/fr/35403 https://m.earthen.example.com/en/15583
https://thistle.example.net/es/26780/ http://blog.weather.example.org/de/6340 https://nothing.example.com/en/8745.html https://ration.example.net/en/24080
https://www.thousand.example.org/fr/2538 https://m.brother.example.net/en/45228/ http://edition.example.com/es/760 https://blog.anthem.example.org/en/13484.html
https://library.example.net/catalogue/2019/index https://www.museum.example.org/visit http://archive.example.com/papers/441 https://recipes.example.net/soup
https://city-council.example.org/minutes/2021 https://blog.gardening.example.com/roses https://school.example.net/en/timetable https://www.news-daily.example.com/world/8812
https://docs.example.org/manual/install http://wiki.example.net/wiki/Tower https://weather.example.com/forecast https://m.train-times.example.net/de/berlin
https://www.bakery.example.org/ https://shop.example.com/books/17 https://journal.example.net/article/5531 http://forum.example.org/t/9920 https://events.example.com/en/2020/05
https://www.thatcher.example.net/en/2201 https://m.theatre.example.com/fr/178.html https://nationwide.example.org/de/55/ https://blog.thorn.example.net/en/6
https://tendering.example.com/es/901 http://www.thread.example.org/en/47 https://hearth.example.net/fr/3310/ https://m.ingot.example.com/de/62.html
https://blog.rationale.example.org/en/8 https://thereon.example.com/en/4120 http://m.tithe.example.net/es/71 https://wherein.example.org/fr/5
https://university.example.org/en/courses/12 https://www.hospital.example.net/departments http://poems.example.com/fr/1870 https://maps.example.org/de/town/55
https://history.example.net/en/rome.html https://music.example.com/scores/17 https://www.orchard.example.org/en/66 https://science.example.net/fr/atoms
https://blog.travels.example.com/es/lima https://cooking.example.org/en/bread https://m.football.example.net/en/league/4 https://law.example.com/statutes/91
https://chess.example.org/openings https://www.bridge.example.net/en/207 https://planets.example.com/de/mars https://stories.example.org/en/3/
""".split()

DIMENSIONS = 1 << 15
GRAMS = (3, 4, 5)
STEPS, RATE, DECAY = 600, 0.5, 2e-3
#: An ordinary URL counts this much: far more of what is crawled is ordinary than in the table.
PRIOR = 5.0
CACHE_PARTS = 100_000

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_AFTER = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without a :// in the URL."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = _AFTER.match(url, at + 3).groups()
    return host.translate(_UPPER), path


def grams(part: str, mark: str) -> np.ndarray:
    """Distinct hashed n-grams of a host or path, digits alike; the mark keeps the two apart."""
    text = "^" + re.sub(r"[0-9]", "0", part) + "$"
    found = {crc32((mark + text[i : i + n]).encode()) % DIMENSIONS for n in GRAMS for i in range(len(text) - n + 1)}
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def part(self, part: str, mark: str) -> float:
        index = grams(part, mark)
        return float(self.weights[index].sum() / np.sqrt(max(1, len(index))))

    def probability(self, host: str, path: str) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.part(host, "h") + self.part(path, "p")))))


def fit(urls: Sequence[tuple[str, bool]]) -> Model:
    """Full-batch gradient descent on the regularised log loss of (url, blocked) rows."""
    rows, columns, values = [], [], []
    for i, (url, _) in enumerate(urls):
        for part, mark in zip(parts(url), "hp"):
            index = grams(part, mark)
            rows += [i] * len(index)
            columns += index.tolist()
            values += [1 / np.sqrt(max(1, len(index)))] * len(index)
    rows, columns, values = np.array(rows), np.array(columns), np.array(values)
    y = np.array([float(b) for _, b in urls])
    count = np.where(y == 1, 1.0, PRIOR)
    count /= count.sum()
    w, bias = np.zeros(DIMENSIONS), 0.0
    for _ in range(STEPS):
        score = bias + np.bincount(rows, weights=w[columns] * values, minlength=len(y))
        error = (1 / (1 + np.exp(-score)) - y) * count
        w -= RATE * (np.bincount(columns, weights=error[rows] * values, minlength=DIMENSIONS) * 10 + DECAY * w)
        bias -= RATE * error.sum()
    return Model(w, bias)


def labelled() -> list[tuple[str, bool]]:
    return [(u, True) for u in BLOCKED] + [(u, False) for u in ALLOWED]


class Judge:
    def __init__(self, rules: Sequence[Rule], model: Model, threshold: float):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)
        self.model, self.threshold = model, threshold
        self.scores: dict[tuple[str, str], float] = {}

    def rule(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while True:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path) and (best is None or len(rule.told) > len(best.told)):
                    best = rule
            at = host.find(".", at) + 1
            if not at:
                return best

    def score(self, part: str, mark: str) -> float:
        key = part, mark
        if key not in self.scores:
            if len(self.scores) >= CACHE_PARTS:
                self.scores.clear()
            self.scores[key] = self.model.part(part, mark)
        return self.scores[key]

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str, float]:
        host, path = parts(url)
        chance = float(1 / (1 + np.exp(-(self.model.bias + self.score(host, "h") + self.score(re.sub(r"[0-9]", "0", path), "p")))))
        rule = self.rule(host, path)
        verdict = rule.action if rule else "block" if chance >= self.threshold else "allow"
        return host, path, rule.told if rule else None, verdict, chance


def _judged(source: Iterable[pa.RecordBatch], rules: Sequence[Rule], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    judge = Judge(rules, model, threshold)
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
    for batch in source:
        out = [judge(u) for u in batch.column(1).to_pylist()]
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "host", "path", "rule", "verdict", "p_block"])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, urls: Sequence[tuple[str, bool]] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, p_block.

    The longest rule that fits decides; p_block, the model's probability, decides the rest from threshold on.
    The model is fitted on the driver to a small labelled table, and the rules, a short list, are sent
    with it; one pass without a shuffle follows.  A null URL or one without :// has an empty host and path,
    and is judged by the model like any other.  Very long URLs are judged whole, in linear time; repeated rows give
    rows each, an empty table none; other columns are ignored, whatever their names.
    """
    model = fit(labelled() if urls is None else urls)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    schema = f"id {type_of(rows, 'id')}, host string, path string, rule string, verdict string, p_block double"
    return rows.transform(in_arrow, partial(_judged, rules=tuple(rules), model=model, threshold=threshold), schema).withColumnRenamed("id", id_col)
