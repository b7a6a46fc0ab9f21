"""URL filter: rules on hosts, and a naive Bayes score on segmented host and path words where no rule fits.

Names run together are split by the likeliest words: a unigram model counted over the text of all pages, and Viterbi.
A multinomial naive Bayes model over hashed words of hosts and paths is counted over all pages that a rule judges.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: (verdict, host and path); a rule fits its host and all subdomains if the path begins with the rule's
Rule = tuple[str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
#: letters that a word of the unigram model has at least
SHORTEST_WORD = 2
#: letters of a word that a host's substrings are looked up by; longer words are found by their first ones
LOOKED_UP = 32
#: substrings of hosts in a batch
PIECES = 50_000
#: slots that words of hosts and paths are hashed to
SLOTS = 1 << 16
#: words that a task counts before it hands them on
FLUSH_WORDS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = re.compile(r"(?i)<(script|style)\b")
_CLOSED = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after the first `://` up to / ? # or the end, in lower case, and what follows up to ? or # ."""
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    pattern = "^([^/?#]*)([^?#]*)"
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, pattern, 1), _UPPER, _LOWER), F.regexp_extract(rest, pattern, 2)


class ByHost(dict):
    """Rules by host name: (what a path begins with, verdict); and the most labels that such a name has."""

    def __init__(self, rules: tuple[Rule, ...]):
        super().__init__()
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.setdefault(host, []).append((slash + path, verdict))
        self.deepest = max((name.count(".") + 1 for name in self), default=0)


def rule_for(host: str, path: str, rules: ByHost) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best = (None, None)
    labels = host.rsplit(".", rules.deepest)
    for i in range(len(labels)):
        name = ".".join(labels[i:])
        for begin, verdict in rules.get(name, ()):
            if path.startswith(begin) and len(name) + len(begin) > len(best[0] or ""):
                best = (name + begin, verdict)
    return best


def visible(html: str) -> str:
    """The text outside of tags, comments, scripts and styles, each of which leaves a blank, in one pass.

    What is not closed hides no more than its own tag, and a lone `<` nothing.
    """
    out, at, unclosed = [], 0, set()
    while (begin := html.find("<", at)) >= 0:
        tag = html.find(">", begin)
        if tag < 0:
            break
        end, found = tag + 1, _HIDDEN.match(html, begin, tag + 1)
        name = found and found.group(1).lower()
        if name in _CLOSED and name not in unclosed:
            close = _CLOSED[name].search(html, end)
            if close:
                end = close.end()
            else:
                unclosed.add(name)
        elif html.startswith("<!--", begin) and "!" not in unclosed:
            close = html.find("-->", begin + 4)
            if close >= 0:
                end = close + 3
            else:
                unclosed.add("!")
        out.append(html[at:begin])
        at = end
    out.append(html[at:])
    return " ".join(out)


class Segmenter:
    """Splits run-together names into the likeliest words.

    `counts` are all words, or those that can stand in the names, with the `total` over all.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)
        self.split = lru_cache(maxsize=100_000)(self._split)

    def _unknown(self, size: int) -> float:
        return math.log(self.total + 1) + size * math.log(10)

    def _split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        # the place from which an unknown word costs least: each letter adds the same, so it is kept from place to place
        from_, least = 0, 0.0
        for end in range(1, len(name) + 1):
            cost, begin = best[from_] + self._unknown(end - from_), from_
            for size in self.lengths:
                known = self.cost.get(name[end - size : end]) if size <= end else None
                if known is not None and best[end - size] + known < cost:
                    cost, begin = best[end - size] + known, end - size
            best.append(cost)
            back.append(begin)
            if cost - end * math.log(10) < least:
                from_, least = end, cost - end * math.log(10)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def host_words(host: str, segmenter: Segmenter) -> list[str]:
    out: list[str] = []
    for part in _PART.findall(host):
        out += ["0" * len(part)] if part[0].isdigit() else segmenter.split(part)
    return out


def url_slots(host: str, path: str, segmenter: Segmenter) -> list[int]:
    """Hashed words of the host and of the path; numbers count by their length."""
    return _slots(host_words(host, segmenter), path)


def _slots(split: list[str], path: str) -> list[int]:
    words = [f"h:{w}" for w in split]
    words += [f"p:{'0' * len(w) if w[0].isdigit() else w.lower()}" for w in _PART.findall(path)]
    return [zlib.crc32(w.encode()) % SLOTS for w in words]


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): all words of the visible text of all pages, in lower case."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for html in batch.column(0).to_pylist():
                held.update(_WORD.findall(visible(html).lower()) if html else ())
                if len(held) > FLUSH_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return pages.select(html_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(pages: DataFrame) -> DataFrame:
    return word_counts(pages).where(F.length("word") >= SHORTEST_WORD)


def vocabulary(pages: DataFrame) -> dict[str, int]:
    """All words, for tables whose words the driver can hold; `split_hosts` leaves them in the cluster."""
    return {r["word"]: r["n"] for r in _counted(pages).collect()}


def split_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of every distinct host, by the counts (word, n) of all words.

    A host is split by the words that stand in it, which a join of its substrings finds; only the lengths that words
    have are tried. Words beyond LOOKED_UP letters are found by their first ones and then sought in the host, so the
    substrings of a host are some for each of its letters. Neither the driver nor a task holds the vocabulary.
    """
    total = counts.agg(F.sum("n")).first()[0]
    hosts = hosts.select("host").distinct()
    lengths = [r[0] for r in counts.select(F.least(F.length("word"), F.lit(LOOKED_UP))).distinct().collect()]

    def pieces(batches) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(held, pa.string())], ["host", "begin"])

        at, held = [], []
        for batch in batches:
            for host in batch.column(0).to_pylist():
                for size in lengths:
                    own = {part[i : i + size] for part in set(_PART.findall(host)) for i in range(len(part) - size + 1)}
                    held += own
                    at += [host] * len(own)
                    if len(held) > PIECES or len(host) * len(at) > 64 * PIECES:
                        yield out()
                        at, held = [], []
        if held:
            yield out()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [
                host_words(host, Segmenter({w["word"]: w["n"] for w in known or ()}, total))
                for host, known in zip(batch.column("host").to_pylist(), batch.column("known").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(split, pa.list_(pa.string()))], ["host", "words"])

    begun = counts.withColumn("begin", F.left("word", F.lit(LOOKED_UP)))
    found = hosts.mapInArrow(pieces, "host string, begin string").join(begun, "begin")
    known = found.where((F.length("word") <= LOOKED_UP) | F.contains("host", "word")).groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return hosts.join(known, "host", "left").select("host", "known").mapInArrow(run, "host string, words array<string>")


@dataclass(frozen=True)
class Bayes:
    """Log-odds of block against allow."""

    prior: float
    weights: np.ndarray  # float32[SLOTS]

    def odds(self, slots: list[int]) -> float:
        return self.prior + float(self.weights[slots].sum())


def fit(urls: DataFrame, words: dict[str, int] | None = None, rules: tuple[Rule, ...] = RULES) -> Bayes:
    """Counted over all (host, path) that a rule judges; without both verdicts the words say nothing.

    Hosts are split by `words` or, without them, come split as a third column.
    """
    by_host = ByHost(rules)

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int]] = Counter()
        segmenter = Segmenter(words or {})
        for batch in batches:
            hosts = batch.column(0).to_pylist()
            splits = batch.column(2).to_pylist() if words is None else [host_words(host, segmenter) for host in hosts]
            for host, path, split in zip(hosts, batch.column(1).to_pylist(), splits, strict=True):
                verdict = rule_for(host, path, by_host)[1]
                if verdict:
                    held[verdict, -1] += 1  # the pages themselves
                    for slot in _slots(split, path):
                        held[verdict, slot] += 1
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(held.values()), pa.int64())], ["verdict", "slot", "n"])

    # two rows for each slot at most
    rows = urls.mapInArrow(count, "verdict string, slot int, n long").groupBy("verdict", "slot").agg(F.sum("n").alias("n")).collect()
    pages, n = {"allow": 0, "block": 0}, {v: np.zeros(SLOTS) for v in ("allow", "block")}
    for r in rows:
        if r["slot"] < 0:
            pages[r["verdict"]] = r["n"]
        else:
            n[r["verdict"]][r["slot"]] = r["n"]
    if not pages["allow"] or not pages["block"]:
        return Bayes(0.0 if not any(pages.values()) else math.inf if pages["block"] else -math.inf, np.zeros(SLOTS, "f4"))
    seen = max(1, int(((n["allow"] + n["block"]) > 0).sum()))
    log = {v: np.log((n[v] + 1) / (n[v].sum() + seen)) for v in n}
    return Bayes(math.log(pages["block"] / pages["allow"]), (log["block"] - log["allow"]).astype("f4"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, odds) of every row.

    Where no rule fits, `odds` above 0 block. A null url, or one without `://`, has an empty host and path; without
    evidence the verdict is allow. Repeated rows are judged alike; a null id stays; other columns are left out.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    split = materialize(split_hosts(urls, materialize(_counted(pages), "word-counts")), "split-hosts")
    urls = urls.join(split, "host")
    model = fit(urls.select("host", "path", "words"), rules=rules)
    by_host = ByHost(rules)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, words in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "words")), strict=True):
                rule, verdict = rule_for(host, path, by_host)
                odds = model.odds(_slots(words, path))
                rows.append((rule, verdict or ("block" if odds > 0 else "allow"), " ".join(words), odds))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), pa.array([r[3] for r in rows], pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "host_words", "odds"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, host_words string, odds double")
